"""Questions, crawling and jobs on small inputs."""

import datetime

import duckdb
import numpy as np
import pytest
from compare import both

from pantrylake.operators import jobs, retrieval
from pantrylake.plans.catalogue import oracle_sql, queries
from pantrylake.plans.records import letters
from pantrylake.sources import crawl


def test_ask_takes_the_nearest_records(spark):
    texts = ["aaa", "eee", "aae", "rst", "mno"]
    records = spark.createDataFrame([(i, t.upper(), t, [float(x) for x in letters()([t])[0]]) for i, t in enumerate(texts)], "record_id bigint, title string, text string, embedding array<float>")
    questions = spark.createDataFrame([(1, "ae"), (2, "ts")], "question_id bigint, question string")
    got = {r["question_id"]: r for r in retrieval.ask(questions, records, letters, lambda ps: [p.split("Question: ")[1] for p in ps], 3).collect()}
    m = letters()(texts)
    for i, q in ((1, "ae"), (2, "ts")):
        v = letters()([q])[0]
        sim = m @ v / np.maximum(np.linalg.norm(m, axis=1) * np.linalg.norm(v), 1e-9)
        want = sorted(range(5), key=lambda k: (-round(float(sim[k]), 6), k))[:3]
        assert [s["record_id"] for s in got[i]["sources"]] == want and got[i]["answer"] == f"{q}\nAnswer:"


def test_crawl_goes_by_levels_and_on_from_what_is_there(spark, tmp_path):
    def fetch(url):
        pages = {
            "http://a.org/robots.txt": "User-agent: *\nDisallow: /no",
            "http://a.org/": '<a href="/x">x</a><a href="/no">n</a><a href="http://b.org/">b</a><a href="p.pdf">p</a>',
            "http://a.org/x": '<a href="/y#top">y</a>', "http://a.org/no": "hidden", "http://a.org/y": "end",
        }
        return pages[url]

    path, limits = str(tmp_path / "pages"), crawl.Limits(depth=1, delay=0.0)
    got = {r["url"]: (r["html"], r["depth"]) for r in crawl.crawl(spark, ["http://a.org/"], fetch, path, limits).collect()}
    assert set(got) == {"http://a.org/", "http://a.org/x", "http://a.org/no"} and got["http://a.org/no"] == (None, 1) and got["http://a.org/x"][1] == 1
    more = crawl.crawl(spark, ["http://a.org/"], fetch, path, crawl.Limits(depth=2, delay=0.0))
    assert sorted(r["url"] for r in more.collect()) == sorted([*got, "http://a.org/y"])


def test_jobs(spark, tmp_path):
    waits, tries = [], []

    def fails():
        tries.append(1)
        raise KeyError("no")

    with pytest.raises(KeyError):
        jobs.retried(fails, sleep=waits.append)
    assert len(tries) == 3 and waits == [1.0, 4.0]
    f = tmp_path / "c.json"
    f.write_text('{"sources": [{"source_id": "a", "n": 1}, {"source_id": "a", "n": 2}, {"source_id": "b", "enabled": false}]}')
    watched = jobs.Watched(str(f))
    assert jobs.sources_of(watched.get())["a"]["n"] == 2 and len(jobs.sources_of(watched.get())) == 1
    f.write_text('{"sources": []}')
    assert watched.get() == {"sources": []}
    at = datetime.datetime(2024, 1, 1, 4, 0)
    assert jobs.next_run(at) == datetime.datetime(2024, 1, 2, 3, 0) and jobs.next_run(at.replace(hour=2)) == datetime.datetime(2024, 1, 1, 3, 0)
    assert [jobs.allowed("x", None), jobs.allowed("x", "y"), jobs.allowed("y", "y")] == [503, 401, 200]
    rows = spark.range(1000)
    done = jobs.run_in_chunks(rows, lambda d: d, str(tmp_path / "out"), "id", 300)
    assert done.count() == 1000 and jobs.run_in_chunks(rows, lambda d: d, str(tmp_path / "out"), "id", 300).count() == 1000
    path = str(tmp_path / "runs")
    assert jobs.run_job(spark, path, "j", lambda: {"n": 1})["n"] == 1
    with pytest.raises(ZeroDivisionError):
        jobs.run_job(spark, path, "k", lambda: {"n": 1 // 0})
    assert {r["job"]: r["status"] for r in jobs.run_states(spark.read.json(path)).collect()} == {"j": "SUCCEEDED", "k": "FAILED"}


def test_reviewer_format_orders_lines_of_any_part_and_leaves_out_lines_without_order(spark, tmp_path):
    lines = [(1, 1, 5), (1, 2, 1200000), (1, 3, 7), (1, 3, 2500000), (2, 1, 9000000000), (2, 4, 3), (3, 1, 1)]
    with duckdb.connect() as c:
        c.execute(f"COPY (SELECT * FROM (VALUES (1::BIGINT), (2), (4)) t(o_orderkey)) TO '{tmp_path}/orders.parquet'")
        c.execute(f"COPY (SELECT k::BIGINT AS l_orderkey, n::INTEGER AS l_linenumber, p::BIGINT AS l_partkey, 2.0::DOUBLE AS l_quantity FROM (VALUES {str(lines)[1:-1]}) t(k, n, p)) TO '{tmp_path}/lineitem.parquet'")
    got, want, _ = both(spark, queries()["reviewer_format"], oracle_sql()["reviewer_format"], str(tmp_path))
    assert got == want and len(got) == 2


def test_vector_literals_round_halves_to_even_and_leave_out_nulls(spark, tmp_path):
    halves = [k / 512 for k in range(-1023, 1024, 2)]
    odd = [None, 0.0, -0.0, 1e-10, -1e-10, 5e-9, 8388607.5, 8388608.0, 16777215.0, 1e30, -3.4e38, 1e-45, float("nan"), float("inf"), float("-inf")]
    drawn = [float(x) for x in (np.random.default_rng(0).normal(size=3000) * 10.0 ** np.random.default_rng(1).integers(-9, 8, 3000)).astype(np.float32)]
    rows = [(0, halves), (1, odd), (2, []), (3, [None]), (4, None), (5, drawn), (6, [None, 1.0])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "vectors"))
    next((tmp_path / "vectors").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    got, want, _ = both(spark, queries()["vector_literals"], oracle_sql()["vector_literals"], str(tmp_path))
    assert got == want and len(got) == 7
