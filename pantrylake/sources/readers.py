"""Sources as raw records: record_id, source_id, source_type, raw_content, metadata, ingested_at.

Content and metadata are VARIANT, so unmapped keys survive; the id is a hash of what was read, so a task that runs
again makes the same one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pantrylake.functions.html import page_parts
from pantrylake.functions.text import first_line, section

MEDIA = {"pdf": (["pdf"], "pdf_ocr_required"), "image": (["png", "jpg", "jpeg", "webp"], "image_ocr_failed"), "audio": (["mp3", "wav", "m4a"], "transcription_missing"), "youtube": (["youtube"], "youtube_transcript_missing")}


def envelope(df: DataFrame, source_id: str, source_type: str, content: Column, metadata: Column, identity: Column | None = None) -> DataFrame:
    """Raw records of df; content and metadata are struct or map columns."""
    if not source_type:
        raise ValueError("source_type is required")
    body = F.to_json(content, {"ignoreNullFields": "false"})
    meta = F.to_json(metadata, {"ignoreNullFields": "false"})
    ident = identity if identity is not None else F.concat_ws("\x01", body, meta)
    return df.select(
        F.sha2(F.concat_ws("\x01", F.lit(source_id), ident), 256).alias("record_id"), F.lit(source_id).alias("source_id"), F.lit(source_type).alias("source_type"),
        F.parse_json(body).alias("raw_content"), F.parse_json(meta).alias("metadata"), F.current_timestamp().alias("ingested_at"),
    )


def read_csv(spark: SparkSession, path: str, source_id: str, sep: str = ",", source_type: str = "csv", multi_line: bool = False) -> DataFrame:
    """One record a row, all strings, missing cells empty, with the file and the row's place in it.

    Files are split; a row's place is its place in its split plus the rows of the splits before, which are counted first.
    Quoted line ends need multi_line, which reads a file in one task.
    """
    from pyspark.sql import Window as W

    df = spark.read.csv(path, header=True, multiLine=multi_line, escape='"', sep=sep, recursiveFileLookup=True)
    cols = df.columns
    place = {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_order": F.monotonically_increasing_id()}
    df = df.withColumns(place)
    splits = df.groupBy("_file", "_block").agg(F.min("_order").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    splits = splits.select("_file", "_block", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    df = df.join(splits, ["_file", "_block"]).withColumn("row_number", F.col("_order") + F.col("_shift"))
    content = F.struct(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in cols])
    return envelope(df, source_id, source_type, content, F.struct("row_number", F.col("_file").alias("file_path")))


def read_json(spark: SparkSession, path: str, source_id: str, source_type: str = "json") -> DataFrame:
    """One record a line of JSON; what can't be parsed keeps its text under `unparsed`.  Equal lines of a file are rows of one
    record_id, so that ingesting them again changes nothing."""
    file = F.col("_metadata.file_path")
    df = spark.read.text(path).select("value", file.alias("_file"), F.try_parse_json("value").alias("v"))
    rows = envelope(df, source_id, source_type, F.struct(F.col("value").alias("unparsed")), F.struct(F.col("_file").alias("file_path")), F.concat_ws("\x01", "_file", "value"))
    return rows.withColumn("raw_content", F.coalesce(F.try_parse_json(F.variant_get("raw_content", "$.unparsed", "string")), F.col("raw_content")))


def read_text(spark: SparkSession, path: str, source_id: str, source_type: str = "text") -> DataFrame:
    """One record a file; its title is the first line that isn't blank."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return envelope(df, source_id, source_type, text_content(F.col("value")), F.struct(F.col("_metadata.file_path").alias("file_path")))


def text_content(c: Column) -> Column:
    """Title, raw text, and the lines of the ingredient and step sections."""
    heads, steps = ["ingredients:", "ingredients"], ["instructions:", "method:", "steps:", "instructions", "method", "directions:"]
    return F.struct(first_line(c).alias("title"), c.alias("raw_text"), section(c, heads, steps).alias("ingredients"), section(c, steps, []).alias("steps"))


def read_media(spark: SparkSession, path: str, source_id: str, kind: str, extract: Callable[[bytes], str] | None = None) -> DataFrame:
    """One record a file of pictures, sound or pages: text from the file beside it (same name, .txt), else from an
    injected extractor, else none, with a flag that says so."""
    endings, flag = MEDIA[kind]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    beside = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(F.regexp_replace(F.col("_metadata.file_path"), r"\.[^./]+$", "").alias("stem"), F.col("value").alias("sidecar"))
    main = files.filter(F.lower("path").rlike(r"\.(" + "|".join(endings) + ")$")).withColumn("stem", stem)
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    df = main.withColumn("stem", bare(F.col("stem"))).join(beside.withColumn("stem", bare(F.col("stem"))), "stem", "left")
    if extract is not None:

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                yield pdf[["path", "sidecar"]].assign(text=[s if isinstance(s, str) else extract(bytes(b)) or "" for s, b in zip(pdf["sidecar"], pdf["content"], strict=True)])

        df = df.select("path", "content", "sidecar").mapInPandas(run, "path string, sidecar string, text string")
    else:
        df = df.withColumn("text", F.coalesce("sidecar", F.lit("")))
    missing = F.array_compact(F.array(F.when(F.trim("text") == "", F.lit(flag))))
    return envelope(df, source_id, kind, text_content(F.col("text")), F.struct(F.col("path").alias("file_path"), missing.alias("flags")))


def read_transcripts(df: DataFrame, source_id: str, video: str = "video_id", seq: str = "seq", text: str = "text") -> DataFrame:
    """One record a video from its segments in order."""
    rows = df.groupBy(video).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, text))), lambda x: x[text]), " ").alias("t"))
    flags = F.array_compact(F.array(F.when(F.trim("t") == "", F.lit("youtube_transcript_missing"))))
    return envelope(rows, source_id, "youtube", text_content(F.col("t")), F.struct(video, flags.alias("flags")))


def read_pages(pages: DataFrame, source_id: str, url: str = "url", html: str = "html") -> DataFrame:
    """One record a stored page: title, visible text, links to follow, and recipes in its JSON-LD."""
    df = pages.withColumn("p", page_parts(F.col(html)))
    return envelope(df, source_id, "web", F.struct("p.title", "p.text", F.to_json("p.recipes").alias("recipes")), F.struct(F.col(url).alias("source_url"), F.size("p.links").alias("n_links")))


def follow(link: Column) -> Column:
    """Whether a link leads to a page: not empty, not within the page, http or relative, no file of another sort."""
    scheme = F.regexp_extract(link, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return (F.trim(link) != "") & ~link.startswith("#") & F.lower(scheme).isin("", "http", "https") & ~F.lower(F.split_part(F.split_part(link, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))).rlike(r"\.(jpe?g|png|gif|webp|pdf|zip)$")


READERS = {"csv": read_csv, "dataset": read_csv, "json": read_json, "text": read_text}


def run_all(spark: SparkSession, sources: list[dict]) -> tuple[DataFrame | None, list[dict]]:
    """All enabled sources by (priority, id), united; a source that fails is reported and the others go on.

    A source is {"id", "kind", "path", "enabled", "priority", …reader options}.
    """
    out, runs = None, []
    for s in sorted((s for s in sources if s.get("enabled", True)), key=lambda s: (s.get("priority", 100), s["id"])):
        try:
            if s["kind"] in MEDIA:
                df = read_media(spark, s["path"], s["id"], s["kind"])
            else:
                df = READERS[s["kind"]](spark, s["path"], s["id"], **s.get("options", {}))
            df.limit(1).count()
            out = df if out is None else out.unionByName(df)
            runs.append({"source_id": s["id"], "status": "ok", "error": None})
        except Exception as e:  # noqa: BLE001 - one source must not stop the others
            runs.append({"source_id": s["id"], "status": "failed", "error": str(e)[:500]})
    return out, runs


def select_sources(sources: list[dict], ids: list[str] | None = None, group: str | None = None, everything: bool = False) -> list[dict]:
    """Sources by id, group, or all enabled ones, by (priority, id); unknown ids are an error."""
    by_id = {s["id"]: s for s in sources}
    if unknown := sorted(set(ids or []) - set(by_id)):
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    got = [by_id[i] for i in ids] if ids else [s for s in sources if (group is None or s.get("group") == group) and (everything or s.get("enabled", True))]
    return sorted(got, key=lambda s: (s.get("priority", 100), s["id"]))


def fixture_rows(spark: SparkSession, n: int, dishes: list[str], sets: list[str]) -> DataFrame:
    """n rows that go around lists of dishes and ingredient sets."""
    at = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("id") % len(xs) + 1).cast("int"))
    df = spark.range(n)
    return df.select(F.concat_ws(" ", at(dishes), (F.col("id") + 1).cast("string")).alias("title"), at(sets).alias("ingredients"), F.concat(F.lit("https://fixtures.example.com/"), F.col("id")).alias("source_url"))
