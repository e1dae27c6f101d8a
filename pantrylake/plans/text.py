"""Text queries: normalising, splitting, matching and page parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from pantrylake.functions import fixed
from pantrylake.functions import text as T
from pantrylake.functions.html import page_parts
from pantrylake.operators.classify import reasons
from pantrylake.plans.registry import query, table
from pantrylake.sources.readers import follow

FOOD = ["anvil", "bolt", "gear", "ring", "widget", "gizmo", "plate"]


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_brand || '_' || p_name), '[_/,.;:()-]+', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS name_key FROM part")
def name_normalize(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.normal_name(F.concat_ws("_", "p_brand", "p_name")).alias("name_key"))


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS flat FROM documents")
def whitespace_collapse(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.collapse(F.col("text")).alias("flat"))


def _cleaned(docs):
    return docs.select("doc_id", T.clean_text("text").alias("flat"))


@query("""
SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(text, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '[ \\t\\n\\r\\x{00A0}]+', ' ', 'g')) AS flat FROM documents
""")
def clean_text_documents(spark, sf):
    """The cleaner on every text; tests hold it against Python's other entities, which DuckDB has no function for."""
    return _cleaned(table(spark, sf, "documents"))


@query("SELECT p_partkey, trim(regexp_replace(upper(p_brand || ' - ' || p_type), '[^A-Z0-9]+', '_', 'g'), '_') AS tag FROM part")
def tag_canonical(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.tag(F.concat_ws(" - ", "p_brand", "p_type")).alias("tag"))


def _listed(docs):
    return docs.select("doc_id", F.posexplode(T.as_list(F.col("text"))).alias("pos", "part"))


@query("""
SELECT doc_id, pos - 1 AS pos, parts[pos] AS part FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM (
  SELECT doc_id, list_filter(list_transform(CASE WHEN ltrim(text) LIKE '[%' AND json_valid(text) AND json_type(text) = 'ARRAY' THEN CAST(CAST(text AS JSON) AS VARCHAR[]) WHEN text LIKE '%|%' OR text LIKE '%' || chr(10) || '%' THEN string_split_regex(text, '[|\\n]') ELSE string_split(text, ',') END, lambda x: trim(x, ' ')), lambda x: x <> '') AS parts
  FROM documents))
""")
def listify_explode(spark, sf):
    """Every text as a list, JSON arrays too; tests hold it against Python on small texts."""
    return _listed(table(spark, sf, "documents"))


def _section_lines(turns):
    line = F.concat(F.col("role"), F.lit(":\n"), F.replace("text", F.lit("\n"), F.lit(" ")))
    rows = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("t"))
    got = T.section(F.col("t"), ["user:"], ["assistant:"])
    return rows.select("conv_id", (F.size(got) > 0).alias("has_user"), F.size(got).cast("long").alias("n_lines"))


@query("""
SELECT conv_id, regexp_extract(t, 'user:\\n((?:[^\\n]*\\n?)*?)(?:assistant:|$)', 1) <> '' AS has_user, len(list_filter(string_split(regexp_extract(t, 'user:\\n((?:[^\\n]*\\n?)*?)(?:assistant:|$)', 1), chr(10)), lambda x: trim(x, ' ') <> '')) AS n_lines
FROM (SELECT conv_id, string_agg(role || ':' || chr(10) || replace(text, chr(10), ' '), chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
""")
def section_lines(spark, sf):
    """Lines between two markers, of whole turns."""
    return _section_lines(table(spark, sf, "conversations"))


def _sentence_counts(docs):
    rows = docs.select("doc_id", T.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.size(F.filter("s", lambda x: F.length(x) >= 30)).cast("long").alias("n_long"))


@query("""
SELECT doc_id, len(s) AS n_sentences, len(list_filter(s, lambda x: length(x) >= 30)) AS n_long
FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])[ \\t\\n\\r]+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10))), lambda x: length(x) >= 12) AS s FROM documents)
""")
def sentence_steps(spark, sf):
    """Sentences of every document, whatever its language."""
    return _sentence_counts(table(spark, sf, "documents"))


@query("SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9])(the|and|of)($|[^a-z0-9])') AS english, regexp_matches(lower(text), '(^|[^a-z0-9])(der|die|und)($|[^a-z0-9])') AS german FROM documents")
def term_flags(spark, sf):
    low = F.lower("text")
    return table(spark, sf, "documents").select("doc_id", T.has_term(low, ["the", "and", "of"]).alias("english"), T.has_term(low, ["der", "die", "und"]).alias("german"))


@query("""
SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'blank' WHEN regexp_matches(text, '[\\x{0900}-\\x{0D7F}]') THEN 'indic_script' WHEN regexp_matches(text, 'Ã|Â|â€') THEN 'mojibake'
  WHEN regexp_matches(lower(source), '(^|[^a-z0-9])(src1|src2|src3)($|[^a-z0-9])') THEN 'off_scope_title' WHEN regexp_matches(text, '(?i)\\b(?:reply|posted by|comments?)\\b') THEN 'comment_contamination' END AS reason FROM documents
""")
def reason_classifier(spark, sf):
    return table(spark, sf, "documents").select("doc_id", reasons(F.col("text"), F.col("source"), ["src1", "src2", "src3"]).alias("reason"))


@query("""
SELECT reason, count(*) AS n, min(doc_id) AS example FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '^[-–—\\s]*$') THEN 'dashes' WHEN regexp_matches(text, '^[0-9\\s]*$') THEN 'digits'
  WHEN text LIKE '%!!%' THEN 'shouting' WHEN text LIKE '%|%' THEN 'table' WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'marks' END AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY reason
""")
def noise_filter(spark, sf):
    t = F.col("text")
    reason = (
        F.when(t.rlike(r"^[-–—\s]*$"), "dashes").when(t.rlike(r"^[0-9\s]*$"), "digits").when(t.contains("!!"), "shouting").when(t.contains("|"), "table").when(t.rlike("[#$%&*]{3}"), "marks")
    )
    return table(spark, sf, "documents").select("doc_id", reason.alias("reason")).filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"), F.min("doc_id").alias("example"))


@query("""
SELECT doc_id, length(l) BETWEEN 4 AND 70 AND len(string_split_regex(trim(l), '\\s+')) <= 9 AND NOT regexp_matches(l, '\\d') AND length(regexp_replace(l, '[^A-Z]', '', 'g')) > 0.45 * length(regexp_replace(l, '[^A-Za-z]', '', 'g'))
  AND length(regexp_replace(l, '[^A-Za-z]', '', 'g')) > 0 AS shouted FROM (SELECT doc_id, string_split(text, chr(10))[1] AS l FROM documents)
""")
def title_lines(spark, sf):
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    short = F.length(line).between(4, 70) & (F.size(F.split(F.trim(line), r"\s+")) <= 9) & ~line.rlike(r"\d")
    return table(spark, sf, "documents").select("doc_id", (short & (T.upper_share(line) > 0.45)).alias("shouted"))


def _context(turns):
    line = F.concat(F.lit("["), F.col("turn"), F.lit("] "), F.col("role"), F.lit(": "), F.col("text"))
    return turns.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("context")
    )


@query("""
SELECT conv_id, count(*) AS turns, string_agg('[' || turn || '] ' || role || ': ' || text, chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id
""")
def conversation_context(spark, sf):
    """The whole turns of each conversation as one prompt context."""
    return _context(table(spark, sf, "conversations"))


@query("""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) <> '' AS has_title, len(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS n_links,
  len(list_filter(regexp_extract_all(html, '<a href="([^"]+)"', 1), lambda x: NOT starts_with(x, '#') AND NOT regexp_matches(lower(x), '\\.(jpe?g|png|gif|webp|pdf|zip)$') AND (NOT regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:') OR regexp_matches(x, '^https?:')))) AS n_follow FROM pages
""")
def html_title_links(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", page_parts(F.col("html")).alias("p"))
    return rows.select("page_id", (F.col("p.title") != "").alias("has_title"), F.size("p.links").cast("long").alias("n_links"), F.size(F.filter("p.links", follow)).cast("long").alias("n_follow"))


@query()
def html_text(spark, sf):
    """Title and visible text of stored pages; tests hold it against small pages with known text."""
    return table(spark, sf, "pages").select("page_id", "url", page_parts(F.col("html")).alias("p")).select("page_id", "url", "p.title", "p.text")


@query("""
SELECT p_partkey, p_partkey % 7 || ' ' || lower(p_type) || ' ' || p_name AS display, CASE p_size % 4 WHEN 0 THEN 60 * (p_size % 5) + p_size WHEN 1 THEN nullif(60 * (p_size % 3), 0) WHEN 2 THEN p_size END AS minutes FROM part
""")
def display_and_durations(spark, sf):
    """Display texts, and durations from ISO 8601, words and bare numbers."""
    size = F.col("p_size")
    said = (
        F.when(size % 4 == 0, F.concat(F.lit("PT"), size % 5, F.lit("H"), size, F.lit("M"))).when(size % 4 == 1, F.concat(size % 3, F.lit(" hours"))).when(size % 4 == 2, size.cast("string"))
    )
    return table(spark, sf, "part").select("p_partkey", T.display((F.col("p_partkey") % 7).cast("double"), F.lower("p_type"), F.col("p_name")).alias("display"), T.minutes(said).alias("minutes"))


@query("""
SELECT doc_id, len(s) AS n_steps, list_sum(list_transform(s, lambda x: length(x))) AS chars FROM (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS s FROM documents) WHERE len(s) > 1
""")
def step_scores(spark, sf):
    """How much each set of steps says, as pairs to compare (characters, steps)."""
    rows = table(spark, sf, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("s")).filter("size(s) > 1")
    return rows.select("doc_id", F.size("s").cast("long").alias("n_steps"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query("SELECT DISTINCT p_name AS title, 0 AS noise FROM part WHERE regexp_matches(p_name, '(^|[^a-z0-9])(anvil|bolt|gear|ring|widget|gizmo|plate)($|[^a-z0-9])')")
def food_titles(spark, sf):
    return table(spark, sf, "part").select(F.col("p_name").alias("title")).distinct().filter(T.has_term(F.col("title"), FOOD)).withColumn("noise", F.when(T.has_term(F.col("title"), fixed.TITLE_NOISE), 1).otherwise(0))
