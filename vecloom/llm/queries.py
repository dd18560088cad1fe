"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.ann import neighbours
from vecloom.llm.chat import fit_roles, parse_transcripts, rendered
from vecloom.llm.common import table
from vecloom.llm.decontam import contamination
from vecloom.llm.lines import BREAKS, HIDDEN, HOST, LEAST_PAGES, RATIO, drop_boilerplate, host_of, page_text
from vecloom.llm.neardup import near_duplicates
from vecloom.llm.packing import packed
from vecloom.llm.pii import KINDS, find_pii, span_list
from vecloom.llm.quality import fit_quality, fold_of, quality_scores
from vecloom.llm.suffix import without_repeats
from vecloom.llm.tokens import token_prefixes

TOKEN_LIMIT = 512
QUALITY_CUT = 0.3


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and the longest prefix within the limit."""
    counted = token_prefixes(table(spark, sf_dir, "documents"), budget=TOKEN_LIMIT, store=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "cut_chars")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the number of strict spans of each kind, base_sha256, spans, and how many spans there are."""
    found = find_pii(spark, table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda c: c["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.concat("base", "extra")).alias("spans"), (F.size("base") + F.size("extra")).cast("long").alias("n_found"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, bin_id, bin_offset, bin_size; lengths are UTF-8 bytes."""
    return packed(spark, table(spark, sf_dir, "documents"), F.octet_length("text"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return without_repeats(spark, table(spark, sf_dir, "documents"), kept_bytes=False)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return near_duplicates(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    scored = quality_scores(docs, fit_quality(spark, docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score."""
    return neighbours(spark, table(spark, sf_dir, "embeddings"), lambda i: F.pmod(i, F.lit(100)) == 0)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, n_dropped, n_kept_chars, kept_sha256 of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), page_text(F.col("html")).alias("text"))
    out = drop_boilerplate(spark, pages, "host", "text")
    return out.select("page_id", "host", F.col("n_lines_dropped").alias("n_dropped"), F.length("text").cast("long").alias("n_kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = f"""
WITH shown AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host,
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{HIDDEN}', '', 'g'), '{BREAKS}', chr(10), 'g'), '<[^>]*>', '', 'g') AS text
  FROM pages),
page AS (SELECT row_number() OVER () AS r, page_id, host, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM shown),
total AS (SELECT host, count(*) AS total FROM page GROUP BY host HAVING count(*) >= {LEAST_PAGES}),
line AS (SELECT DISTINCT r, host, unnest(lines) AS line FROM page),
often AS (
  SELECT host, line FROM line JOIN total USING (host) GROUP BY host, line, total
  HAVING count(*) >= {LEAST_PAGES} AND count(*) > total * {RATIO}::DOUBLE),
placed AS (SELECT r, page_id, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM page),
kept AS (SELECT p.* FROM placed p ANTI JOIN often o ON p.host = o.host AND p.line = o.line),
text AS (SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY place) AS text FROM kept GROUP BY r)
SELECT page_id, page.host, (greatest(len(lines), 1) - greatest(coalesce(n, 0), CASE WHEN len(lines) = 0 THEN 1 ELSE 0 END))::BIGINT AS n_dropped,
  length(coalesce(text, ''))::BIGINT AS n_kept_chars, sha256(coalesce(text, '')) AS kept_sha256
FROM page LEFT JOIN text USING (r)
"""


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, part, role, n_chars, rendered_sha256; roles are learned from a share of the conversations and never read for the others."""
    rows = table(spark, sf_dir, "conversations")
    model = fit_roles(rows.where(fold_of(F.col("conv_id")) != 0))
    turns = rendered(parse_transcripts(spark, rows, model))
    return turns.select("conv_id", "turn", "part", "role", F.length("content").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, pos, md5(array_slice(b, pos, pos + 199)) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS pos FROM d)),
again AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
s AS (SELECT r, pos, lag(pos) OVER (PARTITION BY r ORDER BY pos) AS before FROM w SEMI JOIN again USING (h)),
run AS (SELECT r, pos, sum(CASE WHEN before IS NULL OR pos > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY pos) AS k FROM s),
span AS (SELECT r, k, min(pos) AS a, max(pos) + 200 AS z FROM run GROUP BY r, k),
cut AS (SELECT r, count(*) AS n_spans, sum(z - a) AS n_removed, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS ends FROM span GROUP BY r),
kept AS (SELECT r, doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  array_to_string(list_transform(list_zip(list_concat([1], coalesce(ends, [])), list_concat(coalesce(starts, []), [octet_length(b) + 1])),
    lambda p: CASE WHEN p[2] > p[1] THEN hex(array_slice(b, p[1], p[2] - 1)) ELSE '' END), '') AS hexed
  FROM d LEFT JOIN cut USING (r))
SELECT doc_id, n_bytes::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(hexed)) AS kept_sha256 FROM kept
"""
WORD_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP10_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWERED}, '{WORD_SPLIT}'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array({LOWERED}, '{WORD_SPLIT}'), lambda w: w <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, pos, pos + 7), ' ') AS phrase, least(len(w), 8) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS pos FROM b WHERE len(w) > 0 AND item_id IS NOT NULL)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, pos, n, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT dw.doc_id, pos, dw.n, item_id FROM dw JOIN iw ON iw.phrase = dw.phrase AND iw.n = dw.n),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
OP5_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWERED}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, pos, pos + 4), ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS pos FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE common * 100 >= (a.n + b.n - common) * 75),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN edge e ON e.x = r.y),
comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN n USING (doc_id)
"""


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_pii": op2_pii,
    "op3_packing": op3_packing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_quality": op6_quality,
    "op7_nearest": op7_nearest,
    "op8_line_dedup": op8_line_dedup,
    "op9_chat": op9_chat,
    "op10_decontamination": op10_decontamination,
}
SQL: dict[str, str] = {"op4_suffix_dedup": OP4_SQL, "op5_near_duplicates": OP5_SQL, "op8_line_dedup": OP8_SQL, "op10_decontamination": OP10_SQL}
