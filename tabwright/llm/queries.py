"""The operators as queries over the test tables: contract columns derived from each operator's own result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm import decontaminate, html, langid, lexical, licenses, ngram_join, packing, spelling, substring, suffix, toxicity, vptree, warc
from tabwright.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op5_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.document_components(table(spark, folder, "documents"))


ORACLE["op5_ngram_jaccard"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' ')) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT g FROM grams GROUP BY g HAVING count(*) > 1),
few AS (SELECT doc_id, g FROM grams SEMI JOIN shared USING (g)),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM few a JOIN few b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, m.n, n.n HAVING 100 * count(*) >= 75 * (m.n + n.n - count(*))),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, min(r.y)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id, s.n
"""


@query
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    learn = langid.training_rows(docs)
    judged = docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), langid.identified(docs, langid.fit(docs.where(learn)), F.col("text")).alias("_j"))
    return judged.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), F.col("_j.lang").alias("lang_pred"), F.col("_j.score").alias("score"), F.col("_j.loss").alias("loss"), F.col("_j.rejected").alias("rejected"))


@query
def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE["op10_decontaminate"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
cut AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g
  FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM cut),
spots AS (
  SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n),
hits AS (
  SELECT s.doc_id, s.n, s.i, c.item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM spots) s JOIN cut c ON c.g = s.g AND c.n = s.n),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(len(w.w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit_words h ON h.doc_id = w.doc_id LEFT JOIN hit_items k ON k.doc_id = w.doc_id
"""


@query
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), packing.public_vocabulary())


@query
def op2_near_passages(spark: SparkSession, folder: str) -> DataFrame:
    return substring.near_passages(table(spark, folder, "documents"))


@query
def op4_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, folder, "documents")).drop("kept")


@query
def op9_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vptree.nearest(table(spark, folder, "embeddings"))


@query
def op6_html_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html.extract_pages(pages).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), toxicity.training_ids())
    held_out = F.coalesce(~toxicity.training_ids(), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def _license_oracle() -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(licenses.TEMPLATES.items()))
    words = r"regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+')"
    return f"""
WITH templates(license, text) AS (VALUES {values}),
tw AS (SELECT license, {words} AS w FROM templates),
ts AS (SELECT DISTINCT license, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM tw),
tn AS (SELECT license, count(*) AS n FROM ts GROUP BY license),
dw AS (SELECT doc_id, {words} AS w FROM documents),
di AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM dw),
ds AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s FROM di),
m AS (SELECT doc_id, license, i, s FROM ds JOIN ts USING (s)),
c AS (SELECT a.doc_id, a.license, a.i, n, count(DISTINCT b.s) AS have FROM (SELECT DISTINCT doc_id, license, i FROM m) a JOIN tn ON tn.license = a.license
  JOIN m b ON b.doc_id = a.doc_id AND b.license = a.license AND b.i >= a.i AND b.i < a.i + ceil(1.5 * n) GROUP BY a.doc_id, a.license, a.i, n),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY have DESC, i) AS k FROM c WHERE have >= 0.75 * n)
SELECT doc_id, license, CAST(i - 1 AS INTEGER) AS "at", have / n AS containment FROM r WHERE k = 1
"""


ORACLE["op8_license_scan"] = _license_oracle()


@query
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))


# DuckDB has no crc32: the usual table of 256 remainders, then one step for each byte.
ORACLE["op13_spelling_variants"] = r"""
WITH RECURSIVE remainders AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(doc_id || ':' || run))), lambda i: ('0x' || substr(hex(encode(doc_id || ':' || run)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS h
  FROM runs, remainders),
counted AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM counted WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
holes AS (
  SELECT word, length(word) AS size, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.size = b.size AND a.word <> b.word
  UNION SELECT a.word, b.word FROM holes a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM holes a JOIN words b ON a.rest = b.word),
ranked AS (
  SELECT p.a AS word, p.b AS form, w.n AS form_n, count(*) OVER (PARTITION BY p.a) AS n_near, row_number() OVER (PARTITION BY p.a ORDER BY w.n DESC, encode(p.b)) AS k
  FROM pairs p JOIN words w ON w.word = p.b),
known AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.form_n >= 10 * w.n THEN r.form END AS form, CASE WHEN r.form_n >= 10 * w.n THEN r.form_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.k = 1),
chain AS (
  SELECT word, word AS last, 0 AS step FROM known UNION ALL SELECT c.word, k.form, c.step + 1 FROM chain c JOIN known k ON k.word = c.last WHERE k.form IS NOT NULL)
SELECT k.word, k.n, k.n_near, k.form, k.form_n, c.root FROM known k JOIN (SELECT word, arg_max(last, step) AS root FROM chain GROUP BY word) c ON c.word = k.word
"""


@query
def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLE["op12_ranked_search"] = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS t FROM documents),
asked AS (
  SELECT item_id, t, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS t FROM benchmark)
  GROUP BY item_id, t),
tfs AS (SELECT doc_id, t, count(*) AS tf FROM words GROUP BY doc_id, t),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id),
totals AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
weights AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, totals GROUP BY t, big_n),
norms AS (SELECT doc_id, 75 + (25 * n * big_n) // big_l AS m FROM sizes, totals),
scores AS (
  SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN tfs USING (t) JOIN weights USING (t) JOIN norms USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, r::INTEGER AS "rank", doc_id, score FROM ranked WHERE r <= 20
"""


@query
def op11_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    kind = dict(pages.dtypes)["page_id"]
    records = warc.round_trip(pages)
    return records.select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


# DuckDB's sha1 is hexadecimal: its digits become 160 bits, and every five of them a letter of base32.
ORACLE["op11_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
bits AS (
  SELECT x, array_to_string(list_transform(range(1, 41), lambda i: right('0000' || bin(('0x' || substr(x, i, 1))::INTEGER), 4)), '') AS b FROM (SELECT DISTINCT x FROM p)),
digests AS (
  SELECT x, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce(list_prepend(0, list_transform(range(1, 6), lambda k: substr(b, 5 * i + k, 1)::INTEGER)), lambda a, d: 2 * a + d)::INTEGER, 1)), '') AS d FROM bits),
lows AS (SELECT x, min(page_id) AS low FROM p GROUP BY x)
SELECT page_id, octet_length(encode(h)) AS payload_bytes, d AS payload_digest, CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> low THEN low END AS refers_to
FROM p JOIN digests USING (x) JOIN lows USING (x)
"""
