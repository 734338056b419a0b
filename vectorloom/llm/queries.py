"""The queries of this subpackage and their SQL, as __spark_entry__ registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann_tree, bpe, chat_repair, decontaminate, license_scan, ngram_join, packing, pii_tagger, prefix_trie, secret_scan, spelling, substring_dedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).drop("factors")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_tagger.find(table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tree.every_hundredth(table(spark, sf_dir, "embeddings"))


def op4_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.render_sequences(table(spark, sf_dir, "conversations"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_personal_data": op2_personal_data,
    "op3_neighbours": op3_neighbours,
    "op4_chat_repair": op4_chat_repair,
    "op5_secrets": op5_secrets,
    "op6_packing": op6_packing,
    "op7_ngram_join": op7_ngram_join,
    "op8_toxicity": op8_toxicity,
    "op9_decontaminate": op9_decontaminate,
    "op10_licenses": op10_licenses,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_spelling": op12_spelling,
    "op13_bpe": op13_bpe,
}

ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({ASCII_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS g FROM (
  SELECT item_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS s FROM (SELECT item_id, w, least(len(w), 10) AS m FROM b WHERE len(w) > 0))),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS g FROM (
  SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS s FROM d, ms WHERE len(w) >= m)),
h AS (SELECT DISTINCT doc_id, item_id, s, dw.m FROM dw JOIN bw USING (m, g)),
p AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + m - 1)) AS x FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)
"""

OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS s FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS g FROM s),
r AS (SELECT doc_id, s FROM g QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, s) > 1),
x AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS i FROM r),
c AS (SELECT doc_id, list(i) AS cut FROM x GROUP BY doc_id),
k AS (SELECT doc_id, w, coalesce(len(cut), 0) AS n, cut FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN n = 0 THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(cut, i)) END, ' ')) AS kept_sha256
FROM k
"""

OP7 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 85 * (p.n + q.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS v, x AS c FROM e UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.v WHERE r.c < e.y),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.v = d.doc_id
"""

ORACLE_SQL = {
    "op7_ngram_join": OP7,
    "op1_substring_dedup": OP1,
    "op9_decontaminate": OP9,
}
