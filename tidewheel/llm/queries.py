"""The corpus operators as queries over the tables of a folder, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, licenses, neardup, neighbours, packing, passages, quality, sharding, tokenfile, toxicity
from .common import shared_path, table, tune


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot and shard of every document."""
    return sharding.assign(table(tune(spark), sf_dir, "documents").select("doc_id"), ["doc_id"]).select("doc_id", "slot", "shard")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(tune(spark), sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(tune(spark), sf_dir, "documents")
    scored = toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))
    return scored.select(F.col("row.doc_id").cast("long").alias("doc_id"), "held_out", "score", "predicted")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(tune(spark), "tokens")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokenfile.read_tokens(spark, path)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words between white space, 2-word shingles, as this query's contract has them."""
    return neardup.near_duplicates(table(tune(spark), sf_dir, "documents"), shingle=2, words="space")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per repeated passage of a document: its words (end exclusive), and how many sources it has and the smallest of them.

    A source of a passage is the smallest doc_id that has some run of 50 words of it.
    """
    found = passages.repeated(table(tune(spark), sf_dir, "documents"))
    rows = found.select("doc_id", F.explode("spans").alias("s"))
    return rows.select("doc_id", F.col("s.first").cast("long").alias("first_word"), F.col("s.last").cast("long").alias("end_word"), F.size("s.sources").cast("long").alias("n_sources"), F.array_min("s.sources").alias("source_doc_id"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(tune(spark), sf_dir, "documents")
    scored = quality.score(documents, quality.fit(documents, table(spark, sf_dir, "labels")))
    return scored.select(F.col("row.doc_id").cast("long").alias("doc_id"), "held_out", "score", "predicted")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(tune(spark), sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_toxicity": op4_toxicity,
    "op5_token_files": op5_token_files,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_license_scan": op7_license_scan,
    "op8_repeated_passages": op8_repeated_passages,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
}

#: Words of a text: A-Z lower-cased, runs of anything but ASCII other than digits and letters.
WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The shard of every slot as one character, 64 of them from "0" on; the tests hold the table against plain lists.
TABLE = "".join(chr(48 + i) for i in sharding.lookup_table([f"shard-{i}" for i in range(sharding.SHARDS)]).tolist())

ORACLE: dict[str, str] = {
    "op1_sharding": f"""
WITH s AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {sharding.TABLE_SIZE} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, CAST(ascii(substr('{TABLE}', slot + 1, 1)) - 48 AS INTEGER) AS shard FROM s""",
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
patterns AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS p, least(13, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM patterns),
places AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, places.n, item_id FROM places JOIN patterns ON places.p = patterns.p AND places.n = patterns.n),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_near_duplicates": """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN low USING (doc_id)""",
    "op8_repeated_passages": f"""
WITH d AS (SELECT DISTINCT doc_id, {WORDS.format("text")} AS w FROM documents WHERE doc_id IS NOT NULL),
f AS (SELECT doc_id, w, len(w) AS n, min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) AS rep FROM d WHERE len(w) >= {passages.LENGTH}),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + {passages.LENGTH}), ' ') AS p
  FROM (SELECT doc_id, w, unnest(range(0, n - {passages.LENGTH - 1})) AS i FROM f WHERE doc_id = rep)),
low AS (SELECT p, min(doc_id) AS source FROM windows GROUP BY p HAVING min(doc_id) < max(doc_id)),
spans AS (
  SELECT doc_id, i AS a, i + {passages.LENGTH} AS b, source FROM windows JOIN low USING (p) WHERE source < doc_id
  UNION ALL SELECT doc_id, 0, n, rep FROM f WHERE doc_id <> rep),
begins AS (
  SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM spans),
islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS island FROM begins)
SELECT doc_id, CAST(min(a) AS BIGINT) AS first_word, CAST(max(b) AS BIGINT) AS end_word, count(DISTINCT source) AS n_sources, min(source) AS source_doc_id
FROM islands GROUP BY doc_id, island""",
    "op7_license_scan": rf"""
WITH d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
p(words, label) AS (VALUES {", ".join(f"({p.split(' ')}, '{label}')" for p, label in licenses.PHRASES.items())}),
hits AS (
  SELECT doc_id, i - 1 AS k, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), p
  WHERE w[i] = words[1] AND list_slice(w, i, i + len(words) - 1) = words),
base AS (SELECT doc_id, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word FROM hits GROUP BY doc_id),
t(id, label, words, must, need, span) AS (VALUES {", ".join(f"({i}, '{t.label}', {list(t.words)}, {list(t.must)}, {t.need}, {t.span})" for i, t in enumerate(map(licenses.made, licenses.TEMPLATES)))}),
blocks AS (
  SELECT doc_id, span, list_slice(w, i + 1, i + 2 * span) AS w
  FROM (SELECT doc_id, w, span, unnest(range(0, len(w), span)) AS i FROM d, (SELECT DISTINCT span FROM t))),
shares AS (
  SELECT doc_id, label, len(list_intersect(w, words)) AS c, len(words) AS n, need FROM blocks JOIN t USING (span) WHERE list_has_all(w, must)),
found AS (SELECT doc_id, label, max(c / n) AS share FROM shares WHERE c >= need GROUP BY ALL),
best AS (SELECT doc_id, max(share) AS share FROM found GROUP BY doc_id),
b AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT DISTINCT doc_id, label FROM hits) GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT doc_id, label FROM hits UNION SELECT doc_id, label FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(b.s, '') AS base_labels,
  coalesce(a.s, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN best USING (doc_id)""",
}
