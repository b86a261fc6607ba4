"""Queries beside the ten, for what SQL can give of their results: base columns
without the fitted verdict, the whole walk of the index, and the invariants of
packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .neighbours import nearest
from .packing import op2_packing
from .quality_rules import op10_quality_rules
from .secrets import op6_secrets


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_quality_rules(spark, sf_dir).drop("kept", "posterior")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def neighbours_whole_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, visit=1.0).withColumn("score", F.round("score", 6))


def packing_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document whether its pieces follow each other from its first id
    to its last, and lie in sequences that are filled without gaps."""
    pieces = op2_packing(spark, sf_dir)
    text, line = Window.partitionBy("doc_id", "doc_tokens").orderBy("start"), Window.partitionBy("sequence_id").orderBy("offset")
    follows = F.col("start") == F.coalesce(F.lag(F.col("start") + F.col("length")).over(text), F.lit(0))
    packed = F.col("offset") == F.coalesce(F.lag(F.col("offset") + F.col("length")).over(line), F.lit(0))
    checked = pieces.select("doc_id", "length", "doc_tokens", (follows & packed & (F.col("offset") + F.col("length") <= 4096)).alias("fits"))
    return checked.groupBy("doc_id").agg((F.every("fits") & (F.sum("length") == F.max("doc_tokens"))).alias("covered"))


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
QUERIES = {"quality_statistics": quality_statistics, "secret_counts": secret_counts, "neighbours_whole_walk": neighbours_whole_walk, "packing_covers": packing_covers}
SQL = {
    "quality_statistics": """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
g AS (SELECT r, i, w[i : i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
o AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
p AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM o WHERE n > 1),
c AS (SELECT r, sum(least(3, coalesce(i - before, 3))) AS n FROM p GROUP BY r),
s AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN c USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
""",
    "secret_counts": f"""
SELECT doc_id,
       len(list_filter(regexp_extract_all(coalesce(text, ''), '({_KEYS})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6))::BIGINT AS n_assign,
       len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::BIGINT AS n_access,
       len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24))::BIGINT AS n_hex
FROM documents
""",
    "neighbours_whole_walk": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.e, x.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(x.e, x.e)) AS score
      FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM c)
SELECT query_id, rank::INT AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5
""",
    "packing_covers": "SELECT doc_id, true AS covered FROM documents",
}
