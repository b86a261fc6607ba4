"""From raw documents to packed training sequences, in five stages.

Each stage takes all that the one before kept, as a written table, and all but
the last return the columns of ``documents``. Further columns, of any name, go
along unchanged.

Defined results, for all stages: a null text counts as empty; an empty table
gives an empty result; repeated rows are rows of their own, but for the near
duplicates, of which one stays; rows without a ``doc_id`` are linked with
nothing and stay. A text of any length is worked on as one row.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.llm import mixing, near_dups, packing, quality_crf, secrets
from lemmata.llm.common import table, written
from lemmata.llm.labelled import fold


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that ``docs`` doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go. Empty texts are scored
    like any other; at the threshold itself a document stays."""
    field = quality_crf.fitted(docs, table(spark, sf_dir, "labels"), lambda d: fold(d, 5) != 0)
    score = _fresh(docs, "quality")
    return quality_crf.classify(docs, field, score).where(F.col(score) >= 0.3).drop(score)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = near_dups.PERCENT) -> DataFrame:
    """Of each group of near duplicates one document stays: that of smallest
    id, and of smallest hash of its text where several have that id. Empty
    texts are near duplicates of nothing."""
    return near_dups.one_of_each(docs, percent)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; every document stays, and null and
    empty texts stay as they are."""
    return secrets.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each reading of a document that the mix takes, in training
    order; a reading that the target ends in has its first words only. Empty
    texts have no words to take, and go.

    Rows find their texts by 128 bits of hash of id, source and text; equal
    rows are read as often as there are."""
    key = {"k1": F.xxhash64("doc_id", "source", "text"), "k2": F.xxhash64(F.lit(1), "doc_id", "source", "text")}
    readings = mixing.with_shares(docs, carry=key).where("taken > 0").select("k1", "k2", "size", F.explode("readings").alias("r"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    once = docs.select(*(c.alias(k) for k, c in key.items()), row.alias("row")).dropDuplicates(["k1", "k2"])
    text = F.col("row.text")
    first = F.concat_ws(" ", F.slice(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("r.words").cast("int")))
    out = readings.join(once, ["k1", "k2"]).withColumn("cut", F.when(F.col("r.words") < F.col("size"), first).otherwise(text)).orderBy("r.position", "row.doc_id", "k1", "k2")
    renewed = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        renewed["n_chars"] = F.length("cut").cast(docs.schema["n_chars"].dataType)
    return out.select(*(renewed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their token ids; an empty text is its
    end token alone."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), group_tokens=2_000_000, cached_words=120_000)


#: Similarity from which the corpus holds two documents for one; 85 is for ``op1_near_dups``.
SIMILAR = 80
STAGES = [("quality", quality), ("near_dups", partial(dedup, percent=SIMILAR)), ("secrets", redact), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
