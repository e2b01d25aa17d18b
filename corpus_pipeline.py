"""The corpus pipeline: from raw documents to training sequences.

Each stage takes what the one before kept, written as Parquet and read again, and
gives documents in the columns of `documents`; the last gives packed pieces.
Labels are read where a classifier is fitted; they decide nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetry.llm import minhash, packing, quality, substring, toxicity
from assetry.llm.common import labels, map_batches, new_folder, ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR_PERCENT = 80  # documents are near-duplicates from this similarity on


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.  A null or empty text is scored as one
    without words, null sources and languages are sites of their own, rows of one id are
    scored each for itself; without labels all stay.  An empty table stays empty."""
    return quality.score(docs.select(*COLUMNS), labels(spark, sf_dir)).where("quality_kept").select(*COLUMNS)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half.  A null or empty text has no clause and
    stays; rows are scored each for itself, whatever their ids; without labels of both
    kinds all stay.  An empty table stays empty."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, labels(spark, sf_dir))
    return toxicity.score(docs, model).where("toxic_score < 0.5").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, null
    after all others, and of several with that id the one of the smallest content hash.
    Rows of equal id and text are one document."""
    docs = docs.select(*COLUMNS)
    kept = minhash.near_duplicates(docs, percent=NEAR_PERCENT).where("chosen").select("doc_id", "k1").distinct()
    kept = kept.withColumnRenamed("doc_id", "kept_id")
    keyed = docs.withColumn("k1", F.xxhash64("doc_id", "text"))
    same = (keyed["k1"] == kept["k1"]) & keyed["doc_id"].eqNullSafe(kept["kept_id"])
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "k1"]).select(*COLUMNS)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages cut out; texts without one stay as they are, null and empty ones
    too, and documents of which nothing is left go.  Equal rows are copies of one another,
    so their passages go in all.  An empty table stays empty."""
    docs = docs.select(*COLUMNS)

    def make():
        def turn(batch):
            return {
                "cut": [
                    None if r is None else b" ".join(substring.kept_words(t.encode().split(), r)).decode()
                    for t, r in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist())
                ]
            }

        return turn

    cut = map_batches(substring.with_repeats(docs), make, "cut string", keep=True)
    text = F.coalesce("cut", "text")
    return (
        cut.where("cut IS NULL OR cut <> ''")
        .withColumns({"n_chars": F.coalesce(F.length("cut").cast("long"), "n_chars"), "text": text})
        .select(*COLUMNS)
    )


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, each a sequence.  A null or empty text is the end id
    alone; rows of one id are packed each for itself.  An empty table gives no piece."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("near duplicates", one_of_each),
    ("repeated passages", no_repeats),
    ("packing", packed),
]

# The classifiers, near-duplicates and tokens are beyond SQL; tests compare with
# plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written in the shared folder and read again."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
