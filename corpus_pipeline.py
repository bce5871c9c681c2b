"""The corpus pipeline: quality, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes each
result to the shared folder and reads it again as the next stage's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.llm import decontam, packing, quality, secrets, simhash
from orderflow.llm.common import ship, stored
from orderflow.llm.encode import vocabulary

THRESHOLD = 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled documents."""
    ship(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    cols = docs.columns
    # the text goes to Python once, as a copy: the row itself comes back unchanged
    scored = quality.score(docs, model, [F.col(c).alias(f"c{i}") for i, c in enumerate(cols)])
    return scored.filter(F.col("score") >= THRESHOLD).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group (4-word shingles, 4 bits): its smallest (id, hash of the text, hash of the row), null
    ids last.  Rows with the same hashes and id are the same in every column, and one of them stays."""
    ship(spark)
    at = F.xxhash64(*[x for c in docs.columns for x in (F.col(c), F.col(c).isNull())])
    # the row goes along as one struct: no column of documents can clash with a name used here
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", F.xxhash64(F.col("text"), F.col("text").isNull()).alias("key_text"), at.alias("key_row"))
    groups = simhash.near_duplicates(keyed, words=4, distance=4, keep=[F.col("key_text"), F.col("key_row")])
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key_text", "key_row")).alias("first"))
    keep = first.select("root", F.col("first.doc_id").alias("keep_id"), F.col("first.key_text").alias("keep_text"), F.col("first.key_row").alias("keep_row"))
    one = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("key_text") == F.col("keep_text")) & (F.col("key_row") == F.col("keep_row"))
    return keyed.join(keep, one, "inner").dropDuplicates(["root"]).select("row.*")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item within its error budget."""
    ship(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text."""
    x = secrets.redact(docs)
    if "n_chars" in docs.columns:
        x = x.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return x


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents that are left."""
    ship(spark)
    return packing.pack(docs, packing.Params(vocabulary=vocabulary("word_bpe_49k.json"), end_id=1, length=2048))


STAGES = [
    ("quality", keep_quality),
    ("simhash", keep_one_of_each),
    ("decontaminate", drop_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


ORACLE_SQL = None  # a classifier and a packer have no SQL form
