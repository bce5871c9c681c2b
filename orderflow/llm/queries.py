"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bytepairs, decontam, infill, packing, quality, records, scoring, secrets, simhash, substrings, trie, warc
from .common import crc_mod, ship
from .encode import vocabulary
from .oracle import SQL  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)
        query.__doc__ = fn.__doc__
        QUERIES[name] = query
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_quality")
def op1_quality(spark, sf_dir):
    """Quality score of every document; rows whose crc32(doc_id) mod 4 is 2 never train."""
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 4) == 2
    model = quality.fit(docs, table(spark, sf_dir, "labels"), train=~held)
    s = quality.score(docs, model, [F.col("doc_id"), held.alias("held_out")])
    return s.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@register("op2_warc")
def op2_warc(spark, sf_dir):
    """Every page written to WARC archives, read back, in capture order."""
    h = warc.history(warc.write(table(spark, sf_dir, "pages")))
    return h.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op3_neighbours")
def op3_neighbours(spark, sf_dir):
    """The 10 nearest of every hundredth vector among all others."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@register("op4_secrets")
def op4_secrets(spark, sf_dir):
    """Secret spans of every document."""
    return secrets.scan(table(spark, sf_dir, "documents"))


@register("op5_scoring")
def op5_scoring(spark, sf_dir):
    """Word-model and self-attention scores of every document; crc32(doc_id) mod 7 = 2 is held out."""
    return scoring.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2, scoring.Params(vocabulary=vocabulary("word_bpe_49k.json")))


@register("op6_simhash")
def op6_simhash(spark, sf_dir):
    """SimHash classes of all documents: 4-word shingles, 4 bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, distance=4).select("doc_id", "fingerprint", "component_id")


@register("op7_substrings")
def op7_substrings(spark, sf_dir):
    """Every document without the words of windows of 35 words that recur."""
    return substrings.dedup(table(spark, sf_dir, "documents"), width=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


@register("op8_decontam")
def op8_decontam(spark, sf_dir):
    """Every document with the benchmark items it holds within their error budget."""
    m = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), [F.col("doc_id")])
    return m.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"),
                    F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["item"].cast("string"), h["edits"].cast("string"))), ",").alias("items"))


@register("op9_packing")
def op9_packing(spark, sf_dir):
    """All documents packed into sequences of 2048 tokens."""
    p = packing.Params(vocabulary=vocabulary("word_bpe_49k.json"), end_id=1, length=2048, cache=250_000, slice_bytes=4 << 20)
    return packing.pack(table(spark, sf_dir, "documents"), p)


@register("op10_records")
def op10_records(spark, sf_dir):
    """All documents' token ids written as framed records in id order and read back."""
    files = records.write(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)
    return records.read(files).select("doc_id", "start", "n_tokens", "ids_crc32")


@register("op11_prefixes")
def op11_prefixes(spark, sf_dir):
    """Every distinct prefix of the rebuilt conversations, with the totals of its subtree."""
    x = trie.prefixes(table(spark, sf_dir, "conversations"))
    return x.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@register("op12_infill")
def op12_infill(spark, sf_dir):
    """Every document cut in three for infilling, and restored from the result."""
    x = infill.restore(infill.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return x.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                    F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


@register("op13_bytepairs")
def op13_bytepairs(spark, sf_dir):
    """Every document's byte-level BPE ids, and the text decoded from them."""
    import public_tokenizers
    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    x = bytepairs.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN, decoded="decoded")
    return x.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                    F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                    F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
