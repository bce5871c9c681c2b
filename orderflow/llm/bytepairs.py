"""Byte-level BPE of a rank file over tables: texts to ids, and ids back to texts.

``encode`` cuts a text by the pattern and runs each piece through the transducer (transducer.py), one per worker
process, whose states and cached pieces are bounded; batches are cut at ``SLICE`` bytes of text.  ``decode`` joins
the ids' bytes a block at a time through a streaming UTF-8 decoder.  Both only map rows: nothing is shuffled, and a
lost task is run again on its own.

Defined results: a null or empty text has no ids; null ids decode to an empty text; an id that the vocabulary lacks
is an error; bytes that are no UTF-8 decode to replacement characters; repeated rows stay rows of their own; an
empty table gives an empty table; other columns of the input pass unchanged, and one named like the output is
replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import over_slices, text_of
from .transducer import RankEncoder, id_lists, read_ranks, text_of_ids

SLICE = 2 << 20
IDS_SLICE = 1 << 20
_ENCODERS: dict = {}
_TABLES: dict = {}


def encoder(path: str, pattern: str) -> RankEncoder:
    """The worker's encoder of a rank file and pattern."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = RankEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def token_table(path: str) -> list[bytes | None]:
    """Token by id."""
    if path not in _TABLES:
        ranks = read_ranks(path)
        table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        _TABLES[path] = table
    return _TABLES[path]


def kept_columns(df: DataFrame, *gone: str) -> list[str]:
    names = {g.lower() for g in gone}
    return [c for c in df.columns if c.lower() not in names]


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with its text replaced by its token ids, and, where ``decoded`` names a column, by the text decoded from
    these ids: ``decode`` in the same pass, by the same worker."""
    kept = kept_columns(docs, text, out, *([decoded] if decoded else []))
    src = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)], text_of(text).alias("t"))
    added = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())][:2 if decoded else 1]
    schema = T.StructType([*src.schema.fields[:-1], *added])

    def run(b: pa.RecordBatch, state: dict) -> pa.RecordBatch:
        ids = id_lists(encoder(vocabulary, pattern).ids(b.column("t")))
        back = [pa.array(texts_of(ids, token_table(vocabulary)), pa.string())] if decoded else []
        return pa.RecordBatch.from_arrays([*b.columns[:-1], ids, *back], names=schema.names)

    x = src.mapInArrow(over_slices(run, "t", SLICE), schema)
    return x.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("ids").alias(out), *([F.col("decoded").alias(decoded)] if decoded else []))


def texts_of(lists: pa.ListArray, table: list[bytes | None]) -> list[str]:
    """The text of each row's ids (null: none)."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat, cum = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    return [text_of_ids(flat[a:z], table) for a, z in zip(cum[:-1], cum[1:])]


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with the text of its ids beside them."""
    kept = kept_columns(encoded, out)
    src = encoded.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)])
    at = f"c{kept.index(ids)}"
    schema = T.StructType([*src.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        table = token_table(vocabulary)
        for b in batches:
            lists = b.column(at)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            cum, a = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), 0
            while a < len(sizes):  # runs of at most IDS_SLICE ids, or one row
                z = max(a + 1, int(np.searchsorted(cum, cum[a] + IDS_SLICE, side="right")) - 1)
                part = b.slice(a, z - a)
                texts = texts_of(part.column(at), table)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)
                a = z

    x = src.mapInArrow(run, schema)
    return x.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("decoded").alias(out))
