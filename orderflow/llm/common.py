"""Helpers shared by the training-data operators.

Tables that cut lineage are written as Parquet under the shared checkpoint folder
(``spark.checkpoint.dir``), so any executor can read them again after a loss.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# At most HEAVY_PARTS keys can each hold more than 1/HEAVY_PARTS of the rows, so a table of such keys
# has a proven bound and may be broadcast; every other key is small enough to shuffle.
HEAVY_PARTS = 1000
SLICE_BYTES = 8 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder; removed when the application ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(left: DataFrame, stats: DataFrame, key: str, total: int | None = None, how: str = "left") -> DataFrame:
    """left join stats on key, safe for hot keys.

    ``stats`` has one row per key and a column ``n``: the left rows of that key.  Keys with more than
    1/HEAVY_PARTS of the rows (HEAVY_PARTS at most) are broadcast; their left rows get a spread key in
    the shuffle join, so no task receives a hot key.  ``n`` is dropped.
    """
    cols = [c for c in stats.columns if c not in (key, "n")]
    total = total if total is not None else (stats.agg(F.sum("n")).first()[0] or 0)
    heavy = stats.filter(F.col("n") * HEAVY_PARTS > total)
    light = stats.filter(F.col("n") * HEAVY_PARTS <= total)
    h = F.broadcast(heavy.select(F.col(key).alias("h_key"), F.struct(F.lit(True).alias("hit"), *cols).alias("h_val")))
    x = left.join(h, F.col(key) == F.col("h_key"), "left")
    # a heavy row needs no partner below: its null key is dealt by the row's own spread value
    x = (x.withColumn("j_key", F.when(F.col("h_val").isNull(), F.col(key)))
          .withColumn("j_spread", F.when(F.col("j_key").isNull(), F.xxhash64(*[F.col(c) for c in left.columns])).otherwise(F.lit(0))))
    lt = light.select(F.col(key).alias("l_key"), F.lit(0).cast("long").alias("l_spread"),
                      F.struct(F.lit(True).alias("hit"), *cols).alias("l_val"))
    x = x.join(lt, (F.col("j_key") == F.col("l_key")) & (F.col("j_spread") == F.col("l_spread")), "left")
    val = F.coalesce("h_val", "l_val")
    if how == "inner":
        x = x.filter(val.isNotNull())
    return x.select(*left.columns, *[val.getField(c).alias(c) for c in cols])


def recurring(rows: DataFrame, key: str, weight: Column | None = None) -> DataFrame:
    """The rows whose key's weights sum to two or more, and a flag ``heavy`` for hot keys."""
    n = F.sum(weight) if weight is not None else F.count(F.lit(1))
    stats = stored(rows.groupBy(key).agg(n.alias("w"), F.count(F.lit(1)).alias("n")).filter(F.col("w") >= 2)
                   .select(key, "n"), "recurring")
    total = stats.agg(F.sum("n")).first()[0] or 0
    stats = stats.withColumn("heavy", F.col("n") * HEAVY_PARTS > total)
    return attach(rows, stats, key, total, "inner")


def utf8(col: Column | str) -> Column:
    """Text of a column, null as empty, as UTF-8 bytes."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


def text_of(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of at most `limit` bytes of text (or one row), which bounds a worker's memory."""
    size = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cum, a, n = np.concatenate(([0], np.cumsum(size))), 0, len(size)
    while a < n:
        b = max(a + 1, int(np.searchsorted(cum, cum[a] + limit, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def over_slices(fn: Callable, col: str, limit: int = SLICE_BYTES) -> Callable:
    """mapInArrow function from fn(RecordBatch) -> RecordBatch | None, called on bounded slices."""
    def run(batches):
        state: dict = {}  # what fn keeps between the batches of one task
        for b in batches:
            for s in slices(b, col, limit):
                out = fn(s, state)
                if out is not None:
                    yield out
            release()
    return run


def release() -> None:
    """Give Arrow's free memory back: a worker that is used again would hold it beside its other tasks'."""
    pa.default_memory_pool().release_unused()


class Generations(dict):
    """A bounded cache in two generations: what was used lately stays when the older half goes."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        v = self.old.get(key)
        if v is None:
            v = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = v
        return v


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts: distinct words once, and codes by document."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.string()) if not pa.types.is_string(texts.type) else texts
        if lower:
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        flat, off = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        off = off - off[0]
        enc = flat.dictionary_encode()
        codes = enc.indices.to_numpy(zero_copy_only=False)
        self.arrow: pa.StringArray = enc.dictionary
        size = pc.binary_length(enc.dictionary).to_numpy(zero_copy_only=False)
        empty = np.flatnonzero(size == 0)
        if len(empty):  # before leading and after trailing white space
            keep = codes != empty[0]
            off = np.concatenate(([0], np.cumsum(keep)))[off]
            codes = codes[keep]
        self.codes, self.offsets, self.sizes = codes, off, size

    @cached_property
    def dictionary(self) -> np.ndarray:
        """The distinct words as str objects."""
        return self.arrow.to_numpy(zero_copy_only=False)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """By document, the sum of values[code] over its words."""
        cum = np.concatenate(([0], np.cumsum(values[self.codes])))
        return cum[self.offsets[1:]] - cum[self.offsets[:-1]]

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start..start+size of each pair, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(starts - (ends - sizes), sizes)
    at += np.arange(total)
    return at


def binary_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Large binary rows cut from one numpy buffer at element offsets."""
    data = np.ascontiguousarray(values)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [
        None, pa.py_buffer((np.asarray(offsets, dtype=np.int64) * data.itemsize).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the value as text, modulo n (null: of the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def crc32_u32(ids: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes()) & 0xFFFFFFFF


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application: workers need not have it installed."""
    import os
    import tempfile
    import zipfile
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="orderflow-"), "orderflow_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
