"""Fill-in-middle transformation: each text is cut in three and its middle moved to the end.

A batch's texts become lists of units (code points), the lists are flattened beside their parents' indices, a
unit's ordinal is its place less its list's start, units are filtered by role (prefix, middle, suffix), the lists
are rebuilt from the counts and each list is joined to one string: Arrow columns throughout, no loop over rows.
Batches are cut at ``SLICE`` bytes of text and a longer text is taken in segments of that size, whose ordinals go on
where the segment before ended, so a worker never holds the units of more than one slice.

Cut points and form come from the hex SHA-256 of ``seed:id``: four groups of 8 digits, h1 to h4.  With n units the
prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1), the middle after the larger; a text stays plain if
it is empty, holds a mark, or h3 % 100 >= ``rate``; otherwise it is suffix-first if h4 % 100 < ``suffix_first``.

Defined results: a null text counts as empty and is plain; a null id hashes as an empty decimal; repeated rows and
repeated ids are rows of their own, each with its id's cut points; an empty table gives an empty table; columns of
the input keep their names, and an input column named like an output is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import over_slices, text_of

NONE = pa.scalar("", pa.large_string())
SLICE = 2 << 20  # a unit takes about 40 bytes in the columns beside it
ADDED = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
                      T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])


@dataclass(frozen=True)
class Params:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rate: int = 90          # of 100 texts, how many are cut
    suffix_first: int = 20  # of 100 cut texts, how many have the suffix first
    seed: str = "1"


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string column without nulls, and the offsets of its texts in them."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]]), off - off[0]


def unit_lists(data: np.ndarray, offsets: np.ndarray) -> pa.LargeListArray:
    """Each text as the list of its code points: a unit starts at every byte that does not continue a character."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    ends = np.concatenate((starts, [len(data)])).astype(np.int64)
    units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes()))
    return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(starts, offsets).astype(np.int64)), units)


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    cum = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return np.diff(cum[offsets]).astype(np.int64)


def beside(*pieces: pa.Array | str) -> pa.Array:
    """The pieces of each row joined to one string."""
    return pc.binary_join_element_wise(*[pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in pieces], NONE)


def rebuilt(flat: pa.Array, counts: np.ndarray) -> pa.Array:
    """Lists of ``counts`` units each, joined to strings."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), flat), NONE)


def cut(units: pa.LargeListArray, n: np.ndarray, first: np.ndarray, second: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of each list: units before ``first``, before ``second``, and the rest."""
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    starts = pa.array(units.offsets.to_numpy()[:-1])
    ordinal = pc.subtract(pa.array(np.arange(len(flat), dtype=np.int64)), pc.take(starts, parent))
    in_prefix = pc.less(ordinal, pc.take(pa.array(first), parent))
    in_suffix = pc.greater_equal(ordinal, pc.take(pa.array(second), parent))
    in_middle = pc.invert(pc.or_(in_prefix, in_suffix))
    return [rebuilt(pc.filter(flat, role), count) for role, count in ((in_prefix, first), (in_middle, second - first), (in_suffix, n - second))]


def cut_long(data: np.ndarray, first: int, second: int) -> list[pa.Array]:
    """``cut`` of one long text, a segment of ``SLICE`` bytes at a time."""
    parts, done, a = ([], [], []), 0, 0
    while a < len(data):
        b = min(a + SLICE, len(data))
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b += 1
        units = unit_lists(data[a:b], np.array([0, b - a]))
        n = np.array([len(units.values)], dtype=np.int64)
        x, y = (np.clip(np.array([v - done], dtype=np.int64), 0, n) for v in (first, second))
        for got, piece in zip(parts, cut(units, n, x, y)):
            got.append(piece[0].as_py())
        a, done = b, done + int(n[0])
    return [pa.array(["".join(got)], pa.large_string()) for got in parts]


def arranged(texts: pa.Array, hashes: list[np.ndarray], p: Params) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of a batch of texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    data, offsets = utf8(texts)
    n = code_points(data, offsets)
    h1, h2, h3, h4 = hashes
    one, two = h1 % (n + 1), h2 % (n + 1)
    first, second = np.minimum(one, two), np.maximum(one, two)
    plain = pa.array((n == 0) | (h3 % 100 >= p.rate))
    for m in (p.prefix, p.suffix, p.middle):
        plain = pc.or_(plain, pc.match_substring(texts, m))
    late = pa.array(h4 % 100 < p.suffix_first)
    if len(n) == 1 and len(data) > SLICE:
        head, mid, tail = cut_long(data, int(first[0]), int(second[0]))
    else:
        head, mid, tail = cut(unit_lists(data, offsets), n, first, second)
    psm = beside(p.prefix, head, p.suffix, tail, p.middle, mid)
    spm = beside(p.suffix, tail, p.prefix, head, p.middle, mid)
    out = pc.if_else(plain, texts, pc.if_else(late, spm, psm))
    form = pc.if_else(plain, "plain", pc.if_else(late, "spm", "psm"))
    gone = pa.scalar(None, pa.int64())
    return [pa.array(n), form, pc.if_else(plain, gone, pa.array(first)), pc.if_else(plain, gone, pa.array(second - first)), out.cast(pa.string())]


def hashes_of(key: Column, p: Params) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", p: Params = Params()) -> DataFrame:
    """docs without its text, with n, form, prefix_chars, middle_chars (null if plain) and output."""
    kept = [c for c in docs.columns if c != text and c.lower() not in ADDED.names]
    width = len(kept)
    src = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)], *hashes_of(F.col(key), p), text_of(text).alias("t"))
    schema = T.StructType([*src.schema.fields[:width], *ADDED.fields])

    def run(b: pa.RecordBatch, state: dict) -> pa.RecordBatch:
        h = [b.column(width + i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]
        cols = [*b.columns[:width], *arranged(b.column(width + 4), h, p)]
        return pa.RecordBatch.from_arrays(cols, names=schema.names)

    out = src.mapInArrow(over_slices(run, "t", SLICE), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *ADDED.names)


def joined_back(output: pa.Array, form: pa.Array, p: Params) -> pa.Array:
    """The texts from output and form: a cut text holds no mark, so each mark stands once, where its piece starts."""
    output = output.cast(pa.large_string())
    back = output
    for name, order in (("psm", (p.prefix, p.suffix, p.middle)), ("spm", (p.suffix, p.prefix, p.middle))):
        at = np.flatnonzero(pc.equal(form, name).to_numpy(zero_copy_only=False))
        if not len(at):
            continue
        rest, piece = pc.take(output, pa.array(at)), {}
        for here, following in zip(order, (*order[1:], None)):
            rest = pc.utf8_slice_codeunits(rest, len(here))
            if following is None:
                piece[here] = rest
                break
            parts = pc.split_pattern(rest, following, max_splits=1)
            piece[here] = pc.list_element(parts, 0)
            rest = beside(following, pc.list_element(parts, 1))
        whole = beside(piece[p.prefix], piece[p.middle], piece[p.suffix])
        mask = np.zeros(len(output), dtype=bool)
        mask[at] = True
        back = pc.replace_with_mask(back, pa.array(mask), whole)
    return back.cast(pa.string())


def restore(cut_docs: DataFrame, out: str = "restored", p: Params = Params()) -> DataFrame:
    """The rows of ``transform`` with the text rebuilt from output and form alone."""
    cols = [c for c in cut_docs.columns if c.lower() != out.lower()]
    src = cut_docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)])
    o, f = f"c{cols.index('output')}", f"c{cols.index('form')}"
    schema = T.StructType([*src.schema.fields, T.StructField("back", T.StringType())])

    def run(b: pa.RecordBatch, state: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, joined_back(b.column(o), b.column(f), p)], names=schema.names)

    return src.mapInArrow(over_slices(run, o, SLICE), schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)], F.col("back").alias(out))

