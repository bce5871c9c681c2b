"""Operator 2: WARC archives and an external index merge.

Each task writes an archive (one gzip member a record).  Of records with equal payloads of at least
`least_bytes` bytes the one with the smallest id is a response, the others revisit it.  The archives are read
back record by record; what is read forms capture runs, sorted by URL key, timestamp and id and written as
Arrow files.  Runs are merged k ways by a loser tree, in passes of `fan_in` runs, the last pass in parallel
over ranges of the key: its partitions, in order, are the globally ordered capture history.  No sort of all
captures and no shuffle of them takes place.

Defined cases: null html is an empty payload; a null URL has the empty key and no target header; a null id is
never the smallest of its group and refers by the group's smallest id; rows that repeat the smallest id are all
responses; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, shared_path, slices, stored, utf8
from .files import create, open_random, open_stream

CAPTURE = pa.schema([("url_key", pa.string()), ("captured_at", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("archive", pa.string()),
                     ("offset", pa.int64()), ("length", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64())])
CAPTURE_SQL = ("url_key string, captured_at string, page_id long, url string, archive string, offset long, length long, "
               "payload_bytes long, payload_digest string, record_type string, refers_to long")
RUN_ROWS, BLOCK_ROWS, RANGE_ROWS, FAN_IN = 100_000, 2048, 50_000, 64
DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels from the top down, then path and query, lower-cased."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").removeprefix("www.")
        port = f":{u.port}" if u.port and (u.scheme, u.port) not in (("http", 80), ("https", 443)) else ""
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    return f"{','.join(reversed(host.split('.')))}{port}){(u.path or '/').lower()}{'?' + u.query.lower() if u.query else ''}"


def _name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _number(name: str):
    n = name[len("<urn:page:"):-1]
    return int(n) if n else None


def record(page_id, url, date: str, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:  # white space and control characters can't stand in a header
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" and not c.isspace() else quote(c) for c in url))
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict, bytes]:
    cut = raw.index(b"\r\n\r\n")
    lines = raw[:cut].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(head["Content-Length"])
    if len(raw) != cut + 4 + n + 4:
        raise ValueError("WARC record has another length than its header says")
    return head, raw[cut + 4:cut + 4 + n]


def members(stream, size: int = 1 << 20):
    """(offset, length, data) of each gzip member of a stream."""
    held, start = b"", 0
    while True:
        d, parts, used = zlib.decompressobj(31), [], 0
        while not d.eof:
            if not held:
                held = stream.read(size)
                if not held:
                    if used:
                        raise ValueError("archive is cut short")
                    return
            parts.append(d.decompress(held))
            used += len(held) - len(d.unused_data)
            held = d.unused_data
        yield start, used, b"".join(parts)
        start += used


def _write(folder: str):
    def run(batches):
        part, out, n, at = TaskContext.get().partitionId(), None, 0, 0
        for b in batches:
            for s in slices(b, "payload"):
                if out is None:
                    name, out = create(folder, f"pages-{part:06d}", ".warc.gz")
                for r in s.to_pylist():
                    data = gzip.compress(record(r["page_id"], r["url"], r["captured_at"], r["payload"], r["digest"], r["low"], r["revisit"]), 1, mtime=0)
                    out.write(data)
                    n, at = n + 1, at + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"archive": name, "records": n, "bytes": at}], schema=pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))
    return run


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None,
          least_bytes: int = 100, folder: str | None = None) -> DataFrame:
    """Write every row as a record; returns the table of archives (archive, records, bytes)."""
    x = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                     (F.date_format(date_col, "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_col else F.lit(DATE)).alias("captured_at"), utf8(html_col).alias("payload"))
    x = x.withColumn("digest", F.sha2("payload", 256))
    x = x.withColumn("same", F.when(F.octet_length("payload") >= least_bytes, F.col("digest")))
    low = (x.filter(F.col("same").isNotNull()).groupBy("same").agg(F.min("page_id").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    x = attach(x, stored(low, "payloads"), "same")
    x = x.withColumn("revisit", F.col("low").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("low"))).drop("same")
    folder = folder or shared_path(pages.sparkSession, "warc")
    return stored(x.mapInArrow(_write(folder), "archive string, records long, bytes long"), "archives")


def captures(archive: str):
    """The captures of an archive, from its records; a payload that isn't its digest is an error."""
    with open_stream(archive) as s:
        for offset, length, raw in members(s):
            h, block = parse(raw)
            digest, revisit = h["WARC-Payload-Digest"].removeprefix("sha256:"), h["WARC-Type"] == "revisit"
            if not revisit and (hashlib.sha256(block).hexdigest() != digest or len(block) != int(h["X-Payload-Length"])):
                raise ValueError("payload and digest differ")
            url = h.get("WARC-Target-URI")
            yield (url_key(url), h["WARC-Date"], _number(h["WARC-Record-ID"]), url, archive, offset, length,
                   int(h["X-Payload-Length"]) if revisit else len(block), digest, h["WARC-Type"], _number(h["WARC-Refers-To"]) if revisit else None)


def order(c) -> tuple:
    return c[0], c[1], c[2] is not None, c[2] or 0, c[4], c[5]


def _table(rows):
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), CAPTURE)], schema=CAPTURE)


def write_run(rows, folder: str) -> tuple[str, int]:
    """Sorted captures as blocks of an Arrow file."""
    name, out = create(folder, "run", ".arrow")
    n, block = 0, []
    with pa.ipc.new_file(out, CAPTURE) as w:
        for r in rows:
            block.append(r)
            n += 1
            if len(block) == BLOCK_ROWS:
                w.write_batch(_table(block))
                block = []
        if block:
            w.write_batch(_table(block))
    out.close()
    return name, n


def _rows(batch):
    return list(zip(*(c.to_pylist() for c in batch.columns)))


def cursor(run: str, low=None, high=None):
    """A run's captures from `low` (included) to `high` (not), found by bisecting its blocks."""
    with open_random(run) as f:
        file = pa.ipc.open_file(f)
        a, b = 0, file.num_record_batches
        while low is not None and b - a > 1:
            mid = (a + b) // 2
            first = tuple(c[0].as_py() for c in file.get_batch(mid).columns)
            a, b = (mid, b) if order(first) < low else (a, mid)
        for i in range(a, file.num_record_batches):
            for r in _rows(file.get_batch(i)):
                k = order(r)
                if low is not None and k < low:
                    continue
                if high is not None and k >= high:
                    return
                yield k, r


class LoserTree:
    """k-way merge of sorted iterators of (key, row): each step replays one path of the tree."""

    def __init__(self, sources):
        self.sources = [iter(s) for s in sources]
        self.k = max(1, len(self.sources))
        self.head = [next(s, None) for s in self.sources] or [None]
        self.loser = [-1] * self.k
        self.winner = self._build(1) if self.k > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return x is not None
        return x[0] < y[0] if x[0] != y[0] else a < b

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._less(a, b) else (b, a)
        self.loser[node] = lose
        return win

    def __iter__(self):
        while self.head[self.winner] is not None:
            yield self.head[self.winner][1]
            w = self.winner
            self.head[w] = next(self.sources[w], None)
            node = (w + self.k) // 2
            while node:
                if self._less(self.loser[node], w):
                    self.loser[node], w = w, self.loser[node]
                node //= 2
            self.winner = w


def _index(folder: str):
    def run(batches):
        for b in batches:
            for a in b.column("archive").to_pylist():
                held = []
                for c in captures(a):
                    held.append(c)
                    if len(held) == RUN_ROWS:
                        yield _run_row(*write_run(sorted(held, key=order), folder))
                        held = []
                if held:
                    yield _run_row(*write_run(sorted(held, key=order), folder))
    return run


def _run_row(name, n):
    return pa.RecordBatch.from_pylist([{"run": name, "n": n}], schema=pa.schema([("run", pa.string()), ("n", pa.int64())]))


def _merge_group(folder: str):
    def run(batches):
        for b in batches:
            for runs in b.column("runs").to_pylist():
                yield _run_row(*write_run(LoserTree([cursor(r) for r in runs]), folder))
    return run


def _firsts(batches):
    """The first capture of each block of a run: the sample that ranges are cut by."""
    for b in batches:
        for run in b.column("run").to_pylist():
            with open_random(run) as f:
                file = pa.ipc.open_file(f)
                rows = [tuple(c[0].as_py() for c in file.get_batch(i).columns) for i in range(file.num_record_batches)]
            if rows:
                yield _table(rows)


def _lowest(batches):
    low = None
    for b in batches:
        for r in _rows(b):
            low = r if low is None or order(r) < order(low) else low
    if low is not None:
        yield _table([low])


def _merge_range(runs: list[str]):
    def run(batches):
        for b in batches:
            for low, high in zip(b.column("low").to_pylist(), b.column("high").to_pylist()):
                low, high = (None if x is None else order(tuple(x.values())) for x in (low, high))
                block = []
                for r in LoserTree([cursor(x, low, high) for x in runs]):
                    block.append(r)
                    if len(block) == 10_000:
                        yield _table(block)
                        block = []
                if block:
                    yield _table(block)
    return run


def history(archives: DataFrame, folder: str | None = None, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures read back from the archives, ordered by URL key, timestamp and id over the partitions."""
    spark = archives.sparkSession
    folder = folder or shared_path(spark, "runs")
    files = archives.select("archive")
    runs = stored(files.repartition(max(1, files.count()), "archive").mapInArrow(_index(folder), "run string, n long"), "run-list")
    while (k := runs.count()) > fan_in:
        groups = -(-k // fan_in)
        grouped = (runs.withColumn("g", F.pmod(F.row_number().over(_by_run()), F.lit(groups))).groupBy("g").agg(F.collect_list("run").alias("runs")))
        runs = stored(grouped.repartition(groups, "g").mapInArrow(_merge_group(folder), "run string, n long"), "run-list")
    names = sorted(r["run"] for r in runs.collect())  # at most fan_in names
    ranges = max(1, -(-(runs.agg(F.sum("n")).first()[0] or 0) // range_rows))
    firsts = runs.select("run").repartition(max(1, len(names))).mapInArrow(_firsts, CAPTURE_SQL)
    lows = (firsts.repartitionByRange(ranges, "url_key", "captured_at", F.col("page_id").isNotNull(), F.coalesce("page_id", F.lit(0)), "archive", "offset")
            .mapInArrow(_lowest, CAPTURE_SQL).collect())  # one row a range
    lows = sorted((tuple(r) for r in lows), key=order)[1:]
    cuts = [(i, a, b) for i, (a, b) in enumerate(zip([None, *lows], [*lows, None]))]
    x = spark.createDataFrame(cuts, f"i int, low struct<{_struct()}>, high struct<{_struct()}>")
    return x.repartitionByRange(len(cuts), "i").mapInArrow(_merge_range(names), CAPTURE_SQL)


def _by_run():
    from pyspark.sql import Window
    return Window.orderBy("run")  # the list of runs, not of captures


def _struct() -> str:
    return CAPTURE_SQL.replace(" ", ":").replace(",:", ",")
