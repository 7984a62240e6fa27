"""WARC archives with revisits, and their capture index by external merging.

Writing. Payloads are digested in the JVM; per digest of payloads of at least `LEAST` bytes the largest page id is
the response, others are revisits of it. Each task writes one archive (a gzip member a record) and, as its rows, a
run: its captures sorted by URL key and time. Runs are files of the shared folder.

Index. Runs are merged by loser trees of at most `FAN_IN` runs: first groups of runs into longer runs, as long as
there are more; then all remaining runs by ranges of the key, a task a range, each reading only the row groups that
its range meets. The files of the result, in order, are one globally ordered capture history. Ranges are cut at
sampled whole keys (URL key, time, archive, place), so the captures of one hot URL are spread over ranges too; they
hold about `RANGE` captures or `BYTES` of records at most.

Reading follows the history: a task reads a range in the order of the merged index, which it checks as it goes;
records are found by the index, checked against their digest, and parsed.

Edge cases: a null payload is empty; a null url has the empty key and no target; a null page id gives a record
without one (its payload is the response only if no equal payload has an id); rows with equal ids and payloads are
alike, so if theirs is the largest id all of them are responses; an empty table gives an empty result; extra
columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import accumulate
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, prepare, sampled, save, table

LEAST = 1000
FAN_IN = 64
#: Captures in a range of the merged index, and bytes of their records, about.
RANGE, BYTES = 200_000, 32 << 20
#: Archives that a reading task keeps open.
OPEN = 64
#: Rows of the duplicates' table up to which it is broadcast.
SMALL = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY = ("url_key", "captured", "archive", "place")


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def url_key(url: str | None) -> str:
    """Host parts reversed, then port, path and query, lower-cased; no scheme, www. or fragment."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or ""), u.port
    except ValueError:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")
    return key.lower()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, captured: int, refers_to: int | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, whose Content-Length is the payload's, and no payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = f"urn:page:{page_id}" if page_id is not None else uuid.uuid4().urn
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {datetime.fromtimestamp(captured, timezone.utc):%Y-%m-%dT%H:%M:%SZ}"]
    if url:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode())
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's header fields (lower-case names) and block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def decided(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, captured) with sha1, bytes and refers_to (null: a response)."""
    x = pages.withColumn("sha1", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("bigint"))
    slim = x.select("page_id", "sha1", "bytes").filter(F.col("bytes") >= LEAST)
    again = slim.groupBy("sha1", "bytes").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = save(again.select(F.col("sha1").alias("sha1_"), F.col("bytes").alias("bytes_"), "last"), "again")
    again = F.broadcast(again) if again.count() <= SMALL else again.hint("shuffle_hash")
    x = x.join(again, (F.col("sha1") == F.col("sha1_")) & (F.col("bytes") == F.col("bytes_")), "left")
    return x.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))).drop("sha1_", "bytes_", "last")


RUN = pa.schema([("url_key", pa.string()), ("captured", pa.int64()), ("archive", pa.string()), ("place", pa.int64()), ("size", pa.int64()), ("page_id", pa.int64()), ("sha1", pa.string()), ("record_type", pa.string())])
RUN_SPARK = "url_key string, captured bigint, archive string, place bigint, size bigint, page_id bigint, sha1 string, record_type string"


def _key(r: tuple) -> tuple:
    return r[0].encode(), r[1], r[2], r[3]


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives of pages (page_id, url, payload, captured) and returns the runs; each file of it is sorted."""
    prepare(pages.sparkSession)

    def run(batches):
        fs, root = _fs(folder)
        rows: list[tuple] = []
        name = f"{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        for b in batches:
            for page, url, payload, captured, sha1, _, refers in zip(*(c for c in b.columns)):
                page, url, captured, sha1, refers = (x.as_py() for x in (page, url, captured, sha1, refers))
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                z = zlib.compressobj(3, zlib.DEFLATED, 31)
                data = z.compress(record(page, url, payload.as_py().encode(), sha1, captured, refers)) + z.flush()
                out.write(data)
                rows.append((url_key(url), captured, name, at, len(data), page, sha1, "response" if refers is None else "revisit"))
                at += len(data)
        if out is not None:
            out.close()
            rows.sort(key=_key)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RUN)], schema=RUN)

    cols = ["page_id", "url", "payload", "captured", "sha1", "bytes", "refers_to"]
    path = new_path(pages.sparkSession, "runs")
    decided(pages).select(*cols).mapInArrow(run, RUN_SPARK).write.option("parquet.block.size", 1 << 20).parquet(path)
    return pages.sparkSession.read.schema(RUN_SPARK).parquet(path)


class LoserTree:
    """Merges sorted iterators: inner nodes hold the losers, the winner comes out, and one path is replayed."""

    def __init__(self, sources: list[Iterator[tuple]], key):
        self.key, self.sources, k = key, sources, len(sources)
        self.now: list = [None] * k  # by source its next item with the key; None: over
        for i in range(k):
            self._advance(i)
        self.tree = [-1] * k  # losers; place 0 has the winner
        for i in range(k):
            self._replay(i)

    def _advance(self, i: int) -> None:
        x = next(self.sources[i], None)
        self.now[i] = None if x is None else (self.key(x), i, x)

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.now[i], self.now[j]
        return b is None or a is not None and a[:2] < b[:2]

    def _replay(self, i: int) -> None:
        node = (i + len(self.sources)) // 2
        while node:
            j = self.tree[node]
            if j < 0:  # while the tree is built: wait for the other side
                self.tree[node] = i
                return
            if self._beats(j, i):
                self.tree[node], i = i, j
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while self.sources and (x := self.now[w := self.tree[0]]) is not None:
            yield x[2]
            self._advance(w)
            self._replay(w)


def _slice(path: str, lo: tuple | None, hi: tuple | None) -> Iterator[tuple]:
    """The rows of a run from lo (included) to hi (excluded); only row groups that can have them are read."""
    import pyarrow.parquet as pq

    fs, p = _fs(path)
    with fs.open_input_file(p) as f:
        file = pq.ParquetFile(f)
        for g in range(file.num_row_groups):
            s = file.metadata.row_group(g).column(0).statistics
            if s is not None and s.has_min_max and (lo is not None and s.max.encode() < lo[0] or hi is not None and s.min.encode() > hi[0]):
                continue
            for b in file.iter_batches(4096, row_groups=[g], columns=RUN.names):
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    k = _key(row)
                    if lo is not None and k < lo:
                        continue
                    if hi is not None and k >= hi:
                        return
                    yield row


def _merged(spark: SparkSession, jobs: list[tuple[list[str], tuple | None, tuple | None]], name: str) -> str:
    """Merges each job's runs, a task and a file a job."""

    def run(batches):
        for b in batches:
            for j in b.column(0).to_pylist():
                files, lo, hi = jobs[j]
                rows: list[tuple] = []
                for n, row in enumerate(LoserTree([_slice(f, lo, hi) for f in files], _key)):
                    rows.append((*row, j, n))
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    schema = RUN.append(pa.field("part", pa.int64())).append(pa.field("n", pa.int64()))

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    path = new_path(spark, name)
    todo = spark.range(0, len(jobs), 1, len(jobs))
    todo.mapInArrow(run, RUN_SPARK + ", part bigint, n bigint").write.option("parquet.block.size", 1 << 20).parquet(path)
    return path


def _files(df: DataFrame) -> list[str]:
    return sorted(f.replace("file:///", "file:/", 1).replace("file:/", "file:///", 1) for f in df.inputFiles())


def merge_index(runs: DataFrame) -> DataFrame:
    """Runs, each file sorted, to the capture history: sorted by (part, n), which is globally ordered by KEY."""
    spark = runs.sparkSession
    prepare(spark)
    files = _files(runs)
    while len(files) > FAN_IN:
        path = _merged(spark, [(files[i : i + FAN_IN], None, None) for i in range(0, len(files), FAN_IN)], "longer-runs")
        files = _files(spark.read.parquet(path))
    count, size = runs.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(1, -(-count // RANGE), -(-size // BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // 2000)))
    sample = sampled(runs.select(*KEY, "size"), 20_000, count, *KEY).collect()
    sample = sorted((_key(tuple(r)), r["size"]) for r in sample)
    # Cut where both the captures and their bytes so far have grown by a part's share of either.
    whole = max(1, sum(n for _, n in sample))
    weight = list(accumulate(1 / len(sample) + n / whole for _, n in sample))
    cuts = sorted({sample[bisect_left(weight, weight[-1] * k / parts)][0] for k in range(1, parts)}) if sample else []
    jobs = [(files, lo, hi) for lo, hi in zip([None, *cuts], [*cuts, None])]
    path = _merged(spark, jobs, "index")
    return spark.read.schema(RUN_SPARK + ", part bigint, n bigint").parquet(path)


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records that the merged index lists, by its ranges and in its order: part, n, page_id, payload_bytes,
    payload_digest, record_type, refers_to. A range out of order is an error."""
    prepare(index.sparkSession)
    schema = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def page(name: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
        return int(m[1]) if m else None

    def run(batches):
        fs, root = _fs(folder)
        files: OrderedDict = OrderedDict()

        def archive(name: str):
            if name not in files:
                if len(files) >= OPEN:
                    files.popitem(last=False)[1].close()
                files[name] = fs.open_input_file(f"{root}/{name}")
            files.move_to_end(name)
            return files[name]

        before: tuple = ()
        for b in batches:
            rows = []
            for part, n, *key, size in zip(*(c.to_pylist() for c in b.columns)):
                now = (part, _key(tuple(key)))
                if before and before[0] == part and before[1] > now[1]:
                    raise ValueError(f"the index is out of order in range {part} at {n}")
                before = now
                name, place = key[2:]
                f = archive(name)
                f.seek(place)
                fields, block = parse(zlib.decompress(f.read(size), 31))
                head, _, payload = block.partition(b"\r\n\r\n")
                length = int(re.search(rb"(?mi)^content-length:\s*(\d+)", head)[1])
                digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                kind = fields["warc-type"]
                if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"{name} at {place}: the payload doesn't match its digest")
                rows.append((part, n, page(fields["warc-record-id"]), length, digest, kind, page(fields.get("warc-refers-to"))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), schema)], schema=schema)
        for f in files.values():
            f.close()

    # A task a range: adaptive execution would coalesce them by the slim index's bytes.
    parts = (index.agg(F.max("part")).first()[0] or 0) + 1
    x = index.select("part", "n", *KEY, "size").repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "n")
    return x.mapInArrow(run, "part bigint, n bigint, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    # The table has no time of capture: one second a page from 2020 on.
    captured = F.coalesce(F.pmod(F.col("page_id").cast("bigint"), F.lit(1 << 31)), F.lit(0)) + F.lit(1577836800)
    folder = new_path(spark, "archives")
    runs = write(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"), captured.alias("captured")), folder)
    return read(merge_index(runs), folder).drop("part", "n")


SQL = r"""
SELECT page_id::BIGINT AS page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last THEN last END::BIGINT AS refers_to
FROM (
  SELECT page_id, strlen(h) AS n, sha1(h) AS digest, max(page_id) OVER (PARTITION BY h) AS last
  FROM (SELECT page_id, coalesce(html, '') AS h FROM pages)
)
"""
