"""WARC archives with a two-level capture index.

Writing: every task writes one gzip-per-record archive file of its own name to
the shared folder and returns a row per record. Only files whose rows a
finished task returned count, so a lost or repeated task leaves no trace but an
unread file.

Index: records are sorted by reversed-host URL key (then page_id) into runs; a
run is written as gzip blocks of some thousand lines, and each run has a sparse
directory with the first key of every block. A lookup finds its run among the
runs' first keys, searches the run's directory, range-reads one block, searches
that, and range-reads the record. Runs hold a bounded number of rows and are the
unit of work, and page_id in the key splits even a host with a third of all pages.

Files are opened by URI through pyarrow, so the shared folder can be any store
it knows.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import new_path, stage
from .common import partitions

MIN_PAYLOAD = 100
BLOCK_LINES = 1000
FEW_ORIGINALS = 200_000  # more are joined by shuffle
NAMESPACE = 0x6F1D3C5A9B7E4D21  # upper half of a record's UUID; the lower half is page_id
_ENTRY = "key string, page_id bigint, file string, offset bigint, length bigint"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: 'http://a.example.org/x' is 'org,example,a)/x'."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:  # not a URL
        return "-)" + url.strip().replace("\n", "%0A")
    where = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return (where + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).replace("\n", "%0A")


def capture_key(url: str | None, page_id: int | None) -> str:
    """URL key and a page_id that sorts as its number; null comes last."""
    return f"{url_key(url)} {'~' if page_id is None else format(page_id + (1 << 63), '016x')}"


def record_id(page_id: int | None) -> str:
    low = "null" if page_id is None else str(uuid.UUID(int=(NAMESPACE << 64) | (page_id + (1 << 63))))
    return f"<urn:uuid:{low}>"


def page_of(record: str) -> int | None:
    low = record.removeprefix("<urn:uuid:").removesuffix(">")
    return None if low == "null" else (uuid.UUID(low).int & ((1 << 64) - 1)) - (1 << 63)


def pack_record(page_id, url, payload: bytes, digest: str, refers_to, refers_url) -> bytes:
    revisit = refers_to is not None
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Refers-To-Target-URI: " + (refers_url or "").replace("\r", "%0D").replace("\n", "%0A"),
        ]
    block = b"" if revisit else payload
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = gzip.decompress(raw).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[:int(fields["Content-Length"])]


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


def _create(uri: str):
    fs, path = _open(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(path, compression=None)  # the default packs by file name


class Ranges:
    """Range reads over a few files that stay open."""

    def __init__(self, most: int = 64):
        self.files: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.most = most

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri not in self.files:
            fs, path = _open(uri)
            self.files[uri] = fs.open_input_file(path)
            if len(self.files) > self.most:
                self.files.popitem(last=False)[1].close()
        self.files.move_to_end(uri)
        return self.files[uri].read_at(length, offset)


def with_originals(pages: DataFrame) -> DataFrame:
    """Adds payload, digest, and for revisits refers_to and refers_url.

    Of equal payloads of at least 100 bytes the smallest page_id is the
    response. Null page_ids revisit it too; if all are null, all are responses.
    """
    full = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    full = full.withColumn("digest", F.sha2("payload", 256))
    big = full.filter(F.octet_length("payload") >= MIN_PAYLOAD)
    first = big.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 and refers_to is not null")
    urls = big.select(F.col("digest").alias("_d"), F.col("page_id").alias("_p"), F.col("url").alias("_u"))
    first = stage(
        first.join(urls, (first.digest == F.col("_d")) & (first.refers_to == F.col("_p"))).groupBy("digest", "refers_to").agg(F.min("_u").alias("refers_url")),
        "warc-originals")
    few = first.count() <= FEW_ORIGINALS
    joined = full.join(F.broadcast(first) if few else first, "digest", "left")
    own = F.col("page_id").eqNullSafe(F.col("refers_to"))
    return joined.withColumns({
        "refers_url": F.when(~own, F.col("refers_url")), "refers_to": F.when(~own, F.col("refers_to")),
    })


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Writes the archives; returns (key, page_id, file, offset, length), a row per record."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sink, at = f"{path}/archive/{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    if sink is None:
                        sink = _create(name)
                    raw = pack_record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], row["refers_url"])
                    sink.write(raw)
                    out.append((capture_key(row["url"], row["page_id"]), row["page_id"], name, at, len(raw)))
                    at += len(raw)
                if out:
                    yield _table(out)
        finally:
            if sink is not None:
                sink.close()

    rows = with_originals(pages).select("page_id", "url", "payload", "digest", "refers_to", "refers_url")
    return stage(rows.mapInArrow(write, _ENTRY), "warc-entries")


def _table(rows) -> pa.RecordBatch:
    key, page, file, offset, length = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(page, pa.int64()), pa.array(file), pa.array(offset, pa.int64()), pa.array(length, pa.int64())],
        ["key", "page_id", "file", "offset", "length"])


def write_index(entries: DataFrame, path: str) -> DataFrame:
    """Sorts entries into runs of compressed blocks; returns (first_key, run, directory), a row per run."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = f"{path}/index/{uuid.uuid4().hex}"
        sink, at, waiting, directory, first = None, 0, [], [], None

        def flush():
            nonlocal at
            raw = gzip.compress("\n".join(json.dumps(x) for x in waiting).encode(), 6, mtime=0)
            sink.write(raw)
            directory.append((waiting[0][0], at, len(raw)))
            at += len(raw)
            waiting.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    sink, first = _create(f"{run}.cdx.gz"), row["key"]
                waiting.append((row["key"], row["file"], row["offset"], row["length"]))
                if len(waiting) == BLOCK_LINES:
                    flush()
        if sink is not None:
            if waiting:
                flush()
            sink.close()
            with _create(f"{run}.dir.gz") as d:
                d.write(gzip.compress(json.dumps(directory).encode(), 6, mtime=0))
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([run])], ["first_key", "run"])

    order = ["key", "file", "offset"]
    runs = entries.repartitionByRange(partitions(entries.sparkSession), *order).sortWithinPartitions(*order)
    return stage(runs.mapInArrow(write, "first_key string, run string"), "warc-runs")


class RunReader:
    """Lookups in one run: directory in memory, the block last read kept."""

    def __init__(self, run: str, ranges: Ranges):
        self.run, self.ranges, self.at, self.lines = run, ranges, None, []
        fs, path = _open(f"{run}.dir.gz")
        with fs.open_input_stream(path, compression=None) as f:
            self.directory = json.loads(gzip.decompress(f.read()))
        self.firsts = [d[0] for d in self.directory]

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of every record with the key; equal keys may go on over several blocks."""
        i = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.directory) and self.firsts[i] <= key:
            if self.at != i:
                _, offset, length = self.directory[i]
                self.lines = json.loads(b"[" + gzip.decompress(self.ranges.read(f"{self.run}.cdx.gz", offset, length)).replace(b"\n", b",") + b"]")
                self.at = i
            for line in self.lines[bisect.bisect_left(self.lines, [key]):]:
                if line[0] != key:
                    break
                yield line[1], line[2], line[3]
            i += 1


def lookup(captures: DataFrame, runs: DataFrame) -> DataFrame:
    """Reads the records of the captures asked for, (url, page_id), through the index.

    Returns (page_id, url, payload_bytes, payload_digest, record_type,
    refers_to), a row per record found. Length and digest are taken from the
    payload itself; a revisit's from the record it refers to, again through the
    index, and checked against its own header. The list of runs has one row per
    partition of the index, and goes to every task.
    """
    listed = sorted(((r["first_key"], r["run"]) for r in runs.collect()))
    firsts, names = [f for f, _ in listed], [r for _, r in listed]

    def runs_for(key: str) -> Iterator[str]:
        i = max(0, bisect.bisect_left(firsts, key) - 1)
        while i < len(firsts) and firsts[i] <= key:
            yield names[i]
            i += 1

    def keyed(batches):
        for batch in batches:
            keys = [capture_key(u, p) for u, p in zip(batch.column("url").to_pylist(), batch.column("page_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], ["key"])

    def read(batches):
        ranges, readers, known = Ranges(), OrderedDict(), OrderedDict()

        def find(key):
            for run in runs_for(key):
                if run not in readers:
                    readers[run] = RunReader(run, ranges)
                    if len(readers) > 8:
                        readers.popitem(last=False)
                readers.move_to_end(run)
                yield from readers[run].find(key)

        def original(url, page):
            """(bytes, digest) of a response that is referred to; the latest few are kept."""
            key = capture_key(url, page)
            if key not in known:
                for file, offset, length in find(key):
                    fields, payload = parse_record(ranges.read(file, offset, length))
                    if fields["WARC-Type"] == "response":
                        known[key] = (len(payload), hashlib.sha256(payload).hexdigest())
                        break
                else:
                    raise ValueError(f"no response record for {key}")
                if len(known) > 10_000:
                    known.popitem(last=False)
            return known[key]

        for batch in batches:
            out = []
            for key in batch.column("key").to_pylist():
                for file, offset, length in sorted(find(key)):
                    fields, payload = parse_record(ranges.read(file, offset, length))
                    refers = None
                    if fields["WARC-Type"] == "revisit":
                        refers = page_of(fields["WARC-Refers-To"])
                        size, digest = original(fields["WARC-Refers-To-Target-URI"], refers)
                    else:
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    if fields["WARC-Payload-Digest"] != f"sha256:{digest}":
                        raise ValueError(f"payload of {key} does not match its digest")
                    out.append((page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], refers))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                    ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # Sorted keys make neighbouring lookups share a block and a file.
    keys = captures.select("url", "page_id").mapInArrow(keyed, "key string").distinct()
    spread = keys.repartitionByRange(partitions(captures.sparkSession), "key").sortWithinPartitions("key")
    return spread.mapInArrow(
        read, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archives all pages, indexes them and reads every record back through the index.

    Nulls: null html is an empty payload; null url has the key '-'; null page_id
    comes back as null. Whole repeated rows give a record each. Empty input
    writes nothing and gives no rows. A very long page is a record of its own
    block; of equal payloads the smallest page_id is the response. No other
    column is read.
    """
    path = new_path(spark, "warc")
    runs = write_index(write_archives(pages, path), path)
    return lookup(pages, runs)
