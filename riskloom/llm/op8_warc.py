"""WARC archives with an external index merge.

Every page becomes a record of a gzipped WARC file, one file a task. Of records
with equal payloads the one with the largest page_id is a response and the others
revisit it. Each task also leaves its captures as runs sorted by URL key and
timestamp; ranges of the key space are then merged k ways by a loser tree, which
gives capture histories in global order and every capture its rank in it. The archives
are read back through that index, file by file, and the records are put in the order of
the ranks.

Cases: null html is an empty payload; a null url gives an empty URL key; pages
with a null page_id are written as responses of their own, for no revisit could
name them; a repeated page_id gives a record for each row; of equal
payloads the largest page_id wins ties by being largest, and rows that tie on it are
responses each; very long payloads are written and read whole, one record at a time beside
the batch that Spark hands over and, if payloads are asked for, some SEND bytes of them;
an empty table writes no archive; further columns are ignored, whatever their names."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialise, open_fs, qualified

RUN, SEND = 20_000, 8_000_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, then path and query, lower case,
    without scheme, leading www and fragment."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", (url or "").strip().lower())
    if not m:
        return (url or "").strip().lower()
    host = re.sub(r"^www\d*\.", "", m[1])
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")


def timestamp14(page_id: int | None) -> str:
    """The capture time of tables that have none: page_id seconds after 2000-01-01."""
    at = pd.Timestamp("2000-01-01") + pd.Timedelta(seconds=(page_id or 0) % 3_000_000_000)
    return at.strftime("%Y%m%d%H%M%S")


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, stamp: str) -> bytes:
    """One gzip member. Both kinds state the payload's digest and size; a revisit leaves the payload out."""
    iso = f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:]}Z"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    clean = re.sub(r"[\x00-\x20]", "", url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {iso}", f"WARC-Target-URI: {clean}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=5, mtime=0) as z:
        z.write("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n")
    return out.getvalue()


def parse(member: bytes) -> dict:
    """The record's headers and payload; the digest of a response is taken from its bytes."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
    refers = fields.get("WARC-Refers-To")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"record {page}: the payload differs from its headers")
    return {
        "page_id": None if page == "null" else int(page), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": int(refers[len("<urn:page:") : -1]) if refers else None, "payload": payload,
    }


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class LoserTree:
    """Merges k sorted runs: each inner node keeps the loser of its match, so the
    next row costs one path to the root."""

    def __init__(self, runs: list[Iterable], key):
        self.its, self.key = [iter(r) for r in runs], key
        self.k = max(1, len(self.its))
        self.rows = [next(it, None) for it in self.its] + [None] * (not self.its)
        self.tree = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.rows[a], self.rows[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (self.key(x), a) < (self.key(y), b)

    def _play(self, leaf: int) -> None:
        node, winner = (leaf + self.k) // 2, leaf
        while node > 0:
            if self.tree[node] == -1:
                self.tree[node] = winner
                return
            if self._before(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while (row := self.rows[w := max(0, self.tree[0])]) is not None:
            yield row
            self.rows[w] = next(self.its[w], None)
            self._play(w)


def assign(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages with key (SHA-256 of the payload) and refers_to. Winners are found by
    partial maxima; the join on the key leaves large groups to be split at run time."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html")).withColumn("key", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    shared = rows.where((F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("key").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(shared, "key", "left")
    return joined.select("page_id", "url", "html", F.when(F.col("page_id") < F.col("winner"), F.col("winner")).alias("refers_to"))


def table_of(captures: list[tuple]) -> pd.DataFrame:
    """Captures as columns; ids stay whole numbers beside nulls."""
    key, stamp, page, file, offset, length = zip(*captures)
    return pd.DataFrame({"url_key": key, "stamp": stamp, "page_id": pd.array(page, dtype="Int64"), "file": file, "offset": offset, "length": length})


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes the archives; the result holds the captures in sorted runs:
    (run, nth, url_key, stamp, page_id, file, offset, length), in written form."""
    schema = "run string, nth long, url_key string, stamp string, page_id long, file string, offset long, length long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at, run, held = None, f"part-{uuid.uuid4().hex}.warc.gz", 0, 0, []
        fs, root = open_fs(folder)

        def runs() -> pa.RecordBatch:
            held.sort(key=lambda r: (r[0], r[1], r[3], r[4]))
            key, stamp, page, file, offset, length = zip(*held)
            columns = [pa.array([f"{name}/{run}"] * len(held)), pa.array(range(len(held)), pa.int64()), pa.array(key), pa.array(stamp), pa.array(page, pa.int64()), pa.array(file), pa.array(offset, pa.int64()), pa.array(length, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

        for b in batches:
            for k in range(b.num_rows):
                page, url, html, refers = (b.column(c)[k].as_py() for c in range(4))
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                payload, stamp = html.encode("utf-8", "surrogatepass"), timestamp14(page)
                raw = record(page, url, payload, base32_sha1(payload), refers, stamp)
                out.write(raw)
                held.append((url_key(url), stamp, page, f"{folder}/{name}", at, len(raw)))
                at += len(raw)
                if len(held) >= RUN:
                    yield runs()
                    run, held = run + 1, []
        if out is not None:
            out.close()
        if held:
            yield runs()

    return materialise(records.select("page_id", "url", "html", "refers_to").mapInArrow(write, schema), "cdx-runs")


def merge_index(runs: DataFrame) -> DataFrame:
    """Capture histories in global order: ranges of (url_key, stamp, page_id), each
    merged from the slices of the runs that fall in it. `rank` is the range's number and
    the place in it, so it grows along the whole order."""
    names = ["url_key", "stamp", "page_id", "file", "offset", "length"]

    def rows_of(parts: list[pd.DataFrame]) -> Iterator[tuple]:
        while parts:  # a part is dropped as soon as its rows are out
            for key, stamp, page, *row in parts.pop(0)[names].itertuples(index=False, name=None):
                yield key, stamp, None if pd.isna(page) else int(page), *row

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        rank = TaskContext.get().partitionId() << 40
        slices: dict[str, list[pd.DataFrame]] = {}
        for b in batches:
            for run, part in b.groupby("run", sort=False):
                slices.setdefault(run, []).append(part)
        merged = LoserTree([rows_of(parts) for parts in slices.values()], key=lambda r: (r[0], r[1], r[3], r[4]))
        rows: list[tuple] = []
        for row in merged:
            rows.append(row)
            if len(rows) >= 10_000:
                yield table_of(rows).assign(rank=range(rank, rank + len(rows)))
                rank, rows = rank + len(rows), []
        if rows:
            yield table_of(rows).assign(rank=range(rank, rank + len(rows)))

    ranged = runs.repartitionByRange("url_key", "stamp", "page_id", "file", "offset").sortWithinPartitions("run", "nth")
    exact = ranged.select("run", "nth", "url_key", "stamp", F.col("page_id").cast("string").alias("page_id"), "file", "offset", "length")
    return exact.mapInPandas(merge, "url_key string, stamp string, page_id long, file string, offset long, length long, rank long")


def read_archives(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that the index names, in the order of its ranks: each archive is read
    from front to back by one task, record by record; then the rows are put in order."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, stamp string, rank long" + ", payload binary" * with_payload
    columns = [c.split() for c in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, src, rows, n_bytes = None, None, [], 0

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types[kind]) for c, kind in columns], [c for c, _ in columns])

        for b in batches:
            for file, offset, length, key, stamp, rank in zip(*(c.to_pylist() for c in b.columns)):
                if file != name:
                    if src is not None:
                        src.close()
                    fs, path = open_fs(file)
                    name, src = file, fs.open_input_file(path)
                src.seek(offset)
                row = parse(src.read(length)) | {"url_key": key, "stamp": stamp, "rank": rank}
                if with_payload:
                    n_bytes += len(row["payload"])
                else:
                    del row["payload"]
                rows.append(row)
                if len(rows) >= 2000 or n_bytes >= SEND:
                    yield send()
                    rows, n_bytes = [], 0
        if src is not None:
            src.close()
        if rows:
            yield send()

    index = materialise(index, "cdx")
    n_files = max(1, index.select("file").distinct().count())
    placed = index.repartition(n_files, "file").sortWithinPartitions("file", "offset").select("file", "offset", "length", "url_key", "stamp", "rank")
    records = materialise(placed.mapInArrow(read, schema), "warc-records")
    return records.repartitionByRange("rank").sortWithinPartitions("rank").drop("rank")


def warc_round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Writes the archives of pages(page_id, url, html) and reads them back through the merged index."""
    spark = pages.sparkSession
    runs = write_archives(assign(pages, min_bytes), qualified(spark, folder or fresh_path(spark, "warc")))
    return read_archives(merge_index(runs), with_payload)
