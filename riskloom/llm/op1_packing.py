"""Packing by concatenate and cut.

Pass 1 encodes every document where it lies and writes its ids with its offset in
its partition. Pass 2 sums the partitions' totals (one number a partition comes to
the driver) to global offsets and cuts the concatenation into fixed windows; a
document over a window's edge yields a boundary record, one piece on each side.
No row is shuffled. Only the last sequence can be short; it is padded to the
window, or kept as it is at a power of two.

Cases: a null text counts as empty (the end id alone); null or repeated doc_ids
and repeated rows are packed like others; a very long text fills as many sequences as
it takes; an empty table gives no piece; further columns are ignored, whatever their
names."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .tokens import END_ID, Encoder, default_path

WINDOW = 4096
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary boolean, padded_to long"


def encode_partitions(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(part, doc_id, local_start, n_tokens, ids): ids as unsigned 16-bit numbers
    where they all fit, else 32-bit, with the width in `width`."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, enc, end = TaskContext.get().partitionId(), 0, Encoder.of(tokenizer), struct.pack("<I", end_id)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                sub = b.slice(k, 512)
                starts, sizes, widths, blobs = [], [], [], []
                for text in sub.column(1).to_pylist():
                    ids = np.frombuffer(enc.ids(text) + end, "<u4")
                    width = 2 if ids.max() < 1 << 16 else 4
                    starts.append(at)
                    sizes.append(len(ids))
                    widths.append(width)
                    blobs.append(ids.astype(f"<u{width}").tobytes())
                    at += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(sizes), pa.int32()), sub.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(widths, pa.int32()), pa.array(blobs, pa.binary())],
                    ["part", "doc_id", "local_start", "n_tokens", "width", "ids"],
                )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(plain.mapInArrow(encode, "part int, doc_id long, local_start long, n_tokens long, width int, ids binary"), "encoded")


def cut(encoded: DataFrame, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces of encoded documents; with_ids adds their ids as unsigned 32-bit."""
    totals = encoded.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("n")).collect()  # one row a partition
    base, total = {}, 0
    for r in sorted(totals, key=lambda r: r["part"]):
        base[r["part"]] = total
        total += r["n"]
    last, rest = divmod(total, window)
    padded_last = rest if rest & (rest - 1) == 0 else window

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for part, doc, local, n, width, blob in zip(*(c.to_pylist() for c in b.columns)):
                ids, g, at = np.frombuffer(blob, f"<u{width}").astype("<u4"), base[part] + local, 0
                split = g // window != (g + n - 1) // window
                while at < n:
                    seq, offset = divmod(g + at, window)
                    length = min(window - offset, n - at)
                    raw = ids[at : at + length].tobytes()
                    out.append((doc, at, length, zlib.crc32(raw), n, seq, offset, split, padded_last if seq == last else window, *([raw] if with_ids else [])))
                    at += length
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    types = [pa.int64()] * 7 + [pa.bool_(), pa.int64()] + [pa.binary()] * with_ids
    schema = PIECE + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    return encoded.select("part", "doc_id", "local_start", "n_tokens", "width", "ids").mapInArrow(pieces, schema)


def sequences(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids array<long>) with padding; a group holds at most `window` ids."""
    parts = cut(encode_partitions(docs, tokenizer or default_path(), end_id), window, with_ids=True)
    rows = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"), F.max("padded_to").alias("size"))
    hexed = F.hex(F.concat(F.lit(b""), F.aggregate("p", F.lit("").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))))
    word = lambda i: F.concat(*[F.substring(hexed, i * 8 + k, 2) for k in (7, 5, 3, 1)])
    ids = F.transform(F.sequence(F.lit(0), F.col("n_tokens") - 1), lambda i: F.conv(word(i.cast("int")), 16, 10).cast("long"))
    return rows.select("sequence_id", "n_tokens", F.concat(ids, F.array_repeat(F.lit(pad_id).cast("long"), (F.col("size") - F.col("n_tokens")).cast("int"))).alias("ids"))


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents: see PIECE."""
    return cut(encode_partitions(docs, tokenizer or default_path(), end_id), window)
