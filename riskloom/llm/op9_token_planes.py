"""Token-ID output by bit-plane shuffling.

Each file holds the ids of a range of documents in ascending doc_id order. Ids
are cut into blocks of fixed size; a block is transposed into byte planes (or
bit planes), every plane is compressed with zstandard, and a chunk index and a
document index end the file:

    magic | planes of block 0 | planes of block 1 | ... | index | length of index | magic

Cases: a null text counts as empty and yields the end id alone; a null doc_id
sorts first and is kept; repeated rows and ids are all written, rows that tie on
doc_id in any order; a very long text is encoded whole; an empty table writes no file;
other columns are ignored, whatever their names."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, open_fs, qualified
from .tokens import END_ID, Encoder, default_path

MAGIC = b"TKPLANE1"
BLOCK = 1 << 16


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The 4 byte planes, or 32 bit planes, of unsigned 32-bit ids."""
    by_byte = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    if not bits:
        return [p.tobytes() for p in by_byte]
    return [np.packbits((p >> b) & 1).tobytes() for p in by_byte for b in range(8)]


def from_planes(planes: list[bytes], n: int, bits: bool = False) -> np.ndarray:
    raw = [np.frombuffer(p, np.uint8) for p in planes]
    if bits:
        raw = [np.bitwise_or.reduce([np.unpackbits(raw[8 * k + b], count=n) << b for b in range(8)]) for k in range(4)]
    return np.ascontiguousarray(np.stack(raw, axis=1)).view("<u4").reshape(-1) if n else np.empty(0, "<u4")


class PlaneWriter:
    """Writes one file; memory holds one block and the document index."""

    def __init__(self, out, block: int = BLOCK, bits: bool = False, level: int = 3):
        self.out, self.block, self.bits = out, block, bits
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at, self.chunks, self.pending, self.held = len(MAGIC), [], [], 0
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.pending.append(np.frombuffer(ids, "<u4"))
        self.held += len(ids) // 4
        if self.held >= self.block:
            ready = np.concatenate(self.pending)
            full = len(ready) // self.block * self.block
            for k in range(0, full, self.block):
                self._flush(ready[k : k + self.block])
            self.pending, self.held = [ready[full:]], len(ready) - full

    def _flush(self, ids: np.ndarray) -> None:
        packed = [self.zip.compress(p) for p in to_planes(ids, self.bits)]
        self.chunks.append({"at": self.at, "ids": len(ids), "planes": [len(p) for p in packed]})
        for p in packed:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> int:
        if self.held:
            self._flush(np.concatenate(self.pending))
        index = zstandard.ZstdCompressor().compress(json.dumps({"bits": self.bits, "block": self.block, "chunks": self.chunks, "docs": self.docs, "sizes": self.sizes}).encode())
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)
        return sum(self.sizes)


class PlaneReader:
    """Reads a file from any seekable input; blocks are decoded as they are needed."""

    def __init__(self, src, size: int):
        self.src = src
        if self._at(0, len(MAGIC)) != MAGIC or (tail := self._at(size - 16, 16))[8:] != MAGIC:
            raise ValueError("not a token plane file")
        n = struct.unpack("<Q", tail[:8])[0]
        self.index = json.loads(zstandard.ZstdDecompressor().decompress(self._at(size - 16 - n, n)))

    def _at(self, offset: int, n: int) -> bytes:
        self.src.seek(offset)
        return self.src.read(n)

    def chunk(self, k: int) -> np.ndarray:
        c = self.index["chunks"][k]
        raw, at, planes = self._at(c["at"], sum(c["planes"])), 0, []
        unzip = zstandard.ZstdDecompressor()
        for n in c["planes"]:
            planes.append(unzip.decompress(raw[at : at + n]))
            at += n
        return from_planes(planes, c["ids"], self.index["bits"])

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in file order."""
        k, left = 0, np.empty(0, "<u4")
        for doc, n in zip(self.index["docs"], self.index["sizes"]):
            parts, have = [left], len(left)
            while have < n:
                parts.append(self.chunk(k))
                have += len(parts[-1])
                k += 1
            whole = np.concatenate(parts) if len(parts) > 1 else left
            left = whole[n:]
            yield doc, whole[:n]


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, block: int = BLOCK, bits: bool = False) -> list[dict]:
    """Writes docs(doc_id, text) in ascending doc_id order, a file for each range;
    returns the files in order with their counts, one record a partition. Each
    attempt of a task writes a file of its own; the files of the attempts that
    succeeded are those returned."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, writer, enc = TaskContext.get().partitionId(), None, Encoder.of(tokenizer)
        end = struct.pack("<I", end_id)
        fs, root = open_fs(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}.planes"
        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"]):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    writer = PlaneWriter(out, block, bits)
                writer.add(None if pd.isna(doc) else int(doc), enc.ids(text) + end)
        if writer:
            total = writer.close()
            out.close()
            yield pd.DataFrame({"part": [part], "name": [name], "n_docs": [len(writer.docs)], "n_tokens": [total]})

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"))
    exact = ranged.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # pandas would turn ids beside a null into floats
    rows = exact.mapInPandas(write, "part int, name string, n_docs long, n_tokens long").collect()  # one row a file
    files, start = [], 0
    for r in sorted(rows, key=lambda r: r["part"]):
        files.append({"path": f"{folder}/{r['name']}", "start": start, "n_docs": r["n_docs"], "n_tokens": r["n_tokens"]})
        start += r["n_tokens"]
    return files


def read_files(spark: SparkSession, files: list[dict], with_ids: bool = False) -> DataFrame:
    """A row for each document of the files: doc_id, start, n_tokens, ids_crc32,
    and ids (little-endian unsigned 32-bit) if asked for. A task reads one file."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in b["id"]:
                f, rows = files[k], []
                fs, path = open_fs(f["path"])
                with fs.open_input_file(path) as src:
                    start = f["start"]
                    for doc, ids in PlaneReader(src, src.size()).documents():
                        raw = ids.tobytes()
                        rows.append((doc, start, len(ids), zlib.crc32(raw), raw) if with_ids else (doc, start, len(ids), zlib.crc32(raw)))
                        start += len(ids)
                        if len(rows) >= (500 if with_ids else 20_000):
                            yield frame(rows)
                            rows = []
                if rows:
                    yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame([r[1:] for r in rows], columns=columns[1:])
        out.insert(0, "doc_id", pd.array([r[0] for r in rows], dtype="Int64"))
        return out

    columns = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return spark.range(0, len(files), 1, max(1, len(files))).mapInPandas(read, schema)


def token_planes(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None, **how) -> DataFrame:
    """Writes the files and reads them back: see write_files and read_files."""
    spark = docs.sparkSession
    return read_files(spark, write_files(docs, qualified(spark, folder or fresh_path(spark, "planes")), tokenizer or default_path(), **how))
