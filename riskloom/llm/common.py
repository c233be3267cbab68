"""What the training-data operators share: word hashing, files, free column names; tables
in the cluster's shared folder and connected components are the library's."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from riskloom.shared import connected_components, fresh_path, materialise, shared_dir

__all__ = ["WordHash", "connected_components", "forget", "free_name", "fresh_path", "materialise", "mix", "open_fs", "qualified", "shared_dir", "shingle_hashes", "space_words"]
_MEMO_WORDS = 300_000


def forget(df: DataFrame) -> None:
    """Deletes the files of a materialised table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/riskloom/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark would read it by, so that tasks in Python use the same file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return "/" + full.removeprefix("file:").lstrip("/") if full.startswith("file:") else full


def open_fs(path: str):
    """(file system, path in it) for Python tasks; the path comes from `qualified`."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class WordHash(dict):
    """64-bit hash of each word seen, kept between batches up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > _MEMO_WORDS:
            self.clear()
        return np.array([self[w] for w in words], dtype=np.uint64)


def space_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space (0x09-0x0D, 0x20), A-Z lower-cased.

    bytes.lower() and bytes.split() touch exactly these ASCII characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words; fewer words make one shingle."""
    n = len(words)
    if n == 0:
        return words
    size = min(size, n)
    total = np.full(n - size + 1, size, dtype=np.uint64)
    for k in range(size):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + words[k : n - size + 1 + k])
    return total
