"""Files of a source tree. Built-in readers skip names that begin with a dot or an
underscore, so listing is a Python data source: the driver lists folders of the root,
tasks walk them and read what passes the filters."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: What is read by default.
EXTENSIONS = ["ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go", "java", "cs", "rb", "php", "rs", "kt", "swift", "sql", "json"]
EXCLUDED = ["node_modules", "dist", "build", ".git", ".next", "coverage", "vendor", "__pycache__"]
MAX_BYTES = 204_800
#: A task reads about this much.
TASK_BYTES = 8_000_000
SCHEMA = "path string, size long, mtime_ms long, hash string, content string"


def gitignore(text: str) -> list[str]:
    """Patterns of an ignore file without comments and blank lines."""
    return [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]


def ignored(path: str, patterns: list[str]) -> bool:
    parts = path.split("/")
    for p in patterns:
        name = p.strip("/")
        if p.startswith("/") or "/" in name:
            if fnmatch.fnmatch(path, name) or path.startswith(name + "/"):
                return True
        elif any(fnmatch.fnmatch(x, name) for x in parts):
            return True
    return False


def is_text(head: bytes) -> bool:
    return b"\x00" not in head[:4000]


class _Files(InputPartition):
    """Files of one task: (path, status)."""

    def __init__(self, number: int, files: list[tuple[str, str]]):
        super().__init__(number)
        self.files = files


class _Tree:
    """A folder with what is read of it; files are listed by name, size and time only."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.extensions = {x.lower() for x in options.get("extensions", ",".join(EXTENSIONS)).split(",")} if options.get("extensions") != "*" else None
        self.most = int(options.get("maxbytes", options.get("maxBytes", MAX_BYTES)))
        self.task_bytes = int(options.get("taskbytes", options.get("taskBytes", TASK_BYTES)))
        rules = os.path.join(self.root, ".gitignore")
        self.patterns = [*options.get("exclude", ",".join(EXCLUDED)).split(","), *(gitignore(open(rules, encoding="utf-8", errors="replace").read()) if os.path.isfile(rules) else [])]

    def listed(self) -> Iterator[tuple[str, int, int]]:
        """(path, size, time) of the files that are read, in order of folder and name."""
        for at, folders, names in os.walk(self.root):
            rel = os.path.relpath(at, self.root).replace(os.sep, "/")
            rel = "" if rel == "." else rel + "/"
            folders[:] = sorted(f for f in folders if not ignored(rel + f, self.patterns))
            for name in sorted(names):
                if ignored(rel + name, self.patterns) or (self.extensions is not None and name.rpartition(".")[2].lower() not in self.extensions):
                    continue
                info = os.stat(os.path.join(at, name))
                if info.st_size <= self.most:
                    yield rel + name, info.st_size, info.st_mtime_ns

    def dealt(self, files: Iterable[tuple[str, int, str]]) -> list[InputPartition]:
        """(path, size, status) into tasks of about task_bytes, whatever folders they lie in."""
        out, held, size = [], [], 0
        for path, n, status in files:
            held.append((path, status))
            size += n + 4096  # a file costs its opening
            if size >= self.task_bytes:
                out.append(_Files(len(out), held))
                held, size = [], 0
        if held or not out:
            out.append(_Files(len(out), held))
        return out

    def rows(self, files: list[tuple[str, str]]) -> Iterator[tuple]:
        """(path, size, mtime_ms, hash, content, status); files that have gone since, and binary ones, are left out."""
        for rel, status in files:
            if status == "deleted":
                yield rel, None, None, None, None, status
                continue
            path = os.path.join(self.root, rel)
            try:
                with open(path, "rb") as f:
                    raw, info = f.read(), os.fstat(f.fileno())
            except FileNotFoundError:
                continue
            if is_text(raw):
                yield rel, info.st_size, info.st_mtime_ns // 1_000_000, hashlib.sha256(raw).hexdigest(), raw.decode("utf-8", "replace"), status


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.tree = _Tree(options)

    def partitions(self) -> list[InputPartition]:
        return self.tree.dealt((path, size, "") for path, size, _ in self.tree.listed())

    def read(self, partition: _Files) -> Iterator[tuple]:
        return (row[:-1] for row in self.tree.rows(partition.files))


class _StreamReader(DataSourceStreamReader):
    """Offsets count listings. Each listing that differs from the one before is kept in the
    folder `state` until a later one is committed; a batch is what two of them differ in, so it
    is the same again after a restart. A file that is gone by the time it is read is left out,
    and comes as deleted with the next batch."""

    def __init__(self, options: dict):
        self.tree, self.state = _Tree(options), options["state"]
        os.makedirs(self.state, exist_ok=True)

    def _path(self, at: int) -> str:
        return os.path.join(self.state, f"{at:012}.json")

    def _known(self, at: int) -> dict[str, list[int]]:
        if at == 0:
            return {}
        with open(self._path(at), encoding="utf-8") as f:
            return json.load(f)

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        last = max([0, *(int(n.split(".")[0]) for n in os.listdir(self.state) if n.endswith(".json"))])
        now = {path: [size, time] for path, size, time in self.tree.listed()}
        if now != self._known(last):
            last += 1
            with open(self._path(last) + ".new", "w", encoding="utf-8") as f:
                json.dump(now, f)
            os.replace(self._path(last) + ".new", self._path(last))
        return {"listing": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = self._known(start["listing"]), self._known(end["listing"])
        changed = [(p, x[0], "changed" if p in old else "new") for p, x in new.items() if old.get(p) != x]
        return self.tree.dealt([*changed, *((p, 0, "deleted") for p in old if p not in new)])

    def read(self, partition: _Files) -> Iterator[tuple]:
        return self.tree.rows(partition.files)

    def commit(self, end: dict) -> None:
        for n in os.listdir(self.state):
            if n.endswith(".json") and int(n.split(".")[0]) < end["listing"]:
                os.remove(os.path.join(self.state, n))


class FileTree(DataSource):
    """spark.read.format("file_tree").load(root); options extensions ("*" for all), exclude,
    maxBytes, taskBytes. As a stream also `state`, a folder for listings, and a column status:
    new, changed or deleted."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA + ", status string" if "state" in self.options else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def read_files(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.dataSource.register(FileTree)
    return spark.read.format("file_tree").options(**options).load(root)


def stream_files(spark: SparkSession, root: str, state: str, **options: str) -> DataFrame:
    """What is new, changed or deleted under root since the last batch."""
    spark.dataSource.register(FileTree)
    return spark.readStream.format("file_tree").options(state=state, **options).load(root)


def eligible(path: Column, size: Column, content: Column, extensions: list[str], most: int = MAX_BYTES) -> Column:
    """The same filter over a table of files."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*extensions) & (size <= most) & ~F.contains(F.left(content, F.lit(4000)), F.lit("\x00"))


def prefix_statistics(paths: DataFrame, path: str, prefix: Column) -> DataFrame:
    """(prefix, total, code, config, hints, score) of path prefixes: what a sub-project's folder holds."""
    p = F.lower(path)
    code = p.rlike(r"\.(ts|tsx|js|jsx|mjs|cjs|py|go|rb|java|cs|php|rs|kt|sql)$")
    config = p.rlike(r"(^|/)(package\.json|tsconfig\.json|pyproject\.toml|go\.mod|cargo\.toml|pom\.xml|next\.config\.[a-z]+|vite\.config\.[a-z]+)$")
    hint = p.rlike(r"(^|/)(src|app|api|server|backend|frontend|functions|pages)/")
    per = paths.select(prefix.alias("prefix"), code.alias("c"), config.alias("g"), hint.alias("h")).groupBy("prefix").agg(F.count("*").alias("total"), F.count_if("c").alias("code"), F.count_if("g").alias("config"), F.count_if("h").alias("hints"))
    return per.withColumn("score", 2 * F.col("code") + F.col("total") + 25 * F.col("config") + 2 * F.least(F.col("hints"), F.lit(20)))


def dominant_prefix(stats: DataFrame, share: float = 0.6) -> DataFrame:
    """The best-scored prefix, if it holds this share of the scores."""
    best = F.min_by(F.struct("prefix", "score"), F.struct((-F.col("score")).alias("s"), "prefix"))
    return stats.agg(best.alias("best"), F.sum("score").alias("all")).where(F.col("best.score") >= share * F.col("all")).select("best.*")


def common_prefix(paths: DataFrame, path: str) -> DataFrame:
    """The folder that all paths share: it is what the least and the greatest path share."""
    ends = paths.agg(F.split(F.min(path), "/").alias("a"), F.split(F.max(path), "/").alias("b"))
    n = F.least(F.size("a"), F.size("b")) - 1
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (k <= n) & (F.slice("a", 1, k) == F.slice("b", 1, k)))
    return ends.select(F.array_join(F.slice("a", 1, F.coalesce(F.array_max(same), F.lit(0))), "/").alias("prefix"))
