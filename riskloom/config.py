"""Settings in layers, and the operators that they steer.

A layer is a nested mapping as JSON gives it. Later layers win, value by value; a value counts
only if it has the type that the default has, and numbers only if they are positive, so a
broken value leaves the layer below in force. From the lowest: the defaults, a JSON file, the
environment (`RISKLOOM_SAMPLING_MAX_FILES`), what a caller passes."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators import chunking, packing, projections, rules, sampling
from riskloom.sources import files

#: What holds where no layer says otherwise.
DEFAULTS: dict[str, dict[str, Any]] = {
    "chunking": {"max_chars": 1200, "overlap_chars": 200, "max_file_size_bytes": 204_800, "include_extensions": [*files.EXTENSIONS], "exclude": ["**/node_modules/**", "**/.git/**", "**/dist/**", "**/build/**", "**/.next/**", "**/coverage/**", "**/out/**"]},
    "sampling": {"max_files": 80, "max_chunks_per_file": 5},
    "understanding": {"max_prompt_tokens": 6500, "min_batch_chunks": 1, "max_batch_chunks": 8},
    "rules": {"max_prompt_tokens": 6500, "soft": 15, "hard": 25, "min_per_chunk": 3},
    "findings": {"existing": 80, "prior": 40},
    "static": {"extensions": ["js", "jsx", "ts", "tsx", "mjs", "cjs"], "ignore": ["**/node_modules/**", "**/dist/**"]},
    "stages": {"static": True, "rules": True, "composites": True, "catalog": False},
}
NAMES = ["riskloom.config.json", ".riskloomrc.json"]
_WORDS = {"1": True, "true": True, "yes": True, "y": True, "on": True, "0": False, "false": False, "no": False, "n": False, "off": False}


def typed(value: Any, default: Any) -> Any:
    """The value in the default's type, or None where it has no such value."""
    if isinstance(default, bool):
        return value if isinstance(value, bool) else _WORDS.get(value.strip().lower()) if isinstance(value, str) else None
    if isinstance(default, int):
        if isinstance(value, bool) or not isinstance(value, (int, float, str)):
            return None
        try:
            number = int(float(value))
        except (ValueError, OverflowError):
            return None
        return number if number > 0 else None
    if isinstance(default, list):
        items = value.split(",") if isinstance(value, str) else value
        return [str(x).strip() for x in items if str(x).strip()] if isinstance(items, list) else None
    return str(value) if value is not None else None


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def merged(base: Mapping[str, Any], layer: Mapping[str, Any]) -> dict[str, Any]:
    """base with the layer's values over it, section by section; unknown names and values of another type are left out."""
    given = {snake(k): v for k, v in layer.items()} if isinstance(layer, Mapping) else {}
    out = {}
    for name, value in base.items():
        if isinstance(value, Mapping):
            out[name] = merged(value, given.get(name, {}))
        else:
            new = typed(given[name], value) if name in given else None
            out[name] = value if new is None else new
    return out


def from_file(root: str, path: str | None = None) -> dict[str, Any]:
    """The named file, else the first of NAMES that is there."""
    for name in [path] if path else NAMES:
        if (file := Path(root, name)).exists():
            return json.loads(file.read_text())
    return {}


def from_environment(environment: Mapping[str, str], prefix: str = "RISKLOOM") -> dict[str, Any]:
    """The layer of variables named by prefix, section and name; empty ones say nothing."""
    out: dict[str, Any] = {}
    for section, values in DEFAULTS.items():
        for name in values:
            if text := environment.get(f"{prefix}_{section}_{name}".upper(), "").strip():
                out.setdefault(section, {})[name] = text
    return out


def glob_regex(pattern: str) -> str:
    """A path pattern as a regular expression: ** crosses folders, * and ? do not."""
    out = re.escape(pattern).replace(r"\*\*/", "(?:.*/)?").replace(r"/\*\*", "/.*").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"^{out}$"


class Settings:
    """Settled values, and each operator with the arguments that follow from them."""

    def __init__(self, *layers: Mapping[str, Any]):
        self.values: dict[str, Any] = DEFAULTS
        for layer in layers:
            self.values = merged(self.values, layer)

    @classmethod
    def load(cls, root: str, path: str | None = None, given: Mapping[str, Any] | None = None, environment: Mapping[str, str] | None = None) -> "Settings":
        return cls(from_file(root, path), from_environment(os.environ if environment is None else environment), given or {})

    def __getitem__(self, section: str) -> dict[str, Any]:
        return self.values[section]

    @staticmethod
    def _hit(path: Column, patterns: list[str]) -> Column:
        return path.rlike("|".join(map(glob_regex, patterns))) if patterns else F.lit(False)

    def eligible(self, table: DataFrame, path: str, size: str, content: str) -> DataFrame:
        """The files that are read: by extension, size, text and excluded folders."""
        c = self["chunking"]
        extensions = [x.lower().removeprefix(".") for x in c["include_extensions"]]
        return table.where(files.eligible(F.col(path), F.col(size), F.col(content), extensions, c["max_file_size_bytes"]) & ~self._hit(F.col(path), c["exclude"]))

    def windows(self, table: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
        return chunking.char_windows(table, path, content, self["chunking"]["max_chars"], self["chunking"]["overlap_chars"])

    def sample(self, chunks: DataFrame, path: str, order: str) -> DataFrame:
        return sampling.cap_groups(chunks, path, order, self["sampling"]["max_files"], self["sampling"]["max_chunks_per_file"])

    def batches(self, rows: DataFrame, key: list[str], order: str, tokens: str, base: int) -> DataFrame:
        """Chunks in order into prompts, at least `min_batch_chunks` of them a prompt."""
        u = self["understanding"]
        return packing.sequential_bins(rows, key, order, tokens, base, u["max_prompt_tokens"], max(u["min_batch_chunks"], u["max_batch_chunks"]))

    def pack(self, rows: DataFrame, key: list[str], order: list[Column | str], tokens: str, base: int) -> DataFrame:
        r = self["rules"]
        return packing.prefix_budget(rows, key, order, tokens, base, r["max_prompt_tokens"], r["soft"], r["hard"])

    def choose(self, chunks: DataFrame, catalogue: DataFrame, key: str = "chunk_uid") -> DataFrame:
        return rules.select_rules(chunks, catalogue, key, self["rules"]["min_per_chunk"])

    def existing(self, flat: DataFrame) -> DataFrame:
        return projections.worst_known(flat, self["findings"]["existing"])

    def prior(self, flat: DataFrame) -> DataFrame:
        return projections.worst_known(flat, self["findings"]["prior"], whole_details=True)

    def static(self, reports: DataFrame, path: str = "filepath") -> DataFrame:
        """The findings of static tools in files of their extensions, without ignored paths."""
        s = self["static"]
        extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
        return reports.where(extension.isin(*[x.lower().removeprefix(".") for x in s["extensions"]]) & ~self._hit(F.col(path), s["ignore"]))

    def together(self, parts: Mapping[str, DataFrame]) -> DataFrame | None:
        """The union of the findings of the stages that are on."""
        on = [parts[name] for name, wanted in self["stages"].items() if wanted and name in parts]
        out = None
        for part in on:
            out = part if out is None else out.unionByName(part)
        return out
