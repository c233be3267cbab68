"""Text, path and number normal forms as native column expressions.

Trimming removes all Unicode white space; casts never fail (null instead)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

#: Extension -> language.
LANGUAGES = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "typescriptreact", "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "jsx": "javascriptreact", "py": "python", "rb": "ruby", "go": "go", "java": "java", "cs": "csharp", "php": "php", "rs": "rust", "kt": "kotlin", "kts": "kotlin",
    "swift": "swift", "sql": "sql", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml", "md": "markdown", "mdx": "markdown",
}

#: Words that carry no meaning in a finding's summary.
STOP_WORDS = [
    "a", "an", "the", "of", "for", "to", "on", "in", "with", "without", "and", "or", "no", "not", "missing", "lack", "lacking",
    "is", "are", "be", "as", "by", "via", "from", "into", "this", "that", "these", "those", "should",
]


def map_of(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, f"{WHITE}+", " ")


def present(c: Column) -> Column:
    """The trimmed text, or null where nothing is left."""
    return F.nullif(trim(c), F.lit(""))


def first_present(*candidates: Column) -> Column:
    return F.coalesce(*[present(c) for c in candidates])


def sampling_path(c: Column) -> Column:
    """Forward slashes, no leading dot or slashes, no doubled or closing slashes."""
    p = F.regexp_replace(trim(c), r"\\", "/")
    p = F.regexp_replace(p, r"^\.?/*", "")
    return F.regexp_replace(F.regexp_replace(p, "/+", "/"), "/+$", "")


def file_path(c: Column) -> Column:
    return F.regexp_replace(trim(F.regexp_replace(c, r"\\", "/")), r"^\.?/*", "")


def repo_path(c: Column) -> Column:
    p = F.regexp_replace(trim(F.regexp_replace(c, r"\\", "/")), r"^[./]+", "")
    return F.regexp_replace(p, "/+$", "")


def canonical_path(repo: Column, path: Column) -> Column:
    """Lower-case path below its repository folder; empty without a path."""
    r, p = F.coalesce(repo_path(repo), F.lit("")), F.coalesce(file_path(path), F.lit(""))
    joined = F.when((r == "") | F.startswith(p, F.concat(r, F.lit("/"))), p).otherwise(F.concat(r, F.lit("/"), p))
    return F.when(p == "", F.lit("")).otherwise(F.lower(joined))


def key_part(c: Column) -> Column:
    return F.replace(squeeze(F.lower(trim(c))), F.lit("|"), F.lit("/"))


def plain_part(c: Column) -> Column:
    return F.replace(trim(c), F.lit("|"), F.lit("/"))


def type_token(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(trim(F.lower(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def category_token(c: Column) -> Column:
    t = F.regexp_replace(trim(F.lower(c)), r"[\s-]+", "_")
    t = F.regexp_replace(F.regexp_replace(t, "[^a-z0-9_]+", "_"), "_+", "_")
    return F.regexp_replace(t, "^_+|_+$", "")


def category_text(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.lower(c), "[_-]+", " "), "[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(t, " +", " "))


def entry_point_token(c: Column) -> Column:
    t = squeeze(F.regexp_replace(F.lower(trim(c)), r"\\", "/"))
    return F.regexp_replace(F.regexp_replace(t, "^/+", ""), "/+$", "")


def extension(c: Column) -> Column:
    """From the last dot on, lower case; empty without a dot."""
    return F.lower(F.regexp_extract(c, r"(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    return F.coalesce(F.element_at(map_of(LANGUAGES), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("unknown"))


def top_folder(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when(F.size(parts) <= 1, F.lit("<root>")).otherwise(F.element_at(parts, 1))


def basic_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " +", " "))


def summary_tokens(c: Column) -> Column:
    """Distinct words without stop words, sorted."""
    words = F.split(F.lower(c), "[^a-z0-9]+")
    return F.sort_array(F.array_except(words, F.array(*map(F.lit, ["", *STOP_WORDS]))))


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / F.greatest(either, F.lit(1)))


def ordered_unique(*arrays: Column) -> Column:
    """Trimmed, non-empty, first occurrence of each."""
    joined = F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])
    return F.array_distinct(F.filter(F.transform(joined, trim), lambda x: x != ""))


def evidence(c: Column, most: int = 140) -> Column:
    t = trim(c)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.left(t, F.lit(most - 3)), F.lit("...")))


def snippet(c: Column, most: int = 180) -> Column:
    t = trim(squeeze(c))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.left(t, F.lit(most - 3)), F.lit("...")))


def line_at(content: Column, pattern: str) -> Column:
    """The first line that matches, or null."""
    return F.nullif(F.regexp_extract(content, rf"(?m)^(.*{pattern}.*)$", 1), F.lit(""))


def tokens_estimate(c: Column) -> Column:
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4).cast("long")


def line_number(c: Column) -> Column:
    """Text or number to a whole number towards zero; blank text counts as 0."""
    s = trim(c.cast("string"))
    hexed = F.when(s.rlike("^0[xX][0-9a-fA-F]{1,12}$"), F.conv(F.substring(s, 3, 20), 16, 10).try_cast("double"))
    number = F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))
    value = F.when(s == "", F.lit(0.0)).otherwise(F.coalesce(hexed, number))
    return F.when(F.abs(value) < 9e15, F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("long"))


def non_negative(c: Column) -> Column:
    n = line_number(c)
    return F.when(n >= 0, n)


def confidence(c: Column) -> Column:
    x = F.coalesce(c.try_cast("double"), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.isnan(x), F.lit(0.0)).otherwise(x)))


def hash32(c: Column) -> Column:
    """32-bit times-33-xor hash of the characters, base 36."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), F.ascii)
    h = F.aggregate(codes, F.lit(5381).cast("long"), lambda acc, x: ((acc * 33).bitwiseAND(F.lit(4294967295))).bitwiseXOR(x.cast("long")))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def duration_ms(c: Column) -> Column:
    """Sum of the parts of texts like 1h2m3.5s or 250ms; null for anything else."""
    ok = c.rlike(r"^\s*(?:\d+(?:\.\d+)?(?:ms|s|m|h))+\s*$")
    parts = F.regexp_extract_all(c, F.lit(r"(\d+(?:\.\d+)?(?:ms|s|m|h))"), 1)
    unit = map_of({"ms": "1", "s": "1000", "m": "60000", "h": "3600000"})
    each = F.transform(parts, lambda p: F.regexp_extract(p, r"^([\d.]+)", 1).cast("double") * F.element_at(unit, F.regexp_extract(p, "([a-z]+)$", 1)).cast("double"))
    return F.when(ok, F.aggregate(each, F.lit(0.0), lambda a, x: a + x).cast("long"))


def instant_ms(c: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(c))


def backoff_ms(attempt: Column, base: int = 500, most: int = 8000, jitter: Column | None = None) -> Column:
    return F.least(F.lit(most), (F.lit(base) * F.pow(F.lit(2), attempt - 1)).cast("long") + (jitter if jitter is not None else F.lit(0)))


def retry_tokens(current: Column) -> Column:
    return F.least(F.lit(65536), F.greatest(current + 4096, current * 2, F.lit(8192)))


def advisory_id(vuln_id: Column, aliases: Column) -> Column:
    """A GHSA id before a CVE id before the given one."""
    every = F.concat(F.array(trim(F.coalesce(vuln_id, F.lit("")))), F.coalesce(aliases, F.array().cast("array<string>")))
    pick = lambda p: F.get(F.filter(every, lambda x: x.rlike(p)), F.lit(0))
    return F.coalesce(pick("(?i)^GHSA-"), pick("(?i)^CVE-"), trim(vuln_id))


def package_spec(c: Column) -> Column:
    """The first name@version in a text, or null."""
    return F.nullif(F.regexp_extract(c, r"(?i)\b([a-z0-9_.-]+@[0-9][^\s,)]*)\b", 1), F.lit(""))


def alias_tokens(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?i)\b(GHSA-[A-Za-z0-9-]+|CVE-\d{4}-\d{4,})\b"), 1), F.upper)))


def comparable_text(c: Column) -> Column:
    """Letters and digits of any script, lower case, without advisory ids."""
    t = squeeze(F.lower(trim(F.regexp_replace(c, r"(?i)\bGHSA-[A-Za-z0-9-]+\b", " "))))
    return trim(squeeze(F.regexp_replace(t, r"[^\p{L}\p{N}\s]+", " ")))


def glob_pattern(c: Column) -> Column:
    """A path glob as an anchored pattern: ** crosses folders, * does not."""
    q = F.regexp_replace(c, r"([.+?^$(){}|\[\]\\])", r"\\$1")
    q = F.regexp_replace(q, r"\*\*", "\u0001")
    q = F.regexp_replace(q, r"\*", "[^/]*")
    return F.concat(F.lit("^"), F.regexp_replace(q, "\u0001", ".*"), F.lit("$"))
