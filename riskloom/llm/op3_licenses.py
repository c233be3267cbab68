"""Licence scan: an Aho-Corasick automaton finds identifier tags and notice phrases
over the words of a text, and a shunting-yard parser evaluates the and/or/with
expression that follows an identifier tag.

A text's words are its runs of digits, letters a-z (A-Z lower-cased) and characters
beyond ASCII. Base phrases count wherever their words stand consecutively. An
expression may name the identifiers and exceptions of the lists, in any case, an identifier
with a plus sign, and references of the form LicenseRef-name. The lists are a parameter:
those below, or whole public ones that read_lists() adds to them. What follows a complete
expression is prose, and so is a lower-case operator before anything else; any other
name makes the expression invalid. The score is 1 if a tag has a valid expression, else
1 - 2^-k for k places of any phrase.

Cases: a null or empty text has no words, no labels (empty strings) and score 0; very
long texts are scanned whole where they lie; repeated rows each get their row; of
several expressions the strictest duties are given; an invalid expression adds the
known identifiers that it names but no verdict; an empty table gives no rows; further
columns are ignored, whatever their names."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base phrase -> label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrase -> label.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "mit license": "mit",
    "apache license version 2": "apache-2.0",
    "licensed under the apache license": "apache-2.0",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "eclipse public license": "epl",
    "the unlicense": "unlicense",
    "proprietary and confidential": "proprietary",
}
#: Identifiers by duties; all are lower case.
IDENTIFIERS = {
    "permissive": """0bsd afl-1.1 afl-1.2 afl-2.0 afl-2.1 afl-3.0 apache-1.0 apache-1.1 apache-2.0 artistic-1.0 artistic-2.0
        blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-3-clause-lbnl bsd-4-clause
        bsl-1.0 bzip2-1.0.6 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-pddc cc0-1.0 curl ecl-1.0 ecl-2.0 efl-2.0
        fsfap ftl hpnd icu ijg isc json libpng libpng-2.0 libtiff mit mit-0 mit-cmu mulanpsl-2.0 ncsa ntp odc-by-1.0
        openssl pddl-1.0 php-3.0 php-3.01 postgresql psf-2.0 python-2.0 ruby sgi-b-2.0 tcl unicode-3.0 unicode-dfs-2016
        unlicense upl-1.0 vim w3c wtfpl x11 xnet zlib zlib-acknowledgement zpl-2.0 zpl-2.1""",
    "weak-copyleft": """apsl-2.0 cddl-1.0 cddl-1.1 cpal-1.0 cpl-1.0 ecos-2.0 epl-1.0 epl-2.0 erlpl-1.1 eupl-1.1 eupl-1.2 ipl-1.0
        lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only
        lgpl-3.0-or-later lppl-1.3c mpl-1.0 mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception ms-pl ms-rl nposl-3.0 ofl-1.0 ofl-1.1 qpl-1.0 sleepycat spl-1.0""",
    "copyleft": """agpl-1.0-only agpl-1.0-or-later agpl-3.0 agpl-3.0-only agpl-3.0-or-later cc-by-sa-1.0 cc-by-sa-2.0 cc-by-sa-2.5
        cc-by-sa-3.0 cc-by-sa-4.0 cecill-2.1 gfdl-1.1-only gfdl-1.1-or-later gfdl-1.2-only gfdl-1.2-or-later gfdl-1.3-only
        gfdl-1.3-or-later gpl-1.0-only gpl-1.0-or-later gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only
        gpl-3.0-or-later odbl-1.0 osl-1.0 osl-2.0 osl-2.1 osl-3.0 rpl-1.5""",
    "restricted": """busl-1.1 cc-by-nc-2.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-2.0 cc-by-nc-sa-3.0
        cc-by-nc-sa-4.0 cc-by-nd-2.0 cc-by-nd-3.0 cc-by-nd-4.0 elastic-2.0 polyform-noncommercial-1.0.0 polyform-small-business-1.0.0 sspl-1.0""",
}
#: Exceptions that may follow "with"; all are lower case.
EXCEPTIONS = set("""autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 font-exception-2.0
    gcc-exception-2.0 gcc-exception-3.1 gpl-cc-1.0 i2p-gpl-java-exception libtool-exception linux-syscall-note llvm-exception
    ocaml-lgpl-linking-exception openvpn-openssl-exception qt-gpl-exception-1.0 qt-lgpl-exception-1.1 swift-exception u-boot-exception-2.0
    universal-foss-exception-1.0 wxwindows-exception-3.1""".split())  # fmt: skip
DUTIES = {name: duty for duty, names in IDENTIFIERS.items() for name in names.split()}
RANK = ["permissive", "weak-copyleft", "copyleft", "restricted"]


@dataclass(frozen=True)
class Lists:
    """Duties by identifier, and exceptions; all names are lower case. They go to every task."""

    duties: dict[str, str]
    exceptions: frozenset[str]


OWN = Lists(DUTIES, frozenset(EXCEPTIONS))
#: Names that read_lists() takes at most; the public lists have less than a thousand each.
MOST_NAMES = 20_000
TAG = "spdx license identifier"
_TAG = re.compile(r"spdx-license-identifier\s*:[ \t]*([^\r\n]*)", re.IGNORECASE)
_PART = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+|\S")
#: A-Z to a-z; other ASCII but digits and a-z to a blank; the rest as it is.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG]:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def read_lists(spark: SparkSession, licenses: str, exceptions: str) -> Lists:
    """The lists above with all names of the public ones, as JSON files with records `licenses`
    (licenseId) and `exceptions` (licenseExceptionId). Which duties a name brings is not in them:
    names that are not listed above count as restricted, for they may hold any terms. More than
    MOST_NAMES names are an error, for they go to the driver and to every task."""

    def names(path: str, list_name: str, field: str) -> list[str]:
        rows = spark.read.json(path, schema=f"{list_name} array<struct<{field}: string>>", multiLine=True)
        found = rows.select(F.explode(list_name).alias("x")).select(F.lower(f"x.{field}").alias("name")).where("name <> ''").distinct().limit(MOST_NAMES + 1).collect()
        if len(found) > MOST_NAMES:
            raise ValueError(f"{path} has more than {MOST_NAMES} names")
        return [r["name"] for r in found]

    return Lists(dict.fromkeys(names(licenses, "licenses", "licenseId"), "restricted") | DUTIES, frozenset(EXCEPTIONS) | frozenset(names(exceptions, "exceptions", "licenseExceptionId")))


def duty_of(name: str, lists: Lists = OWN) -> str | None:
    """The duties of a lower-case identifier, None if it is unknown; a reference may hold any terms."""
    if re.fullmatch(r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+", name):
        return "restricted"
    return lists.duties.get(name) or lists.duties.get(name.removesuffix("+"))


def evaluate(expression: str, lists: Lists = OWN) -> tuple[list[str], str | None]:
    """Known identifiers of an expression and its duties: the strictest of an and, the
    mildest of an or; an exception after with softens copyleft. None if it is invalid."""
    parts, binds = _PART.findall(expression), {"or": 1, "and": 2, "with": 3}
    output, ops, names, operand, valid = [], [], [], True, True
    for k, part in enumerate(parts):
        low = part.lower()
        if operand:
            after_with = bool(ops) and ops[-1] == "with"
            if part == "(" and not after_with:
                ops.append(part)
            elif (low in lists.exceptions) if after_with else duty_of(low, lists):
                output.append((low,))
                names += [] if after_with else [low]
                operand = False
            else:
                valid = False
                break
        elif low in binds:
            follows = parts[k + 1].lower() if k + 1 < len(parts) else ""
            if part == low and follows and follows != "(" and not duty_of(follows, lists) and follows not in lists.exceptions:
                break  # prose
            while ops and ops[-1] != "(" and binds[ops[-1]] >= binds[low]:
                output.append(ops.pop())
            if low == "with" and not (output and isinstance(output[-1], tuple)):
                valid = False  # only an identifier can have an exception
                break
            ops.append(low)
            operand = True
        elif part == ")" and "(" in ops:
            while ops[-1] != "(":
                output.append(ops.pop())
            ops.pop()
            output.append("(")  # a closed group, which no exception can follow
        else:
            break  # prose
    known = sorted({*names, *(p.lower() for p in parts[k:] if not valid and duty_of(p.lower(), lists))}) if parts else []
    if not valid or operand or "(" in ops:
        return known, None
    stack: list[int] = []
    for x in [*output, *reversed(ops)]:
        if isinstance(x, tuple):
            stack.append(RANK.index(duty_of(x[0], lists) or "permissive"))  # an exception's own place is not used
        elif x != "(":
            b, a = stack.pop(), stack.pop()
            stack.append(max(a, b) if x == "and" else min(a, b) if x == "or" else 1 if a == 2 else a)
    return known, RANK[stack[0]]


def scan_text(text: str | None, lists: Lists = OWN) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, duties)."""
    words = words_of(text)
    joined = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
    hits = [(end - len(p) - 1, p) for end, p in automaton().iter(joined)]
    if not hits:
        return len(words), 0, None, None, "", "", 0.0, None
    index = {start: k for k, start in enumerate(accumulate([0, *(len(w.decode("utf-8", "surrogatepass")) + 1 for w in words[:-1])]))}
    starts = [index[at] for at, p in hits if p in BASE]
    base = {BASE[p] for _, p in hits if p in BASE}
    labels = base | {NOTICES[p] for _, p in hits if p in NOTICES}
    places, duties = sum(p != TAG for _, p in hits), []
    if any(p == TAG for _, p in hits):
        for m in _TAG.finditer(text):
            names, duty = evaluate(m[1], lists)
            labels |= {n.replace(",", "") for n in names}
            duties += [duty] if duty else []
    score = 1.0 if duties else 1.0 - 0.5**places
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, max(duties, key=RANK.index) if duties else None


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, duties string"


def scan_licenses(docs: DataFrame, lists: Lists = OWN) -> DataFrame:
    """A row for each document, computed where it lies: see SCHEMA."""
    types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.string()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                found = zip(*(scan_text(t, lists) for t in part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(found, types))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, SCHEMA)
