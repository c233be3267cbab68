"""Batched enrichment by a pluggable function, with retries, and the parsing of what it returns.

An enricher is any picklable callable from a list of rows to a list of texts. It runs
in the tasks that hold the batches; a failing batch is split until single rows fail,
which get the fallback. No provider is called here: the default is deterministic."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Enricher = Callable[[list[dict]], list[str]]


def stub(rows: list[dict]) -> list[str]:
    """A deterministic answer for tests: the signals' names of a row as findings."""
    return [json.dumps({"findings": [{"type": s, "summary": f"{s} in {r.get('chunk_uid')}"} for s in r.get("signals") or []]}) for r in rows]


def bisect(rows: list[dict], run: Enricher, fallback: Callable[[dict, str], str], depth: int | None = None, attempt: int = 1) -> list[str]:
    """run(rows); on failure both halves in turn, until one row is left or the depth is reached."""
    depth = depth or math.ceil(math.log2(max(2, len(rows)))) + 2
    try:
        out = run(rows)
        if len(out) != len(rows):
            raise ValueError(f"{len(out)} answers for {len(rows)} rows")
        return out
    except Exception as e:  # any failure of the function counts
        if len(rows) <= 1 or attempt >= depth:
            return [fallback(r, str(e)) for r in rows]
        mid = math.ceil(len(rows) / 2)
        return bisect(rows[:mid], run, fallback, depth, attempt + 1) + bisect(rows[mid:], run, fallback, depth, attempt + 1)


def enrich(rows: DataFrame, run: Enricher = stub, batch: str = "batch", order: str = "ord", most: int = 8, fallback: Callable[[dict, str], str] | None = None) -> DataFrame:
    """rows with `answer` and `failed`; consecutive rows of a batch go to the function together, `most` at a time."""
    give_up = fallback or (lambda r, e: json.dumps({"error": e}))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failures: set[int] = set()

        def lost(r: dict, e: str) -> str:
            failures.add(r["__k"])
            return give_up(r, e)

        for b in batches:
            records = [r | {"__k": k} for k, r in enumerate(b.to_dict("records"))]
            answers: list[str] = []
            failures.clear()
            at = 0
            while at < len(records):
                z = at + 1
                while z < len(records) and z - at < most and records[z][batch] == records[at][batch]:
                    z += 1
                answers += bisect(records[at:z], run, lost)
                at = z
            yield b.assign(answer=answers, failed=[k in failures for k in range(len(records))])

    return rows.repartition(batch).sortWithinPartitions(batch, order).mapInPandas(walk, f"{fields}, answer string, failed boolean")


def dead_letters(answers: DataFrame, *keys: str) -> DataFrame:
    return answers.where("failed").select(*keys, "answer")


def strip_comments(text: str) -> str:
    """JSON text without // and /* */ comments outside strings."""
    return re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)


def json_values(text: str) -> list:
    """All whole JSON objects and arrays at the top level of a text, in order; what breaks off is skipped."""
    decoder, out, at = json.JSONDecoder(), [], 0
    while m := re.compile(r"[\[{]").search(text, at):
        try:
            value, at = decoder.raw_decode(text, m.start())
            out.append(value)
        except ValueError:
            at = m.start() + 1
    return out


def json_of(text: str | None) -> object:
    """The JSON of an answer: a fenced block, else the whole text, else its first whole
    value; of an array that breaks off, its whole objects. None without any."""
    text = text or ""
    for part in [*re.findall(r"```(?:json)?\s*(.*?)```", text, flags=re.S | re.I), text]:
        clean = strip_comments(part).strip()
        try:
            return json.loads(clean)
        except ValueError:
            pass
    values = json_values(strip_comments(text))
    opened = re.search(r'"findings"\s*:\s*\[|^\s*\[', text)
    if opened and values:
        return {"findings": [v for v in values if isinstance(v, dict)]}
    return values[0] if values else None


def records_of(value: object) -> list[dict]:
    """Findings of an answer: a list, {findings: [...]}, or one record."""
    if isinstance(value, dict):
        value = value.get("findings", [value])
    return [r for r in value if isinstance(r, dict)] if isinstance(value, list) else []


FINDING = "type string, severity string, summary string, location string, details string"


def parse_findings(answers: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, finding fields) of every answer; the recovery of broken JSON is a small helper for each text."""

    @F.pandas_udf(f"array<struct<{', '.join(f.replace(' ', ':') for f in FINDING.split(', '))}>>")
    def parse(col: pd.Series) -> pd.Series:
        text = lambda r, k: r[k] if isinstance(r.get(k), str) else None
        record = lambda r, k: json.dumps(r[k]) if isinstance(r.get(k), dict) else None
        return col.map(lambda a: [{"type": text(r, "type"), "severity": text(r, "severity"), "summary": text(r, "summary"), "location": record(r, "location"), "details": record(r, "details")} for r in records_of(json_of(a))])

    return answers.select(*keys, F.posexplode(parse(F.col("answer"))).alias("n", "f")).select(*keys, "n", "f.*")


def parse_signals(answers: DataFrame, known: list[str], column: str = "answer", *keys: str) -> DataFrame:
    """(keys, signal_id, evidence, confidence) of answers {signals: [...]}: unknown names and blank evidence are left out."""
    from riskloom.functions import text as t

    listed = F.from_json(F.get_json_object(column, "$.signals"), "array<struct<id:string,evidence:string,confidence:string>>")
    rows = answers.select(*keys, F.explode(listed).alias("s"))
    out = rows.select(*keys, F.lower(t.trim(F.col("s.id"))).alias("signal_id"), t.present(F.col("s.evidence")).alias("evidence"), t.confidence(F.col("s.confidence")).alias("confidence"))
    return out.where(F.col("signal_id").isin(*known) & F.col("evidence").isNotNull())
