"""Repeated passages by sparse suffix arrays.

Suffixes are retained at the positions that are minimisers of some window: of the
`depth`-word grams in every `min_words`-word window, the one with the smallest hash.
Equal windows pick equal positions, so two documents that share a passage of
min_words words share a retained suffix in it, and every window belongs to one.

1. Retained suffixes whose first `depth` words start no suffix of another document
   are put aside by a hash of these words; that only spares them the sort.
2. Suffixes with equal surroundings become one member with its least and greatest
   doc_id, by a grouped aggregate, so a thousand copies are sorted once. The members are
   sorted in suffix order, by the bytes of their words, over range partitions. A run is
   what shares the first `depth` words. In a run neighbours are compared: the longest
   common prefix to the right, and, in the order of the words before the suffix read
   backwards, the longest common extension to the left. A window that starts o words
   before the suffix is shared by those that agree in o words to the left and
   min_words - o to the right; the two arrays of neighbours tell these groups.
3. A partition's first and last run may go on in the next one. What goes on beyond it
   agrees with the member at the edge, so all longer windows are settled inside. The
   members of the others are sorted once more, by the words before the suffix, where
   the same holds. Windows that agree with an edge in both orders are named by 128-bit
   digests, equal ones once a partition, and settled in the same way: sorted over range
   partitions, where a run at a partition's edge is settled by its least and greatest
   doc_id, at most two runs a partition. So a passage that a third of all documents
   share is spread over as many tasks as its rows need, and each of them sends its
   windows once, not once a document.
4. What is shared around a member goes to its suffixes by a plain join on the 128-bit
   digest of the member, which adaptive execution can split, and what is shared around
   neighbouring suffixes of a document grows together into spans.

Words stand between white space, A-Z lower-cased. Repeats within one document only
are not reported.

Cases: null, empty and short texts (under min_words words) have no spans; very long
texts are read whole, with memory in proportion to one text; rows with a null
doc_id cannot be named and take no part; repeated rows of one doc_id count as one
document, so a passage in two texts of the same doc_id only is no repeat; among
documents that tie the smallest doc_id is first_doc_id; an empty table gives no
rows; further columns are ignored, whatever their names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WordHash, forget, materialise, mix, space_words

MIN_WORDS, DEPTH = 50, 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SETTLE = 4096
_hash = WordHash()


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, by prefix polynomials modulo 2^64."""
    if len(words) < n:
        return words[:0]
    powers = np.cumprod(np.r_[np.uint64(1), np.full(len(words) - 1, _BASE, np.uint64)], dtype=np.uint64)
    inverse = np.cumprod(np.r_[np.uint64(1), np.full(len(words) - n, _INVERSE, np.uint64)], dtype=np.uint64)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words) * powers, dtype=np.uint64)])
    return mix((prefix[n:] - prefix[:-n]) * inverse)


def minimisers(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` grams, the position of its smallest (the leftmost of equals)."""
    n = len(grams) - width + 1
    best, at, span = grams[:], np.arange(len(grams)), 1
    while span < width:
        step = min(span, width - span)
        a, b = best[: len(best) - step], best[step:]
        right = b < a
        best, at = np.where(right, b, a), np.where(right, at[step:], at[: len(at) - step])
        span += step
    return at[:n]


def _plain(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def suffixes(docs: DataFrame, min_words: int, depth: int) -> DataFrame:
    """(k1, k2, doc_id, at) of the retained suffixes; k1 is a hash of their first words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                keys, ids, places = [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = space_words(text)
                    if len(words) < min_words:
                        continue
                    grams = rolling(_hash.of(words), depth)
                    at = np.unique(minimisers(grams, min_words - depth + 1))
                    keys.append(grams[at].view(np.int64))
                    ids.append(np.full(len(at), doc, np.int64))
                    places.append(at.astype(np.int64))
                if keys:
                    key, doc, at = (np.concatenate(c) for c in (keys, ids, places))
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.zeros(len(key), np.int64)), pa.array(doc), pa.array(at)], ["k1", "k2", "doc_id", "at"])

    return _plain(docs).mapInArrow(run, "k1 long, k2 long, doc_id long, at long")


def shared_by_documents(rows: DataFrame, name: str, least: bool = True) -> DataFrame:
    """(doc_id, at, lo) of the rows(k1, k2, doc_id, at) whose key another document has as
    well; at is a place or any number that tells the rows; lo is the smallest doc_id with the
    key, left out unless `least`. Rows are sorted over range partitions. The runs at the edges
    of a partition, two at most, are settled by their least and greatest doc_id, which come to
    the driver and go out again; where two documents stand in the partition itself, only lo
    has to wait for that."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, run = True, [], None

        def out(k1, k2, doc, at, lo, sure):
            cols = [*(pa.array(c) for c in (k1, k2, doc, at, lo)), pa.array([sure] * len(doc), pa.bool_())]
            return pa.RecordBatch.from_arrays(cols, ["k1", "k2", "doc_id", "at", "lo", "sure"])

        def close(edge: bool):
            k1, k2, doc, at = (np.concatenate(c) for c in zip(*held))
            two = doc[0] != doc[-1]  # sorted by document within the run
            if edge and (least or not two):
                yield out(k1, k2, doc, at, np.zeros(len(doc), np.int64), False)
                return
            if edge:  # what other partitions need to know of it
                yield out(k1[[0, -1]], k2[[0, -1]], doc[[0, -1]], at[[0, -1]], np.zeros(2, np.int64), None)
            if two:
                yield out(k1 * 0, k2 * 0, doc, at, np.full(len(doc), doc[0]), True)

        for b in batches:
            if not b.num_rows:
                continue
            k1, k2, doc, at = (b.column(c).to_numpy() for c in range(4))
            cut = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            goes_on = run == (k1[0], k2[0])
            if held and not goes_on:
                yield from close(first)
                first, held = False, []
            if not len(cut):
                held.append((k1, k2, doc, at))
                run = (k1[0], k2[0])
                continue
            held.append(tuple(c[: cut[0]] for c in (k1, k2, doc, at)))
            yield from close(first)
            first = False
            lo, hi = cut[:-1], cut[1:] - 1
            shared = doc[lo] != doc[hi]
            keep, first_doc = np.repeat(shared, hi - lo + 1), np.repeat(doc[lo], hi - lo + 1)
            inner = slice(cut[0], cut[-1])
            yield out(np.zeros(keep.sum(), np.int64), np.zeros(keep.sum(), np.int64), doc[inner][keep], at[inner][keep], first_doc[keep], True)
            held, run = [tuple(c[cut[-1] :] for c in (k1, k2, doc, at))], (k1[-1], k2[-1])
        if held:
            yield from close(True)

    order = ["k1", "k2", "doc_id", "at"]
    ordered = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialise(ordered.mapInArrow(settle, "k1 long, k2 long, doc_id long, at long, lo long, sure boolean"), name)
    ends = found.where("NOT coalesce(sure, false)").groupBy("k1", "k2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("k1", "k2", "lo").collect()  # two a partition at most
    smallest = {(r["k1"], r["k2"]): r["lo"] for r in ends}

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = [smallest.get(k) for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            there = pa.array([x is not None for x in lo], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), pa.array(lo, pa.int64())], ["doc_id", "at", "lo"]).filter(there)

    settled = found.where("NOT sure").select("k1", "k2", "doc_id", "at").mapInArrow(look_up, "doc_id long, at long, lo long")
    both = found.where("sure").select("doc_id", "at", "lo").union(settled)
    return both if least else both.drop("lo")


def digests(texts: Iterable[bytes]) -> np.ndarray:
    """128-bit digests, two columns of a row each."""
    return np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in texts), np.int64).reshape(-1, 2)


def surroundings(docs: DataFrame, places: DataFrame, min_words: int, depth: int) -> DataFrame:
    """(m1, m2, to_right, to_left, doc_id, at): for each suffix of places(doc_id, at) the words of
    its windows from the suffix on, and those before it read backwards, each word ended by a
    blank, and a digest of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 100):
                part = b.slice(k, 100)
                out: list[list] = [[], [], [], []]
                for doc, text, kept in zip(*(c.to_pylist() for c in part.columns)):
                    words, kept = space_words(text), set(kept)
                    if len(words) < min_words:
                        continue
                    owner = minimisers(rolling(_hash.of(words), depth), min_words - depth + 1)
                    own, first = np.unique(owner, return_index=True)  # owners ascend with their windows
                    end = np.r_[first[1:], len(owner)]
                    ended = [w + b" " for w in words]
                    for p, s, z in zip(own.tolist(), first.tolist(), end.tolist()):
                        if p in kept:
                            out[0].append(b"".join(ended[p : z - 1 + min_words]))
                            out[1].append(b"".join(ended[s:p][::-1]))
                            out[2].append(doc)
                            out[3].append(p)
                if out[0]:
                    keys = digests(b"\n".join(side) for side in zip(out[0], out[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], ["m1", "m2", "to_right", "to_left", "doc_id", "at"])

    listed = places.groupBy("doc_id").agg(F.collect_set("at").alias("kept"))  # as many as a document has
    return _plain(docs).join(listed, "doc_id").select("doc_id", "text", "kept").mapInArrow(run, "m1 long, m2 long, to_right binary, to_left binary, doc_id long, at long")


def common_words(a: bytes, b: bytes) -> int:
    """The number of leading words, each ended by a blank, that a and b share."""
    if a == b:
        return a.count(b" ")
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # the longest common prefix of bytes
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return a.count(b" ", 0, lo)


def neighbours(texts: list[bytes]) -> np.ndarray:
    """For each of the sorted texts, the words it shares with the one before (0 for the first)."""
    return np.array([0, *(common_words(a, b) for a, b in zip(texts, texts[1:]))], np.int64)


def equal_windows(right: list[bytes], left: list[bytes], run: np.ndarray, min_words: int, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For members of runs in suffix order and each o: the members that have a window starting
    o words before the suffix, and the number of the group of equal windows that it is in."""
    m = len(right)
    back = sorted(range(m), key=lambda k: (run[k], left[k]))
    ahead, behind = neighbours(right), neighbours([left[k] for k in back])
    new_run = np.r_[True, run[1:] != run[:-1]]  # the same places in both orders
    n_right, n_left = (np.array([t.count(b" ") for t in side]) for side in (right, left))
    for o in range(min_words - depth + 1):
        there = np.flatnonzero((n_left >= o) & (n_right >= min_words - o))
        if not len(there):
            continue
        behind_group = np.empty(m, np.int64)
        behind_group[back] = np.cumsum(new_run | (behind < o))
        _, group = np.unique((np.cumsum(new_run | (ahead < min_words - o)) * (m + 1) + behind_group)[there], return_inverse=True)
        yield o, there, group


def ends_of_groups(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least lo and the greatest hi of each group 0..n-1."""
    n = group.max() + 1
    least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(least, group, lo)
    np.maximum.at(most, group, hi)
    return least, most


def shared_windows(right: list[bytes], left: list[bytes], run: np.ndarray, lo: np.ndarray, hi: np.ndarray, min_words: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For members of runs in suffix order, a row each: the smallest doc_id that has its
    window starting o words before the suffix, in column o, and whether two documents have
    it. lo and hi are the least and greatest doc_id of each member."""
    smallest, shared = np.zeros((len(right), min_words - depth + 1), np.int64), np.zeros((len(right), min_words - depth + 1), bool)
    for o, there, group in equal_windows(right, left, run, min_words, depth):
        least, most = ends_of_groups(group, lo[there], hi[there])
        shared[there, o], smallest[there, o] = (least != most)[group], least[group]
    return smallest, shared


def reach_of_edges(right: list[bytes], first: bool, last: bool) -> np.ndarray:
    """For each of the sorted members of one run, the words it shares with the first or the
    last one, where the run may go on before or after them. A window that goes on for more
    words is shared with these members only: what stands between two equal beginnings in the
    order begins like them."""
    ahead = neighbours(right)
    reach = np.zeros(len(right), np.int64)
    if first:
        reach = np.maximum(reach, np.minimum.accumulate(np.r_[right[0].count(b" "), ahead[1:]]))
    if last:
        reach = np.maximum(reach, np.minimum.accumulate(np.r_[ahead[1:], right[-1].count(b" ")][::-1])[::-1])
    return reach


def stretches(keys: np.ndarray, ok: np.ndarray, least: np.ndarray) -> dict[str, np.ndarray]:
    """m1, m2, a, z, lo for the runs of windows in the columns o of ok, a row for each member of
    `keys`; a and z count from the member's suffix, back to front."""
    top = ok.shape[1] - 1
    ok, least = ok[:, ::-1], least[:, ::-1]  # descending o is ascending window starts
    edge = np.diff(np.pad(ok.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    who, begin = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    lows = np.array([least[k, s:e].min() for k, s, e in zip(who, begin, end)], np.int64)
    return {"m1": keys[who, 0], "m2": keys[who, 1], "a": begin - top, "z": end - top - 1, "lo": lows}


_LONGS, _BYTES, _LISTS = ["m1", "m2", "a", "z", "lo", "hi", "reach", "part", "number", "k1", "k2", "begin"], ["head", "to_left", "to_right"], ["numbers"]
_TYPES = {c: pa.int64() for c in _LONGS} | {c: pa.binary() for c in _BYTES} | {c: pa.list_(pa.int64()) for c in _LISTS}
_SCHEMA = ", ".join([f"{c} long" for c in _LONGS] + [f"{c} binary" for c in _BYTES] + [f"{c} array<long>" for c in _LISTS])


def _batch(known: dict) -> pa.RecordBatch:
    n = len(next(iter(known.values())))
    return pa.RecordBatch.from_arrays([pa.array(known[c], t) if c in known else pa.nulls(n, t) for c, t in _TYPES.items()], list(_TYPES))


def settled(members: list[tuple], keep: np.ndarray | None, min_words: int, depth: int) -> Iterator[pa.RecordBatch]:
    """What is shared around members (right, left, run, lo, hi, m1, m2) in suffix order; of
    their windows those in `keep`, a row each and a column for each o, or all."""
    right, left, run, lo, hi, m1, m2 = (list(c) for c in zip(*members))
    least, ok = shared_windows(right, left, np.array(run), np.array(lo), np.array(hi), min_words, depth)
    if keep is not None:
        ok &= keep
    if ok.any():
        yield _batch(stretches(np.array([m1, m2]).T, ok, least))


def compare(rows: DataFrame, min_words: int, depth: int) -> DataFrame:
    """Sorts the members of rows(m1, m2, to_right, to_left, doc_id, at) and compares neighbours:
    (m1, m2, a, z, lo) for windows a..z from the suffix that several documents have. Of the runs
    at a partition's edges the windows that may go on beyond it stay open: (head, to_left,
    to_right, reach, m1, m2, lo, hi) is a member whose windows of up to `reach` words from the
    suffix on are open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, held, number, head = [], [], 0, None
        offsets = np.arange(min_words - depth + 1)

        def close(first: bool, last: bool):
            nonlocal ready
            if first or last:
                right, left, _, lo, hi, m1, m2 = (list(c) for c in zip(*held))
                reach = reach_of_edges(right, first, last)
                yield from settled(held, reach[:, None] < min_words - offsets, min_words, depth)
                some = [k for k, r in enumerate(reach) if min_words - r <= min(left[k].count(b" "), min_words - depth)]
                if some:
                    yield _batch({"head": [head] * len(some), "to_left": [left[k] for k in some], "to_right": [right[k] for k in some], "reach": reach[some]} | {c: [v[k] for k in some] for c, v in (("m1", m1), ("m2", m2), ("lo", lo), ("hi", hi))})
            elif len(held) > 1 or held[0][3] != held[0][4]:
                ready += held
                if len(ready) >= _SETTLE:
                    yield from settled(ready, None, min_words, depth)
                    ready = []

        for b in batches:
            for right, left, *known in zip(*(c.to_pylist() for c in b.columns)):
                if head is None or not right.startswith(head):
                    if held:
                        yield from close(number == 1, False)
                    number, held, end = number + 1, [], -1
                    for _ in range(depth):
                        end = right.index(b" ", end + 1)
                    head = right[: end + 1]
                held.append((right, left, number, *known))
        if held:
            yield from close(number == 1, True)
        if ready:
            yield from settled(ready, None, min_words, depth)

    members = rows.groupBy("m1", "m2", "to_right", "to_left").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    order = ["to_right", "to_left"]
    sorted_ = members.select(*order, "lo", "hi", "m1", "m2").repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(sorted_.mapInArrow(run, _SCHEMA), "suffix-neighbours")


def compare_backwards(found: DataFrame, min_words: int, depth: int) -> DataFrame:
    """Sorts the members that compare() left open by the words before the suffix and compares
    neighbours again: (m1, m2, a, z, lo) as there. Only windows that agree with an edge in
    both orders stay open: (part, number, k1, k2, lo, hi) is a digest of each different one
    with its least and greatest doc_id, and (part, m1, m2, begin, numbers) a member with
    the numbers of its open windows, which start begin, begin + 1, ... words before the suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, named, number, head, held = TaskContext.get().partitionId(), 0, 0, None, []

        def close(first: bool, last: bool):
            nonlocal named
            behind = reach_of_edges([m[1] for m in held], first, last) if first or last else np.full(len(held), -1)
            suffix_order = sorted(range(len(held)), key=lambda k: held[k][:2])
            members, behind = [held[k][:-1] for k in suffix_order], behind[suffix_order]
            ahead = np.array([held[k][-1] for k in suffix_order])
            offsets = np.arange(min_words - depth + 1)
            left_open = ahead[:, None] >= min_words - offsets
            at_edge = left_open & (offsets <= behind[:, None])
            yield from settled(members, left_open & ~at_edge, min_words, depth)
            right, left, one_run, lo, hi, m1, m2 = (list(c) for c in zip(*members))
            lo, hi = np.array(lo), np.array(hi)
            numbers: list[list[int]] = [[] for _ in members]
            begin = np.zeros(len(members), np.int64)
            for o, there, group in equal_windows(right, left, np.array(one_run), min_words, depth):
                within = at_edge[there, o]
                if not within.any():
                    continue
                there = there[within]
                _, leader, group = np.unique(group[within], return_index=True, return_inverse=True)
                least, most = ends_of_groups(group, lo[there], hi[there])
                keys = digests(b" ".join(left[k].split(b" ")[:o][::-1] + right[k].split(b" ")[: min_words - o]) for k in there[leader])
                yield _batch({"part": np.full(len(leader), part), "number": named + np.arange(len(leader)), "k1": keys[:, 0], "k2": keys[:, 1], "lo": least, "hi": most})
                for k, g in zip(there.tolist(), group.tolist()):
                    if not numbers[k]:
                        begin[k] = o
                    numbers[k].append(named + g)
                named += len(leader)
            some = [k for k, n in enumerate(numbers) if n]
            if some:
                yield _batch({"part": np.full(len(some), part), "m1": [m1[k] for k in some], "m2": [m2[k] for k in some], "begin": begin[some], "numbers": [numbers[k] for k in some]})

        for b in batches:
            for start, left, right, reach, *known in zip(*(c.to_pylist() for c in b.columns)):
                if start != head:
                    if held:
                        yield from close(number == 1, False)
                    number, held, head = number + 1, [], start
                held.append((right, left, number, *known, reach))
        if held:
            yield from close(number == 1, True)

    order = ["head", "to_left", "to_right"]
    members = found.where("head IS NOT NULL").select(*order, "reach", "lo", "hi", "m1", "m2")
    return materialise(members.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _SCHEMA), "suffix-backwards")


def across_partitions(found: DataFrame, min_words: int, depth: int) -> DataFrame:
    """(m1, m2, a, z, lo) of the windows that compare_backwards() left open. Each partition names a
    window once; its least and greatest doc_id stand for all documents that have it there.
    What is settled goes back to the members of the same partition."""
    each = found.where("k1 IS NOT NULL").select("k1", "k2", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("doc_id"), F.expr("(part << 32) + number").alias("at"))
    shared = shared_by_documents(each, "suffix-windows").groupBy("at").agg(F.min("lo").alias("lo"))
    shared = shared.select(F.expr("at >> 32").alias("part"), F.expr("at & 4294967295").alias("number"), "lo")
    members = found.where("numbers IS NOT NULL").select("part", "m1", "m2", "begin", "numbers")

    def place(ours: pa.Table, known: pa.Table) -> pa.Table:
        low = dict(zip(known["number"].to_pylist(), known["lo"].to_pylist()))
        ok = np.zeros((ours.num_rows, min_words - depth + 1), bool)
        least = np.zeros(ok.shape, np.int64)
        for k, (begin, numbers) in enumerate(zip(ours["begin"].to_pylist(), ours["numbers"].to_pylist())):
            for o, n in enumerate(numbers, begin):
                if n in low:
                    ok[k, o], least[k, o] = True, low[n]
        return pa.table(stretches(np.array([ours["m1"].to_numpy(), ours["m2"].to_numpy()]).T, ok, least))

    return members.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(place, "m1 long, m2 long, a long, z long, lo long")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, depth: int = DEPTH) -> DataFrame:
    """Maximal runs of words of which every min_words-word window also stands in
    another document: doc_id, start_word, end_word (past the last), n_words, and
    first_doc_id, the smallest doc_id that has one of its windows."""
    retained = materialise(suffixes(docs, min_words, depth), "suffixes")
    places = materialise(shared_by_documents(retained, "suffix-order", least=False), "suffix-places")
    forget(retained)
    words = materialise(surroundings(docs, places, min_words, depth), "suffix-words")  # read twice, and range partitions are drawn from a first pass
    forget(places)
    found = compare(words, min_words, depth)
    members = materialise(words.select("m1", "m2", "doc_id", "at"), "suffix-members")
    forget(words)
    again = compare_backwards(found, min_words, depth)
    shared = found.union(again).where("a IS NOT NULL").select("m1", "m2", "a", "z", "lo").union(across_partitions(again, min_words, depth))
    hits = members.join(shared, ["m1", "m2"]).select("doc_id", (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("z")).alias("z"), "lo")
    by_place = W.partitionBy("doc_id").orderBy("a", "z")
    reach = F.max("z").over(by_place.rowsBetween(W.unboundedPreceding, -1))
    begins = hits.withColumn("new", F.when(F.col("a") <= reach + 1, 0).otherwise(1))
    spans = begins.withColumn("island", F.sum("new").over(by_place.rowsBetween(W.unboundedPreceding, 0))).groupBy("doc_id", "island").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.min("lo").alias("first_doc_id"))
    return spans.select("doc_id", F.col("a").cast("long").alias("start_word"), (F.col("z") + min_words).cast("long").alias("end_word"), (F.col("z") - F.col("a") + min_words).cast("long").alias("n_words"), "first_doc_id")
