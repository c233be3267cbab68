"""Walks in order, row by row: what the library's rounds must give."""

from collections import namedtuple

from riskloom.operators.merging import LINES, SIMILAR, TEXTS

Finding = namedtuple("Finding", ["ord", *TEXTS, "words", *LINES])


def _same(a: str, b: str) -> bool:
    return bool(a) and a == b


def _differ(a: str, b: str) -> bool:
    return bool(a) and bool(b) and a != b


def near_lines(a, b, slack: int = 2) -> bool:
    """Whether two findings of one file touch, by lines or by chunk."""
    if _differ(a.repo_name, b.repo_name) or not _same(a.canonical_path, b.canonical_path):
        return False
    if a.lo > 0 and b.lo > 0:
        return max(1, a.lo - slack) <= b.hi + slack and max(1, b.lo - slack) <= a.hi + slack
    return a.chunk >= 0 and a.chunk == b.chunk


def same_lines(a, b) -> bool:
    if _differ(a.repo_name, b.repo_name) or not _same(a.canonical_path, b.canonical_path):
        return False
    if a.lo >= 0 and b.lo >= 0:
        return (a.lo, a.hi) == (b.lo, b.hi)
    return a.chunk >= 0 and a.chunk == b.chunk


def similar(a, b, at_lines: bool = False) -> bool:
    """Whether two findings say the same; at_lines also asks for touching lines and a common entry point."""
    if at_lines and not (near_lines(a, b) and _same(a.entry, b.entry)):
        return False
    if any(_differ(getattr(a, c), getattr(b, c)) for c in ("entry", "cand", "identity_type")):
        return False
    if _same(a.rule, b.rule):
        return True
    if not any(_same(getattr(a, c), getattr(b, c)) for c in ("cand", "identity_type", "entry")):
        return False
    if _same(a.dedupe_category, b.dedupe_category) or _same(a.kind_token, b.kind_token):
        return True
    x, y = set(a.words), set(b.words)
    return (len(x & y) / len(x | y) if x | y else 1.0) >= SIMILAR


def mergeable(a, b) -> bool:
    """The decision list, from the strongest evidence to the weakest."""
    if a.dedupe_category == b.dedupe_category and a.dedupe_category in ("rate_limiting", "lockout") and not _same(a.entry, b.entry):
        return False
    if _same(a.key, b.key):
        return True
    if any(_differ(getattr(a, c), getattr(b, c)) for c in ("rule", "cand", "entry")):
        return False
    apart = _differ(a.repo_name, b.repo_name)
    if _same(a.anchor_id, b.anchor_id):
        return not apart
    same_type = _same(a.identity_type, b.identity_type)
    if _same(a.overlap_id, b.overlap_id):
        return not apart and a.entry == b.entry and a.sym == b.sym and same_type
    if near_lines(a, b) and not (_same(a.rule, b.rule) or same_type):
        return False
    if same_lines(a, b):
        return same_type or _same(a.dedupe_category, b.dedupe_category)
    return similar(a, b, at_lines=True)


def clusters_of(findings):
    """ord -> ord of its cluster, findings in order."""
    clusters, out = [], {}
    for row in findings:
        for k, c in enumerate(clusters):
            if mergeable(c, row):
                fill = {f: getattr(row, f) for f in ("anchor_id", "overlap_id", "canonical_path") if not getattr(c, f)}
                if c.lo < 0 and not c.canonical_path:
                    fill |= {"lo": row.lo, "hi": row.hi}
                clusters[k] = c._replace(**fill)
                out[row.ord] = c.ord
                break
        else:
            clusters.append(row)
            out[row.ord] = row.ord
    return out


def matches_of(members, choices):
    """{(group, ord, actual)}: expectations in order each take their first free choice; choices: (group, class, actual, key, score)."""
    taken, out = set(), set()
    for g, c, k in sorted(members, key=lambda m: (m[0], m[2])):
        free = sorted((-score, key, a) for h, d, a, key, score in choices if (h, d) == (g, c) and (g, a) not in taken)
        if free:
            taken.add((g, free[0][2]))
            out.add((g, k, free[0][2]))
    return out
