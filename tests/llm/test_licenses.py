"""Licence expressions against trees that are evaluated as they are made, labels that are written out, and whole lists."""

import json
import random

import pytest

from riskloom.llm import op3_licenses as op3

#: What the names bring, written out here rather than taken from the module.
BRINGS = {"MIT": 0, "apache-2.0": 0, "MPL-2.0": 1, "LGPL-2.1-or-later": 1, "GPL-2.0-only": 2, "AGPL-3.0+": 2, "CC-BY-NC-4.0": 3, "LicenseRef-own.1": 3}
NAMES = ["permissive", "weak-copyleft", "copyleft", "restricted"]


def _tree(rng: random.Random, depth: int) -> tuple[str, int, int]:
    """(text, duties, how strongly its outermost operator binds)."""
    if depth == 0 or rng.random() < 0.2:
        name = rng.choice([*BRINGS])
        if rng.random() < 0.2:
            return f"{name} {rng.choice(['WITH', 'with'])} Classpath-exception-2.0", 1 if BRINGS[name] == 2 else BRINGS[name], 3
        return name, BRINGS[name], 3
    (a, x, p), (b, y, q) = _tree(rng, depth - 1), _tree(rng, depth - 1)
    binds, word = rng.choice([(1, "OR"), (2, "AND")])
    wrap = lambda s, k: f"({s})" if k < binds or rng.random() < 0.1 else s
    # the same operator to the right needs no brackets, for both are associative
    return f"{wrap(a, p)} {word} {wrap(b, q)}", min(x, y) if word == "OR" else max(x, y), binds


def test_expressions_mean_what_their_trees_mean():
    rng = random.Random(11)
    for _ in range(3000):
        text, duty, _ = _tree(rng, rng.randrange(5))
        names, got = op3.evaluate(text)
        assert got == NAMES[duty], text
        assert names == sorted({n.lower() for n in BRINGS if n.lower() in text.lower().replace("(", " ").replace(")", " ").split()}), text


@pytest.mark.parametrize(
    ("text", "labels", "score", "duties"),
    [
        ("SPDX-License-Identifier: MIT OR (GPL-2.0-only AND MPL-2.0)", "gpl-2.0-only,mit,mpl-2.0", 1.0, "permissive"),
        ("// spdx-license-identifier:Apache-2.0 and more words", "apache-2.0", 1.0, "permissive"),
        ("SPDX-License-Identifier: Nothing-1.0 AND MIT", "mit", 0.0, None),
        ("SPDX-License-Identifier: (MIT", "mit", 0.0, None),
        ("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: CC-BY-NC-4.0", "cc-by,cc-by-nc,cc-by-nc-4.0,mit", 1.0, "restricted"),
        ("The MIT License. All rights reserved.", "mit,reserved", 0.75, None),
        ("under the GNU Lesser General Public License", "gpl,lgpl", 0.75, None),
        ("Licensed under the Apache License, Version 2.0", "apache-2.0", 0.75, None),
        ("CC BY-SA 4.0", "cc-by,cc-by-sa", 0.75, None),
        ("a permit license, mit licenses, accby", "", 0.0, None),
        ("", "", 0.0, None),
        (None, "", 0.0, None),
    ],
)
def test_labels_as_written_out(text, labels, score, duties):
    got = op3.scan_text(text)
    assert got[5:] == (labels, score, duties)


def test_whole_lists(spark, tmp_path, monkeypatch):
    public = ["Glide", "Zimbra-1.4", "BSD-2-Clause-FreeBSD", "CC-BY-SA-2.1-JP", "MIT", "Odd+"]
    (tmp_path / "licenses.json").write_text(json.dumps({"licenseListVersion": "x", "licenses": [{"licenseId": n, "isOsiApproved": False} for n in public]}, indent=1))
    (tmp_path / "exceptions.json").write_text(json.dumps({"exceptions": [{"licenseExceptionId": "GPL-3.0-linking-exception"}, {"other": 1}]}))
    paths = (str(tmp_path / "licenses.json"), str(tmp_path / "exceptions.json"))
    lists = op3.read_lists(spark, *paths)
    texts = [f"SPDX-License-Identifier: {x}" for x in ("Glide", "zimbra-1.4 OR MIT", "GPL-2.0-only WITH GPL-3.0-linking-exception", "Odd+", "Odd", "BSD-2-Clause")]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate([*texts, None])], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.duties) for r in op3.scan_licenses(docs, lists).collect()}
    assert got == {0: ("glide", "restricted"), 1: ("mit,zimbra-1.4", "permissive"), 2: ("gpl-2.0-only", "weak-copyleft"), 3: ("odd+", "restricted"), 4: ("", None), 5: ("bsd-2-clause", "permissive"), 6: ("", None)}
    assert {r.doc_id for r in op3.scan_licenses(docs).where("duties IS NOT NULL").collect()} == {5}
    monkeypatch.setattr(op3, "MOST_NAMES", 3)
    with pytest.raises(ValueError, match="more than 3"):
        op3.read_lists(spark, *paths)
