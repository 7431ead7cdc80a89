"""Operator 4: licences in the middle of other text."""

from __future__ import annotations

import re

import numpy as np

from leadline.llm import licenses

FILLER = " ".join(f"filler{i}" for i in range(400))


def body(name):
    return max((t for n, t in licenses.templates() if n == name), key=len)


def test_passages_in_other_text(spark):
    mit = body("MIT")
    a, b = mit.index("The above"), mit.index("THE SOFTWARE IS")
    three = f"{mit[:a]}\n\n{mit[a:b]}\n\n{mit[b:]}"
    bsd = body("BSD-2-Clause").replace("1. ", "\n\n1. ").replace("2. ", "\n2. ").replace("THIS SOFTWARE", "\n\nTHIS SOFTWARE", 1)
    copies = "\n\n".join(f"{FILLER} c{i}\n\n{three}" for i in range(3))
    rows = {
        "readme": (f"# Tool\n\n{FILLER}\n\n{three}\n\n{FILLER}", [("MIT", "passage", 401, 1.0)]),
        "inline": (f"{FILLER} Released under the MIT License. {FILLER}", [("MIT", "passage", 400, 1.0)]),
        "bsd": (f"{FILLER}\n\n{bsd}\n\n{FILLER}", [("BSD-2-Clause", "passage", 400, 1.0)]),
        "line": (f"{FILLER}\nReleased under the MIT License.", [("MIT", "line", 1, 1.0)]),
        "none": (f"{FILLER} the software is licensed under terms of license", []),
        "copies": (copies, None),
    }
    got = {r["doc_id"]: [(m["license"], m["unit"], m["no"], round(m["dice"], 9)) for m in r["licenses"]] for r in licenses.scan(spark.createDataFrame([(k, t) for k, (t, _) in rows.items()], "doc_id string, text string")).collect()}
    for k, (_, want) in rows.items():
        assert want is None or got[k] == want, k
    assert [m[:2] + m[3:] for m in got["copies"]] == [("MIT", "passage", 1.0)] * 3


def test_nearest_passage_is_the_nearest_window(spark):
    rng = np.random.default_rng(5)
    template = "a b c d e f g h i j a c"
    b = licenses.bigrams(template)
    rows = []
    for i in range(60):
        w = list(rng.choice(list("abcdefghijxyz"), 40))
        part = template.split(" ")
        for k in rng.integers(0, len(part), rng.integers(0, 4)):
            part[k] = "x"
        w[10:10] = part
        rows.append((i, " ".join(w)))
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), known=[("T", template)]).collect():
        pairs = [f"{x} {y}" for x, y in zip(r["text"].split(" "), r["text"].split(" ")[1:])]
        every = [2 * len(b & set(pairs[i:j])) / (len(b) + len(set(pairs[i:j]))) for i in range(len(pairs)) for j in range(i + 1, min(len(pairs), i + licenses.SPAN * len(b)) + 1)]
        best = max(every) if max(every) >= 0.8 - 1e-9 else 0
        assert abs(max((m["dice"] for m in r["licenses"]), default=0) - best) < 1e-9, r["text"]


def test_full_texts_are_found(spark):
    """Each public text, broken into lines and set among other words, is told as itself."""
    rows = [(n, "Some words before it stand here.\n\n" + re.sub(r"((?:\S+\s+){9})", r"\1\n", t) + "\n\nAnd a few more after it.") for n, t in licenses.TEXTS.items()]
    rows += [("GPL-3.0", "x\n" + t) for n, t in licenses.templates() if n == "GPL-3.0" and "useful" in t]
    got = licenses.scan(spark.createDataFrame(rows, "name string, text string")).collect()
    assert all(r["name"] in {m["license"] for m in r["licenses"]} for r in got)
