"""Licenses found whole, edited and in company; alignment against a plain one."""

import random

import numpy as np
import odd

from runloom.llm import licenses as L
from runloom.llm.license_texts import TEMPLATES
from runloom.llm.queries import QUERIES

MIT = next(text for name, text in TEMPLATES if name == "MIT")
LINES = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.",
         "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
         "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}


def plain_banded(template, text, begin):
    """The best local alignment whose cells all lie in the band: (score, matched)."""
    best, cells = (0, 0), {}
    for i, a in enumerate(template):
        for b in range(2 * L.BAND + 1):
            j = begin - L.BAND + i + b
            same = (0 <= j < len(text) and text[j] == a
                    and abs(b - L.BAND) <= min(L.BAND, len(template) // 2))
            up = cells.get((i - 1, b), (0, 0))
            options = [(0, 0), (up[0] + L.MATCH, up[1] + 1) if same else (up[0] - L.MISS, up[1])]
            if (i - 1, b + 1) in cells:
                s, m = cells[i - 1, b + 1]
                options.append((s - L.GAP, m))
            if (i, b - 1) in cells:
                s, m = cells[i, b - 1]
                options.append((s - L.GAP, m))
            cells[i, b] = max(options)
            best = max(best, cells[i, b])
    return best


def test_banded_alignment():
    rng = random.Random(2)
    cases = []
    for _ in range(40):
        template = [rng.randint(1, 9) for _ in range(rng.randint(3, 30))]
        text = [rng.randint(1, 9) for _ in range(rng.randint(1, 60))]
        at = rng.randint(0, len(text))
        text[at:at] = [t for t in template if rng.random() < 0.85]
        cases.append((template, text, at))
    found = L.align_banded([np.array(c[0], np.uint64) for c in cases],
                           [np.array(c[1], np.uint64) for c in cases], [c[2] for c in cases])
    for (template, text, at), (matched, start, end) in zip(cases, found, strict=True):
        score, most = plain_banded(template, text, at)
        assert matched <= most or score == 0
        assert 0 <= start <= end <= len(text)
        assert matched <= end - start


def test_every_long_enough_stretch_meets_a_fingerprint():
    known = L.Templates()
    size = L.WINDOW + L.RUN - 1
    for template, words in enumerate(known.words):
        for at in range(0, max(1, len(words) - size + 1), 3):
            found = known.candidates(words[at:at + size])
            if len(words) >= size:
                assert any(t == template for t, _ in found)


def scan(spark, rows):
    return L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()


def test_whole_edited_and_in_company(spark):
    words = MIT.split()
    edited = " ".join("Acme" if i % 15 == 7 else w for i, w in enumerate(words) if i % 20 != 11)
    rows = [(1, f"before {MIT} after"), (2, f"some text. {edited} more"),
            (3, "first\n" + "\nthen ".join(LINES.values()) + "\nend"),
            (4, "a license is under discussion, and so is the version of it; licensed or released"),
            (5, " ".join(words[:20])), (7, "Released under the BSD License."), (6, f"{LINES['MIT']} {LINES['MIT']}")]
    got = {}
    for r in scan(spark, rows):
        got.setdefault(r["doc_id"], []).append(r)
    assert sorted(got) == [1, 2, 3, 6]
    [whole], [changed] = got[1], got[2]
    assert whole["license"] == "MIT" and whole["coverage"] == 1.0
    assert dict(rows)[1][whole["start"]:whole["end"]] == MIT.strip().rstrip(".")
    assert changed["license"] == "MIT" and 0.7 <= changed["coverage"] < 1.0
    assert [r["license"] for r in got[3]] == list(LINES)
    for r in got[3]:
        assert dict(rows)[3][r["start"]:r["end"]] == LINES[r["license"]].rstrip(".")
    assert len(got[6]) == 2


def test_odd_documents(spark):
    assert L.scan(odd.odd_documents(spark)).collect() == []
    assert L.scan(odd.no_documents(spark)).collect() == []
    line = LINES["Apache-2.0"]
    got = scan(spark, [(None, line), (1, line), (1, line), (2, None), (3, f"{odd.LONG} {line}")])
    assert odd.keyed((r["doc_id"], r["license"]) for r in got) == odd.keyed(
        [(None, "Apache-2.0"), (1, "Apache-2.0"), (1, "Apache-2.0"), (3, "Apache-2.0")])


def test_query_against_searching_for_lines(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for r in docs:
        for name, line in LINES.items():
            at = r["text"].find(line)
            while at >= 0:
                want.append((r["doc_id"], name, at, at + len(line) - 1))
                at = r["text"].find(line, at + 1)
    got = [(r["doc_id"], r["license"], r["start"], r["end"])
           for r in QUERIES["op7_licenses"](spark, sf_dir).collect()]
    assert want and odd.keyed(got) == odd.keyed(want)
