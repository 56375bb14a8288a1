"""Base spans against the plain patterns, disclosure against hand-counted corpora."""

import hashlib
import math
import re
import time

import odd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runloom.llm import pii as P
from runloom.llm.queries import QUERIES

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match[0])
            good = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m[0].split(".")),
                    "card": lambda m: 14 <= len(digits) <= 19 and sum(
                        int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d))))
                        for i, d in enumerate(reversed(digits))) % 10 == 0,
                    "phone": lambda m: 10 <= len(digits) <= 15}[kind]
            if good(match):
                out.append((*match.span(), kind))
    return sorted(out, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


PIECES = ["a", "B", ".", "@", "-", "+", "1", "25", "4111 1111 1111 1111", " ", "(", ")", "é", "%", "_",
          "x.y", "300", "4", "+1 (555) 123-4567", "1.2.3.4", "0.0.0.0", "٣", "\n", "a@b.c"]


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=16).map("".join))
def test_base_spans(text):
    assert P.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize("text", ["a" * 100_000, "1" * 100_000, "1." * 50_000, "+1" * 50_000,
                                  "a@" * 50_000, "@" * 100_000, "1 " * 50_000, "+1" + " " * 100_000])
def test_long_runs_take_linear_time(text):
    begun = time.monotonic()
    spans = P.base_spans(text)
    assert time.monotonic() - begun < 5 and all(s[2] in ("ip", "card") for s in spans)


def corpus():
    """A name that occurs only beside one address, a title beside it and elsewhere, and common words."""
    rows = [(i, f"common words here number{i} and more") for i in range(200)]
    rows += [(1000 + i, f"write to Mister Quill, that is q@example.com about item{i}") for i in range(4)]
    rows += [(1100 + i, f"a letter for some Mister about thing{i}") for i in range(3)]
    rows += [(1200 + i, "copies all alike of Nomen x@example.com prove nothing") for i in range(5)]
    return rows


def test_terms_that_tell(spark):
    rows = corpus()
    n, n_e, n_t = len(rows), 4, 4
    assert math.log2(4 * n / (n_e * n_t)) / math.log2(n / n_e) == pytest.approx(1.0)
    title = math.log2(4 * n / (n_e * 7)) / math.log2(n / n_e)
    assert P.GENERALISE <= title < P.REMOVE
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in P.sanitise(docs).collect()}
    assert len(got) == len(rows)
    # The name goes, the title becomes more general, words that others use too stay.
    assert "Quill" not in got[1000] and "[EMAIL]" in got[1000] and "item0" in got[1000]
    assert "[NAME]" in got[1000] and "Mister" in got[1100]
    assert got[1200] == "copies all alike of Nomen [EMAIL] prove nothing"
    assert got[7] == dict(rows)[7]
    spans = {r["doc_id"]: r for r in P.query_rows(docs).collect()}
    text = dict(rows)[1000]
    found = {text[int(a):int(b)] for k, a, b in
             (s.split(":") for s in spans[1000]["spans"].split(",")) if k == "term"}
    assert {"Quill", "Mister"} <= found


@pytest.mark.parametrize("most_copied", [0, P.MOST_COPIED])
def test_copies_hide_no_term(spark, monkeypatch, most_copied):
    """Three texts name Quill beside one address, one of them 3000 times over; nobody else does."""
    monkeypatch.setattr(P, "MOST_COPIED", most_copied)
    rows = [(i, f"common words here number{i} and more") for i in range(300)]
    rows += [(1000 + i, f"write to Quill, q@example.com about item{i}") for i in range(3)]
    rows += [(2000 + i, rows[-1][1]) for i in range(3000)]
    got = dict(P.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert len(got) == len(rows) and not any("Quill" in t for t in got.values())
    assert "item2" in got[2000] and got[7] == dict(rows)[7]


def test_terms_tell_from_anywhere_in_a_text(spark):
    """A name in the heading, an address at the end; short names; an address of a third of few texts."""
    between = "some words that stand here in any letter of this kind and then a few more "
    rows = [(i, f"{between} page{i}") for i in range(12)]
    rows += [(100 + i, f"Al Zorin {between} note{i} q@example.com") for i in range(6)]
    got = dict(P.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    for i in range(6):
        assert got[100 + i].split() == f"{between} note{i} [EMAIL]".split()
    assert all(got[i] == t for i, t in rows[:12])
    # What every text holds tells nothing.
    rows = [(i, f"Al Zorin {between} note{i} q@example.com") for i in range(6)]
    got = dict(P.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {i: t.replace("q@example.com", "[EMAIL]") for i, t in rows}


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()


def expected(doc_id, text):
    spans = plain_spans(text or "")
    kinds = [s[2] for s in spans]
    return (doc_id, *[kinds.count(k) for k in PATTERNS], digest(spans))


COLUMNS = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def test_odd_documents(spark):
    got = P.query_rows(odd.odd_documents(spark)).collect()
    assert odd.keyed(tuple(r[c] for c in COLUMNS) for r in got) == odd.keyed(
        expected(*row) for row in odd.TEXTS)
    docs = odd.odd_documents(spark)
    rows = P.sanitise(docs)
    assert rows.columns == docs.columns and rows.dtypes == docs.dtypes
    texts = {r["doc_id"]: r for r in rows.collect()}
    assert texts[10]["text"] == "mail [EMAIL], call [PHONE], card [CARD], at [IP]"
    assert texts[10]["n_chars"] == len(texts[10]["text"]) and texts[2]["text"] is None
    assert texts[4]["text"] == odd.LONG
    for none in (P.query_rows(odd.no_documents(spark)), P.sanitise(odd.no_documents(spark))):
        assert none.collect() == []


def test_overlapping_spans_are_one():
    spans = [(0, 4, "card", "replace"), (2, 9, "phone", "replace"), (9, 12, "term", "remove")]
    assert P.sanitised_text("0123456789abc", spans) == "[CARD]c"


def test_query_against_the_patterns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op6_pii"](spark, sf_dir).collect()
    assert odd.keyed(tuple(r[c] for c in COLUMNS) for r in got) == odd.keyed(
        expected(*row) for row in docs)
    for r in got:
        base = [s for s in r["spans"].split(",") if s and not s.startswith("term:")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"]
