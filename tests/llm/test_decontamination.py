"""Alignment against a plain Smith-Waterman, matches against comparing everything with everything."""

import random

import numpy as np
import odd

from runloom.llm import decontamination as D
from runloom.llm.features import WORD
from runloom.llm.queries import QUERIES


def plain_score(item, words):
    """The published recurrence over whole texts."""
    best, row = 0, [0] * (len(words) + 1)
    for a in item:
        new = [0]
        for j, b in enumerate(words):
            new.append(max(0, row[j] + (D.MATCH if a == b else -D.MISS), row[j + 1] - D.GAP,
                           new[j] - D.GAP))
        row = new
        best = max(best, *row)
    return best


def test_alignment():
    rng = random.Random(3)
    pairs = []
    for _ in range(60):
        item = [rng.randint(1, 6) for _ in range(rng.randint(3, 25))]
        words = [rng.randint(1, 6) for _ in range(rng.randint(1, 50))]
        pairs.append((np.array(item, np.uint64), np.array(words, np.uint64)))
    found = D.align([p[0] for p in pairs], [p[1] for p in pairs])
    for (item, words), (score, start, end) in zip(pairs, found, strict=True):
        assert score == plain_score(item.tolist(), words.tolist())
        if score:  # the span alone gives the score again
            assert plain_score(item.tolist(), words[start:end].tolist()) == score


ITEMS = [(1, "The quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree"),
         (2, "A completely different question about the boiling point of water on high mountains in summer"),
         (3, "too short"), (4, None), (5, "")]


def documents():
    rng = random.Random(1)
    filler = lambda n: " ".join(f"w{rng.randint(0, 900)}" for _ in range(n))
    words = ITEMS[0][1].split()
    edited = " ".join("XX" if i % 7 == 3 else w for i, w in enumerate(words))
    shorter = " ".join(w for i, w in enumerate(words) if i % 6 != 2)
    rows = [(i, filler(120)) for i in range(300)]
    rows += [(1000, f"{filler(40)} {ITEMS[0][1].upper()}! {filler(40)}"), (1001, f"{filler(30)} {edited}"),
             (1002, f"{shorter} {filler(50)}"), (1003, f"{filler(10)} the quick brown fox {filler(60)}"),
             (1004, f"{ITEMS[1][1]} {filler(9)} {ITEMS[0][1]}")]
    return rows


def test_copies_edits_and_clean_documents(spark):
    docs = spark.createDataFrame(documents(), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.matches(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {
        (1000, 1), (1001, 1), (1002, 1), (1004, 1), (1004, 2)}
    texts = dict(documents())
    for r in got:
        part = texts[r["doc_id"]][r["start"]:r["end"]]
        item = dict(ITEMS)[r["item_id"]]
        if r["doc_id"] in (1000, 1004):
            assert r["score"] == 1.0 and part.lower() == item.lower()
        else:
            assert 0.5 <= r["score"] < 1.0
    kept = {r["doc_id"] for r in D.drop_contaminated(docs, items).collect()}
    assert kept == {i for i, _ in documents()} - {1000, 1001, 1002, 1004}


def test_a_passage_that_most_documents_share_is_found(spark):
    rows = [(i, f"start{i} {ITEMS[0][1]} end{i}") for i in range(200)] + [(500, "nothing of it here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {r["doc_id"] for r in D.matches(docs, items).collect()} == set(range(200))


def test_a_frequent_edited_passage_is_found(spark):
    """Every fifth word replaced, in 1% of the documents, alone and beside exact copies."""
    words = ITEMS[0][1].split()
    clean = [(i, f"nothing of it here but number {i}") for i in range(400)]
    edited = [(1000 + i, f"start{i} " + " ".join(f"x{i}" if k % 5 == 4 else w for k, w in enumerate(words)))
              for i in range(4)]
    exact = [(2000 + i, f"{ITEMS[0][1]} end{i}") for i in range(4)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for rows in (edited, edited + exact):
        docs = spark.createDataFrame(clean + rows, "doc_id long, text string")
        assert {r["doc_id"] for r in D.matches(docs, items).collect()} == {i for i, _ in rows}


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(documents(), "doc_id long, text string")
    items = spark.createDataFrame([*ITEMS, (1, ITEMS[0][1]), (9, ITEMS[1][1])], "item_id long, text string")
    want = odd.keyed(D.matches(docs, items).collect())
    monkeypatch.setattr(D, "BLOCK_WORDS", 8)
    assert len(D.blocks_of(items)) > 3
    assert odd.keyed(D.matches(docs, items).collect()) == want


def test_long_parts_and_very_short_items(spark):
    rng = random.Random(6)
    item = [f"i{rng.randint(0, 5000)}" for _ in range(300)]
    filler = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(filler[:50] + item[100:240] + filler[50:])),
            (2, " ".join(filler[:50] + item[10:40] + filler[50:])),  # too short a part
            (3, "Two, words!"), (4, "two words and more"), (5, "one"), (6, " ".join(item[:45]))]
    items = [(1, " ".join(item)), (2, "two words"), (3, "One."), (4, "...")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = D.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (3, 2), (5, 3), (6, 1)}
    texts = dict(rows)
    parts = {r["doc_id"]: texts[r["doc_id"]][r["start"]:r["end"]] for r in got}
    assert parts[1] == " ".join(item[100:240]) and parts[3] == "Two, words"
    assert {r["doc_id"]: r["score"] for r in got}[3] == 1.0


def test_a_long_text_with_a_run_that_all_items_hold_stays_small():
    """36,000 words and 1,500 items that share a phrase, within a bound of memory."""
    import tracemalloc
    rng = random.Random(7)
    phrase = "which of the following is".split()
    texts = [" ".join(phrase + [f"q{rng.randint(0, 4000)}" for _ in range(30)]) for _ in range(1500)]
    items = D.Items(list(enumerate(texts)))
    words = []
    while len(words) < 36_000:
        words += phrase + [f"q{rng.randint(0, 4000)}" for _ in range(7)]
    hashes = items.vocabulary.hashes(" ".join(words))
    tracemalloc.start()
    found = D.windows_of(items, hashes, D.LEAST_SCORE)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6


def test_words_within_windows():
    rng = random.Random(5)
    for _ in range(100):
        item = np.array([rng.randint(1, 9) for _ in range(rng.randint(1, 8))], np.uint64)
        words = np.array([rng.randint(0, 15) for _ in range(30)], np.uint64)
        low = np.array(sorted(rng.randint(0, 29) for _ in range(5)))
        high = np.minimum(30, low + rng.randint(0, 12))
        want = [np.isin(item, words[a:b]).sum() for a, b in zip(low, high, strict=True)]
        assert D.words_within(item, words, low, high).tolist() == want


def test_the_item_in_the_long_text_is_found():
    rng = random.Random(7)
    phrase = "which of the following is".split()
    texts = [" ".join(phrase + [f"q{rng.randint(0, 4000)}" for _ in range(30)]) for _ in range(150)]
    items = D.Items(list(enumerate(texts)))
    words = []
    while len(words) < 36_000:
        words += phrase + [f"q{rng.randint(0, 4000)}" for _ in range(7)]
    words[20_000:20_035] = texts[77].split()
    found = D.windows_of(items, items.vocabulary.hashes(" ".join(words)), D.LEAST_SCORE)
    assert any(item == 77 and a <= 20_000 and b >= 20_035 for item, a, b in found)


def test_stretches_find_what_whole_texts_hold(monkeypatch):
    rng = random.Random(8)
    items = D.Items([(i, " ".join(f"a{rng.randint(0, 60)}" for _ in range(12))) for i in range(10)])
    text = " ".join(f"a{rng.randint(0, 60)}" if rng.random() < .5 else "zz" for _ in range(800))
    for i in range(10):
        at = 60 * i + 40
        parts = text.split()
        parts[at:at + 12] = [w for w in D.WORD.findall(" ".join(
            k for k, v in items.vocabulary.known.items() if v in set(items.words[i].tolist())))][:12]
        text = " ".join(parts)
    hashes = items.vocabulary.hashes(text)

    def best():
        scores = {}
        windows = D.windows_of(items, hashes, 0.3)
        sides = D.align([items.words[w[0]] for w in windows], [hashes[w[1]:w[2]] for w in windows])
        for (item, *_), (score, *_) in zip(windows, sides, strict=True):
            scores[item] = max(score, scores.get(item, 0))
        return {i: s for i, s in scores.items() if s >= 8}

    whole = best()
    monkeypatch.setattr(D, "STRETCH", 50)
    assert whole and best() == whole


def test_odd_documents(spark):
    docs, items = odd.odd_documents(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.matches(docs, items).collect() == []
    more = spark.createDataFrame([(7, "same text in two rows"), (None, "a row without an id")],
                                 "item_id long, text string")
    got = [(r["doc_id"], r["item_id"], r["score"]) for r in D.matches(docs, more).collect()]
    assert odd.keyed(got) == odd.keyed([(8, 7, 1.0), (8, 7, 1.0), (9, 7, 1.0), (None, None, 1.0)])
    kept = D.drop_contaminated(docs, more)
    assert kept.columns == docs.columns
    assert odd.keyed((r["doc_id"], r["text"]) for r in kept.collect()) == odd.keyed(
        t for t in odd.TEXTS if t[1] not in ("same text in two rows", "a row without an id"))
    for a, b in ((odd.no_documents(spark), items), (docs, items.limit(0))):
        assert D.matches(a, b).collect() == []
    assert D.drop_contaminated(docs, items.limit(0)).count() == len(odd.TEXTS)


def test_letters_that_grow_in_lower_case():
    from runloom.llm.features import word_spans
    text = "İİ word İx"
    assert [text[a:b] for a, b in word_spans(text)] == ["İ", "İ", "word", "İ", "x"]


def test_query_against_comparing_everything(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    cut = {r["item_id"]: WORD.findall(r["text"].lower()) for r in items}
    want = set()
    for r in docs:
        words = WORD.findall(r["text"].lower())[:]
        have = set(words)
        for item, found in cut.items():
            # The score cannot reach half if fewer than half of the words are there at all.
            if sum(w in have for w in found) * 2 >= len(found) >= 3 and (
                    plain_score(found, words) >= D.LEAST_SCORE * D.MATCH * len(found)):
                want.add((r["doc_id"], item))
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op9_decontamination"](spark, sf_dir).collect()}
    assert want and got == want
