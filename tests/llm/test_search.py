import random
import re
from collections import Counter

import numpy as np
import odd
import pytest

import __spark_entry__ as entry_point
from runloom.llm import search

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, results=10):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs = sum(1 for _, c in counts if c)
    n_terms = sum(sum(c.values()) for _, c in counts)
    holding = Counter(t for _, c in counts for t in c)
    rows = []
    for item, text in {(i, t or "") for i, t in items}:
        found = []
        for doc, c in counts:
            n = sum(c.values())
            score = 0
            for t in set(plain_terms(text)):
                if c[t]:
                    m = 100 - 90 + (90 * n * n_docs) // n_terms
                    score += search.weight(n_docs, holding[t]) * (
                        (1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        rows += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(found[:results], 1)]
    return rows


def random_rows(seed, docs=400, items=12):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    texts = [" ".join(r.choices(words, weights, k=r.choice([0, 1, 5, 40, 200]))) for _ in range(docs)]
    asked = [" ".join(r.choices(words, weights, k=r.choice([1, 2, 8, 30]))) for _ in range(items)]
    for item in range(0, items, 3):  # leaked passages, some of them often
        for _ in range(r.choice([1, 15])):
            texts[r.randrange(docs)] += ", " + asked[item].upper()
    rows = [(r.choice([i, i, i, 7, None]), t) for i, t in enumerate(texts)]
    return rows, list(enumerate(asked))


@pytest.mark.parametrize(("seed", "options"), [
    (1, {}), (2, {"segment_docs": 16}), (3, {"segment_docs": 50, "block_terms": 20}),
    (4, {"segment_docs": 30, "most_terms": 3, "block_terms": 40})])
def test_against_scoring_everything(spark, seed, options):
    docs, items = random_rows(seed)
    got = search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                        spark.createDataFrame(items, "item_id long, text string"), **options)
    assert odd.keyed(got.collect()) == odd.keyed(plain(docs, items))


def test_odd_documents_and_items(spark):
    items = [(1, "A PLAIN text"), (1, "A PLAIN text"), (2, None), (3, ""), (4, "no such words zzz"),
             (5, "same text in two rows"), (6, "W\u00f6rd \u0130stanbul \U0001f600"), (7, "x" * 30_000),
             (None, "word and"), (8, "- , ."), (5, "other")]
    frame = spark.createDataFrame([(*i, "clash") for i in items],
                                  "item_id long, text string, terms string")
    got = search.search(odd.odd_documents(spark), frame).collect()
    assert odd.keyed(got) == odd.keyed(plain([r[:2] for r in odd.odd_rows()], items))
    assert search.search(odd.no_documents(spark), frame).count() == 0
    assert search.search(odd.odd_documents(spark), frame.limit(0)).count() == 0


def test_terms_of_long_texts():
    text = "Aa \u00c4b " * 400_000 + "c" * 3_000_000 + "\x00d"
    runs = list(search.term_runs(text))
    assert len(runs) > 3
    assert [t.decode() for run in runs for t in run] == plain_terms(text)


def lists_of(r, terms, docs):
    block = search.Block(tuple(map(str, range(terms))), np.array([r.randint(1, 50) for _ in range(terms)]),
                         (np.arange(terms),), docs, docs)
    places = [np.array(sorted(r.sample(range(docs), r.randint(1, docs // 3)))) for _ in range(terms)]
    gain = [np.array([r.randint(1, 99) for _ in p]) for p in places]
    return search.Lists(block, np.arange(terms), np.cumsum([len(p) for p in places]),
                        np.concatenate(places), np.concatenate(gain))


def test_pairs_skip_more_and_lose_nothing():
    read = [0, 0]
    for seed in range(300):
        r = random.Random(seed)
        lists = lists_of(r, r.randint(1, 9), 60)
        terms = lists.of_item(0)
        total = np.zeros(60, np.int64)
        for t in terms:
            total[lists.places[t]] += lists.scores[t]
        ids = np.array([r.randrange(1000) for _ in range(60)])
        want = sorted((-s, i) for s, i in zip(total.tolist(), ids.tolist(), strict=True) if s)[:5]
        least = r.choice([1, -want[-1][0] if len(want) == 5 else 1])
        joint = {(a, b): int(max([0, *lists.pair(a, b)[1].tolist()]))
                 for a in terms for b in terms if a < b}
        for k, pairs in enumerate(({}, joint)):
            docs, score, _, cost = search.search_segment(lists, pairs, 0, least, ids, 5)
            got = [(-s, i) for s, i in zip(score.tolist(), ids[docs].tolist(), strict=True)]
            assert got == [w for w in want if -w[0] >= least]
            read[k] += cost
    assert read[1] < read[0]


def test_scores_that_are_known_beforehand_are_reached(spark):
    docs, items = random_rows(9)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    index = search.build_index(frame, segment_docs=40)
    block = search.make_block(index, [search.terms_of(t) for _, t in items])
    least = search.least_scores(search.pair_index(index, block, 10), block, 10)
    found = Counter()
    scores = {}
    for item, rank, _, score in plain(docs, items):
        found[item] += 1
        scores[item, rank] = score
    assert all(least[i] == 1 or least[i] <= scores[i, 10] for i, _ in items)
    assert (least > 1).sum() >= 6


def test_query_against_scoring_everything(spark, sf_dir):
    rows = entry_point.queries()["op12_search"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()
    assert odd.keyed(rows) == odd.keyed(plain(docs, items))
