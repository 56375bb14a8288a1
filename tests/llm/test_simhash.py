"""Fingerprints, links and components against brute force."""

import numpy as np
import odd
import pytest
import xxhash

from runloom.llm import simhash as S
from runloom.llm.components import components
from runloom.llm.queries import QUERIES


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
             .translate(str.maketrans("\t\n\x0b\x0c\r", " " * 5)).split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id within reach for rows (id, fingerprint); nulls are never smallest."""
    values = sorted({p for _, p in prints})
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for doc_id, p in prints:
        if doc_id is not None:
            least[find(p)] = min(least.get(find(p), doc_id), doc_id)
    return [(doc_id, f"{p:016x}", least.get(find(p))) for doc_id, p in prints]


def test_fingerprints():
    for _, text in odd.TEXTS[:3] + odd.TEXTS[5:]:
        assert S.fingerprint(text or "") == plain_fingerprint(text)
    assert S.fingerprint("One\x0btwo\x0cTHREE four five É") == plain_fingerprint(
        "one two three four five É")
    assert S.fingerprint(" \t") == 0


def test_spark_has_the_same_hash(spark):
    got = spark.sql("SELECT xxhash64('a b c')").first()[0]
    assert got % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def cluster(rng, size):
    """Fingerprints around a few centres, chains among them, and some far away."""
    out = set()
    for _ in range(6):
        value = int(rng.integers(0, 2**63))
        for _ in range(size):
            out.add(value)
            value ^= 1 << int(rng.integers(0, 64))
            if rng.random() < 0.6:
                value ^= 1 << int(rng.integers(0, 64))
    return sorted(out | {int(v) for v in rng.integers(0, 2**63, 20)})


@pytest.mark.parametrize("most_sharing", [0, 2, 5, 10**9])
@pytest.mark.parametrize("chosen", [None, ([22, 21, 21], [0, 0, 0]), ([32, 32], [1, 0]),
                                    ([32, 32], [2, -1]), ([16] * 4, [-1, 0, 0, 0])])
def test_no_link_is_lost_between_components(spark, most_sharing, chosen):
    values = cluster(np.random.default_rng(9), 25)
    distinct = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    if chosen:
        cuts = np.cumsum([0, *chosen[0]])
        groups = [list(range(a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        thresholds = chosen[1]
    else:
        groups, thresholds = S.plan_search(distinct)
        assert sorted(b for g in groups for b in g) == list(range(64))
        assert sum(thresholds) == 2 - len(groups) + 1
    found = S.links(distinct, groups, thresholds, most_sharing=most_sharing)
    assert all((r["a"] ^ r["b"]) % 2**64 in range(2**64)
               and ((r["a"] ^ r["b"]) % 2**64).bit_count() <= 2 for r in found.collect())
    roots = {r["node"] % 2**64: r["root"] for r in components(found).collect()}
    got = {}
    for v in values:
        got.setdefault(roots.get(v, signed(v)), set()).add(v)
    want = {}
    for doc_id, p, root in plain_components(list(enumerate(values))):
        want.setdefault(root, set()).add(int(p, 16))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1001 + i) for i in range(300)]
    mixed = [(5000 + (7 * i) % 97, 5000 + (7 * i + 7) % 97) for i in range(96)]
    links = spark.createDataFrame([*chain, *star, *mixed, (3, 3)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert {roots[i] for i in range(201)} == {0}
    assert {roots[i] for i in range(1000, 1301)} == {1000}
    assert {roots[i] for i in range(5000, 5097)} == {5000}


def test_allocation_is_the_cheapest():
    rng = np.random.default_rng(4)
    costs = [[float(x) for x in np.sort(rng.random(4))] for _ in range(3)]
    best = min((sum(costs[i][t + 1] for i, t in enumerate(ts)), ts)
               for ts in np.ndindex(4, 4, 4) for ts in [tuple(x - 1 for x in ts)] if sum(ts) == 0)
    got = S.allocate(costs, 0)
    assert got[0] == pytest.approx(best[0]) and tuple(got[1]) == best[1]


def test_odd_documents(spark):
    got = [tuple(r) for r in S.query_rows(odd.odd_documents(spark)).collect()]
    assert odd.keyed(got) == odd.keyed(plain_components(
        [(i, plain_fingerprint(t) if len(t or "") < 10**5 else S.fingerprint(t)) for i, t in odd.TEXTS]))
    assert S.query_rows(odd.no_documents(spark)).collect() == []


def test_one_of_each_group_stays(spark):
    docs = odd.odd_documents(spark)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    texts = [(r["doc_id"], r["text"]) for r in rows]
    # 2, 3, 6 and a null row are empty; 8 and 9 hold the same text; 8 also has another one.
    assert sorted(i for i, _ in texts if i is not None) == [1, 2, 4, 5, 7, 8, 8, 10]
    assert {t for i, t in texts if i == 8} == {"same text in two rows", "other text, same id"}
    assert (None, "a row without an id") in texts and (None, None) not in texts
    assert S.keep_one(odd.no_documents(spark)).collect() == []


def test_an_id_with_a_row_that_stays_and_one_that_goes(spark):
    rows = [(8, "the first of two texts that are the same"), (9, "the first of two texts that are the same"),
            (9, "a text of its own that nothing else is like")]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert odd.keyed(kept) == odd.keyed([rows[0], rows[2]])


def test_repeated_rows_of_one_id_leave_one(spark):
    docs = spark.createDataFrame([(1, "one and the same row, many times over")] * 50 + [(2, "else")],
                                 "doc_id long, text string")
    assert odd.keyed(S.keep_one(docs).collect()) == odd.keyed(
        [(1, "one and the same row, many times over"), (2, "else")])


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op5_simhash"](spark, sf_dir).collect()
    want = plain_components([(r["doc_id"], S.fingerprint(r["text"])) for r in docs])
    assert odd.keyed(got) == odd.keyed(want)
    short = [r for r in docs if len(r["text"]) < 3000][:25]
    assert all(S.fingerprint(r["text"]) == plain_fingerprint(r["text"]) for r in short)


@pytest.mark.parametrize("key", [1, None])
def test_one_row_of_a_component_stays_whatever_its_ids(spark, key):
    base = [f"word{i}" for i in range(400)]
    texts = [" ".join(base), " ".join([*base, "last"]), " ".join(["first", *base])]
    prints = {S.fingerprint(t) for t in texts}
    assert len(prints) > 1 and all(bin(int(a) ^ int(b)).count("1") <= 2 for a in prints for b in prints)
    rows = [(key, t) for t in texts] + [(key, texts[0]), (9, "something else of its own entirely")]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] is None or r["doc_id"] for r in kept) in ([1, 9], [True, 9])
    assert len(kept) == 2
