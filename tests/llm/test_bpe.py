"""BPE by the rank array against the tokenizers library."""

import hashlib
import random

import odd
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from runloom.llm import bpe as B
from runloom.llm import bpe_tables
from runloom.llm.queries import QUERIES
from runloom.llm.token_files import as_ids, library_encoder

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
OURS, LIBRARY, CHUNKED = B.Bpe(PATH, PATTERN), Tokenizer.from_file(PATH), library_encoder(PATH)
PIECES = ["a", "word", " the", "é", "Ж", "İ", " ", "  ", "\n", "\t", ",", "***", "'ll", "'", "1", "²",
          "é", "<|endoftext|>", " ", "\xa0", "\x1c", "՘", "౜", "😀", "　", "ﬀ"]


PIECES += [" a<|endoftext|>b", "<|endoftext", "|>", "\x00", "\x01"]


def check(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    got = OURS.encode([text])[0].tolist()
    assert got == want
    assert as_ids(CHUNKED.many([text])[0]).tolist() == want
    assert OURS.decode(got) == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=20).map("".join))
def test_pieces_in_any_order(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    check(text)


def test_short_and_long_words():
    rng = random.Random(5)
    for size in (1, 2, 40, 47, 48, 49, 200, 3000):
        for _ in range(15):
            check("".join(rng.choice("abcdehilnorst") for _ in range(size)))
    check("ha" * 30_000)


def test_rank_array_and_heap_agree():
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 40))).encode()
             for _ in range(500)]
    assert OURS.encode_words(words) == [OURS._long(w) for w in words]


def test_broken_utf8_and_unknown_ids():
    half = OURS.encode(["é"])[0].tolist()
    broken = [i for i in OURS.encode(["Ж"])[0].tolist()][:1]
    if len(OURS.bytes_of[broken[0]]) == 1:
        assert OURS.decode(broken) == "�"
    assert OURS.decode([*half, 999_999]) == "é"


def expected(doc_id, text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return (doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_odd_documents(spark):
    got = bpe_tables.digests(odd.odd_documents(spark), PATH, PATTERN).collect()
    assert odd.keyed(got) == odd.keyed(expected(*row) for row in odd.TEXTS)
    assert bpe_tables.digests(odd.no_documents(spark), PATH, PATTERN).collect() == []


def test_columns_stay_and_texts_come_back(spark):
    docs = odd.odd_documents(spark)
    rows = bpe_tables.encode_documents(docs, PATH, PATTERN)
    assert rows.columns == [*docs.columns, "ids_"]  # the documents have a column ids
    back = bpe_tables.decode_ids(rows, "ids_", PATH, PATTERN, "again").collect()
    assert all(r["again"] == (r["text"] or "") for r in back) and len(back) == len(odd.TEXTS)
    assert bpe_tables.decode_ids(
        spark.createDataFrame([(None,)], "ids array<int>"), "ids", PATH, PATTERN).first()["text"] == ""


def test_query_against_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op10_bpe"](spark, sf_dir).collect()
    assert odd.keyed(got) == odd.keyed(expected(*row) for row in docs)
