"""Directly addressable codes, the files, and the query against the library itself."""

import zlib

import numpy as np
import odd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from runloom.llm import token_files as K
from runloom.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), st.data())
def test_any_id_and_any_range_without_the_rest(ids, data):
    values = np.array(ids, np.uint32)
    segment = K.Segment(K.encode_segment(values))
    assert len(segment) == len(ids)
    assert segment.slice(0, len(ids)).tolist() == ids
    if ids:
        a = data.draw(st.integers(0, len(ids) - 1))
        b = data.draw(st.integers(a, len(ids)))
        assert segment[a] == ids[a]
        assert segment.slice(a, b).tolist() == ids[a:b]
    with pytest.raises(IndexError):
        segment[len(ids)]


def test_ranks_over_many_blocks():
    values = np.random.default_rng(1).integers(0, 50257, 40_000).astype(np.uint32)
    segment = K.Segment(K.encode_segment(values))
    for at in range(0, 40_000, 517):
        assert segment[at] == values[at]
        assert (segment.slice(at, at + 600) == values[at:at + 600]).all()


def test_other_bytes_are_refused():
    with pytest.raises(ValueError):
        K.Segment(b"none of ours")


def expected(rows):
    tokenizer = Tokenizer.from_file(PATH)
    out, start = [], 0
    # Rows of one id: by the hash that also deals them out, so only ids in order are compared.
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out, start


@pytest.mark.parametrize("segment_tokens", [1, 50, 1 << 18])
def test_odd_documents(spark, tmp_path, segment_tokens):
    K.write_token_files(odd.odd_documents(spark), str(tmp_path / "t"), PATH,
                        segment_tokens=segment_tokens)
    rows = sorted(K.read_documents(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    want, total = expected(odd.TEXTS)
    assert odd.keyed((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == odd.keyed(want)
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    assert rows[-1]["start"] + rows[-1]["n_tokens"] == total


def test_no_documents(spark, tmp_path):
    K.write_token_files(odd.no_documents(spark), str(tmp_path / "t"), PATH)
    assert K.read_documents(spark, str(tmp_path / "t")).collect() == []


def test_query_against_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = sorted((tuple(r) for r in docs.collect()), key=lambda r: r[0])
    want, start = [], 0
    for doc_id, n, crc in expected(rows)[0]:
        want.append((doc_id, start, n, crc))
        start += n
    got = QUERIES["op3_token_files"](spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
