import hashlib
import random

import numpy as np
import odd
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry_point
from runloom.llm import byte_bpe
from runloom.llm.transducer import Transducer, joins

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.RankBpe(PATH, PATTERN)


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def random_texts(n, seed=1):
    r = random.Random(seed)
    pools = ["ab '", "abcdefghijklmnopqrstuvwxyz   ", "".join(map(chr, range(0x250))),
             "".join(map(chr, range(0x250, 0x3000))), "😀é́ ‍中文字 ﷺ \x85\x1c\x1d",
             "-=_*#/.!<>", "ÃÂ", "\n\t  \r", "'stdrevmll ", "<|endoftext|> ", "՘\U0003d000a1 "]
    for i in range(n):
        pool = r.choice(pools) + (r.choice(pools) if i % 2 else "")
        yield "".join(r.choice(pool) for _ in range(r.choice([0, 1, 3, 10, 50, 300])))


def test_random_texts_against_the_library(bpe, library):
    memory = bpe.memory()
    texts = list(random_texts(3000))
    for text, ids in zip(texts, bpe.encode(texts, memory), strict=True):
        assert ids.tolist() == library.encode_ordinary(text), text
        assert bpe.decode(ids) == text
        assert bpe.count_chars(ids) == len(text)


def test_every_code_point_is_cut_as_by_the_library(bpe, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(points), 5000):
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)} " for c in points[at:at + 5000])
        assert bpe.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_transducer_against_the_plain_rule():
    """Random small vocabularies, in which pairs overlap and some tokens are never made."""
    r = random.Random(3)
    for _ in range(200):
        ranks = {bytes([b]): b for b in range(256)}
        letters = b"abc"[:r.choice([1, 2, 3])]
        known = [bytes([b]) for b in letters]
        for _ in range(r.choice([3, 8, 15])):
            new = r.choice(known) + r.choice(known)
            if new not in ranks:
                ranks[new] = len(ranks) * 2
                known.append(new)
        few = Transducer(ranks, most_states=r.choice([3, 1000]))
        order = few.order
        for _ in range(30):
            raw = bytes(r.choice(letters) for _ in range(r.choice([1, 2, 5, 12, 30])))
            want = [ranks[part] for part in joins(raw, order)[0]]
            assert np.frombuffer(few.encode(raw), "<u4").tolist() == want, (ranks, raw)


def test_tokens_come_out_within_the_longest_token(bpe):
    machine = bpe.transducer
    raw = ("internationalisation" * 40).encode()
    read = written = 0
    for byte, put in zip([*raw, None], machine.stream(bytes([b]) for b in raw), strict=True):
        read += byte is not None
        written += sum(len(bpe.raw[i]) for i in np.frombuffer(put, "<u4"))
        assert read - written < 2 * machine.longest
    assert written == len(raw)


def test_a_piece_of_a_million_bytes_takes_linear_time(bpe, library):
    for text in ("x" * 1_000_000, "ab" * 500_000):
        ids = bpe.encode([text])[0]
        assert bpe.decode(ids) == text
    some = "".join(random.Random(5).choice("abcdefgh") for _ in range(20_000))
    assert bpe.encode([some])[0].tolist() == library.encode_ordinary(some)


def test_decoding_as_ids_arrive(bpe):
    r = random.Random(4)
    odd_tokens = [i for i, size in enumerate(bpe.chars.tolist()) if size < 0]
    for _ in range(500):
        ids = [r.choice(odd_tokens) if r.random() < .7 else r.randrange(50_256) for _ in range(12)]
        raw = b"".join(bpe.raw[i] for i in ids)
        assert "".join(bpe.stream_text(ids)) == raw.decode("utf-8", "replace")
        assert bpe.decode(np.array(ids)) == raw.decode("utf-8", "replace")
    machine = byte_bpe.Utf8Machine()
    for _ in range(3000):
        raw = bytes(r.choice([0x41, 0x80, 0xBF, 0x9F, 0xA0, 0xC1, 0xC3, 0xE0, 0xED, 0xEF, 0xF0, 0xF4,
                              0xF5, 0x90, 0x8F]) for _ in range(8))
        out, held = [], b""
        for byte in raw:
            text, held = machine.feed(held, bytes([byte]))
            out.append(text)
        assert "".join(out) + machine.end(held) == raw.decode("utf-8", "replace")


def test_unknown_ids_are_left_out(bpe):
    ids = bpe.encode(["plain words"])[0].tolist()
    assert bpe.decode(np.array([*ids, 50_256, 10**6, -1])) == "plain words"


def plain_row(library, text):
    ids = library.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode_bytes(ids)).hexdigest(), len(text or ""))


def test_odd_documents(spark, library):
    rows = byte_bpe.digests(odd.odd_documents(spark), PATH, PATTERN).collect()
    want = [(r[0], *plain_row(library, r[1])) for r in odd.odd_rows()]
    assert odd.keyed(rows) == odd.keyed(want)
    assert byte_bpe.digests(odd.no_documents(spark), PATH, PATTERN).count() == 0


def test_columns_of_ids_and_back(spark):
    docs = odd.odd_documents(spark)
    coded = byte_bpe.encode_documents(docs, PATH, PATTERN)
    assert coded.columns == [*docs.columns, "ids_"]
    back = byte_bpe.decode_ids(coded, "ids_", PATH, PATTERN)
    assert all(r["text_"] == (r["text"] or "") for r in back.collect())


def test_query_against_the_library(spark, sf_dir, library):
    rows = entry_point.queries()["op13_byte_bpe"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert odd.keyed(rows) == odd.keyed((d[0], *plain_row(library, d[1])) for d in docs)
