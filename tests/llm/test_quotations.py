"""Quoted passages, their originals and threads, by hand and against DuckDB."""

import itertools
import random
import re

import duckdb
import oracle

from runloom.llm import quotations as Q
from runloom.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "user", "Hello there, how are you?\nSecond line here.\n\nA new paragraph\nin two lines."),
    (1, 1, "assistant", "> Hello there, how are you?\nFine!"),
    (1, 2, "user", "> > Hello there,  how are you?\n> Fine!\n\nGreat to hear"),
    (1, 3, "user", ">> Fine!\n>  Great   to hear\nok"),
    (1, 3, "user", "> A new paragraph in two lines.\nsame turn"),
    (2, 0, "user", "Fine!"), (2, 1, "bot", "> Great to hear\nquoting elsewhere"),
    (2, 2, "x", "> nobody said this\nhm"), (2, 3, None, None), (2, 4, "u", ""),
    (None, 1, "u", "> Fine!\nx"), (3, None, "u", "Hello"), (3, 5, "u", "> Hello\n> Hello"),
    (1, 0, "user", "Hello there, how are you?\nSecond line here.\n\nA new paragraph\nin two lines."),
    (4, 0, "u", ">\n> \n"), (4, 1, "u", "a > b\n>>>deep\r\n> x"),
    (5, 0, "u", "say it"), (5, 1, "u", "> say it\nmore"), (5, 2, "u", "> more\nand more"),
    (5, 3, "u", "> and more\nstill"), (5, 4, "u", "> still\nlast"), (5, 5, "u", "long " * 20_000),
    (5, 6, "u", "> " + "long " * 20_000 + "\nquoted whole"),
]


def duck(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return con


def test_by_hand(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "'x' AS body", "1 AS depth", "2 AS tag")
    got = {(r["conv_id"], r["turn"], r["body"][:20]): r for r in Q.reply_order(rows).collect()}
    second = got[1, 2, "Great to hear"]
    assert (second["n_quotes"], second["n_linked"], second["reply_to_turn"]) == (2, 2, 1)
    assert (second["root_turn"], second["depth"]) == (0, 2)
    elsewhere = got[2, 1, "quoting elsewhere"]
    assert (elsewhere["quoted_conv"], elsewhere["quoted_turn"], elsewhere["reply_to_turn"]) == (1, 2, None)
    assert got[2, 2, "hm"]["n_linked"] == 0
    assert [got[5, t, b]["depth"] for t, b in ((1, "more"), (2, "and more"), (3, "still"), (4, "last"))] == [
        1, 2, 3, 4]
    assert got[5, 6, "quoted whole"]["reply_to_turn"] == 5
    assert len(got) == len(set(ROWS))


def test_against_duckdb(spark):
    for rows in (ROWS, ROWS[:1], [r for r in ROWS if ">" not in (r[3] or "")], []):
        assert oracle.compare(Q.reply_order(spark.createDataFrame(rows, SCHEMA)), duck(rows),
                              Q.ORACLE) == ""


def test_many_quote_one_passage(spark):
    rows = [(c, t, "u", "the same opening" if t == 0 else "> the same opening\nanswer " + str(t))
            for c in range(30) for t in range(6)]
    assert oracle.compare(Q.reply_order(spark.createDataFrame(rows, SCHEMA)), duck(rows), Q.ORACLE) == ""


def test_parts_of_messages_are_linked(spark):
    """Lines 2 and 3 of 5, a sentence of a line, a re-wrapped and trimmed part, a word elsewhere."""
    rows = [(1, 0, "u", "first line of it\nthen a second one\nand a third line\nthe fourth\nand the last"),
            (1, 1, "u", "We could meet on Monday. Or would Tuesday suit you better? Tell me."),
            (1, 2, "u", "> then a second one\n> and a third line\nwhy these two"),
            (1, 3, "u", "> Or would Tuesday suit you better?\nit would"),
            (1, 4, "u", "> meet on Monday. Or would\n> Tuesday suit\nrather not"),
            (1, 5, "u", "> why these\nbecause"),
            (2, 0, "u", "> and a third line the fourth and\nfrom elsewhere"), (2, 1, "u", "> Tuesday\nwhich"),
            (2, 2, "u", "> then a third line\nnobody said so")]
    got = {(r["conv_id"], r["turn"]): r for r in Q.reply_order(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[1, t]["reply_to_turn"] for t in range(6)] == [None, None, 0, 1, 1, 2]
    assert [got[1, t]["n_linked"] for t in range(6)] == [0, 0, 1, 1, 1, 1]
    assert (got[1, 5]["root_turn"], got[1, 5]["depth"]) == (0, 2)
    assert (got[2, 0]["quoted_conv"], got[2, 0]["quoted_turn"], got[2, 0]["reply_to_turn"]) == (1, 0, None)
    assert (got[2, 1]["quoted_conv"], got[2, 1]["quoted_turn"], got[2, 1]["n_linked"]) == (1, 1, 1)
    assert got[2, 2]["n_linked"] == 0


def plain_links(rows):
    """The first holder of each quoted passage, by looking into every message: conv, turn, passage to it."""
    words = lambda t: re.findall(r"[\w]+", t.lower())
    own, quotes = [], []
    for conv, turn, _, text in rows:
        mine = [x for x in text.split("\n") if not x.startswith(">")]
        own.append((conv, turn, words("\n".join(mine))))
        for _, some in itertools.groupby(text.split("\n"), lambda x: x.startswith(">")):
            some = list(some)
            if some[0].startswith(">"):
                quotes.append((conv, turn, words(" ".join(some))))
    out = {}
    for conv, turn, said in quotes:
        holds = [(c, t) for c, t, w in own
                 if any(w[i:i + len(said)] == said for i in range(len(w) - len(said) + 1))]
        inside = min((t for c, t in holds if c == conv), default=None)
        if inside is not None and inside < turn:
            out[conv, turn] = (conv, inside)
        else:
            out[conv, turn] = min(((c, t) for c, t in holds if c != conv), default=None)
    return out


def test_parts_of_any_length_against_looking_everywhere(spark):
    rng = random.Random(4)
    vocabulary = ["yes", "no", *[f"w{i}" for i in range(25)]]
    rows, said = [], []
    for conv in range(12):
        for turn in range(6):
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 14)))
            if said and rng.random() < .6:
                source = rng.choice(said).split()
                size = rng.randint(1, 6)
                at = rng.randrange(len(source) - size)
                text = f"> {' '.join(source[at:at + size])}\n{text}"
            said.append(text.split("\n")[-1])
            rows.append((conv, turn, "u", text))
    want = plain_links(rows)
    got = {(r["conv_id"], r["turn"]): (r["quoted_conv"], r["quoted_turn"]) if r["n_linked"] else None
           for r in Q.reply_order(spark.createDataFrame(rows, SCHEMA)).collect() if r["n_quotes"]}
    assert got == want and len(want) > 30


def test_a_word_that_everybody_says_and_quotes(spark):
    rows = [(c, t, "u", f"oh yes of course {c} {t}" if t == 0 else f"> yes\nwell {t} yes indeed")
            for c in range(40) for t in range(5)]
    got = Q.reply_order(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all((r["quoted_conv"], r["reply_to_turn"]) == (r["conv_id"], 0) for r in got if r["turn"])


def test_order_of_the_rows(spark):
    got = Q.reply_order(spark.createDataFrame(ROWS, SCHEMA)).collect()
    keys = [(r["conv_id"], r["root_turn"], r["depth"], r["turn"]) for r in got]
    assert keys == sorted(keys, key=lambda k: [(v is not None, v) for v in k])


def test_no_python_in_the_plan(spark, sf_dir):
    plan = QUERIES["op2_quotations"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_query_against_duckdb(spark, sf_dir):
    assert oracle.compare(QUERIES["op2_quotations"](spark, sf_dir), oracle.connect(sf_dir),
                          ORACLES["op2_quotations"]) == ""
