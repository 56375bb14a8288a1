"""Documents as nobody wants them, for every operator's tests."""

from __future__ import annotations

# Names that operators use inside, as columns of the input.
CLASHES = ("score", "fp", "ids", "whole_text", "text_hash", "kept_id", "root", "Terms", "item_id")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long" + "".join(
    f", {name} string" for name in CLASHES)

LONG = "word and wörd, " * 20_000
TEXTS = [(1, "A plain text about nothing in particular, told in a few words."), (2, None), (3, ""),
         (4, LONG), (5, "x" * 30_000), (6, "  \n\t "), (7, "İstanbul ǅ ﬀ 😀   é"),
         (8, "same text in two rows"), (8, "same text in two rows"), (8, "other text, same id"),
         (None, "a row without an id"), (None, None), (9, "same text in two rows"),
         (10, "mail a.b@example.com, call +1 (555) 123-4567, card 4111 1111 1111 1111, at 10.0.0.255")]


def odd_rows():
    return [(i, t, "en", None, None if t is None else len(t), *["clash"] * len(CLASHES))
            for i, t in TEXTS]


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def keyed(rows):
    """Rows as sorted texts, for comparing tables with nulls and repeats."""
    return sorted(repr(tuple(r)) for r in rows)
