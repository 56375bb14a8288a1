"""Personal data, and the terms that give it away.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. Removing them is not
always enough: a term that hardly occurs without an entity tells who was meant. So the corpus is asked.
With n different texts, n(e) of them with entity e, n(t) with term t and n(e, t) with both:

    information of e      IC(e) = log2(n / n(e))
    disclosure of e by t  PMI(e, t) / IC(e), where PMI(e, t) = log2(n(e, t) n / (n(e) n(t)))

In documents that hold e, terms that disclose at least ``GENERALISE`` of its information are
generalised, and those that disclose at least ``REMOVE`` are removed. A term is any word outside base
spans, wherever it stands in the text. A pair counts as evidence from ``SUPPORT`` texts on. All counts
are of different texts, so copies neither prove nor hide anything. Only an entity that every text holds
has no information to disclose.

Counts cover all documents. Words are counted for some rows at a time before they are shuffled; pairs
arise only in texts with entities that have support, and are counted in each task before they meet.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.llm.batches import flat_computed, fresh, name_column, text_column, with_computed, written

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT = 3
GENERALISE, REMOVE = 0.8, 0.95
MOST_COPIED = 500_000  # hashes of copied texts to broadcast; the way through, not the result
SALTS = 16  # parts of the texts that hold one entity
WORD = re.compile(r"\w+")

# Possessive repeats and the look-behinds change nothing but the time that long runs take.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with the run of address letters before it and a domain after it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL_LETTERS:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            out.append((begin, domain.end()))
            free = domain.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of personal data, by start, then kind in the order of KINDS."""
    out = []
    if "@" in text:
        out += [(a, b, "email") for a, b in emails(text)]
    for match in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in match[0].split(".")):
            out.append((*match.span(), "ip"))
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 14:
            digits = match[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*match.span(), "card"))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in match[0]) <= 15:
                out.append((*match.span(), "phone"))
    return sorted(out, key=_order)


def _order(span: tuple[int, int, str]) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def entity(text: str, span: tuple[int, int, str]) -> str:
    """One name for the ways in which an address or number may be written."""
    found = text[span[0]:span[1]]
    plain = found.lower() if span[2] in ("email", "ip") else re.sub(r"[^0-9]", "", found)
    return f"{span[2]}:{plain}"


def terms_of(text: str, spans: list[tuple[int, int, str]]) -> set[str]:
    """The terms of a text, parts of its entities left out."""
    if not spans:
        return set(map(str.lower, WORD.findall(text)))
    return {m[0].lower() for m in _outside(text, spans)}


def _outside(text: str, spans: list[tuple[int, int, str]]) -> list[re.Match]:
    """Words that touch no span; both sides are in order, so one walk is enough."""
    merged: list[list[int]] = []
    for a, b, _ in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, i = [], 0
    for match in WORD.finditer(text):
        while i < len(merged) and merged[i][1] <= match.start():
            i += 1
        if i == len(merged) or match.end() <= merged[i][0]:
            out.append(match)
    return out


def revealing_terms(rows: DataFrame) -> DataFrame:
    """``text_hash, terms, actions``: the terms to sanitise in texts of that hash.

    ``rows`` has text and text_hash. The result has texts with well-supported entities only.
    """
    def both():
        def work(hashes, texts):
            out = ([], [], [])
            for text_hash, text in zip(hashes, texts, strict=True):
                if spans := base_spans(text):
                    names = sorted({entity(text, s) for s in spans})
                    for column, value in zip(out, (text_hash, names, sorted(terms_of(text, spans))),
                                             strict=True):
                        column.append(value)
            return out
        return work

    strings = T.ArrayType(T.StringType())
    fields = [T.StructField("text_hash", T.LongType()), T.StructField("entities", strings),
              T.StructField("terms", strings)]
    around = written(flat_computed(rows.select("text_hash", "text"), fields, both)
                     .distinct(), "entity_texts")
    each = around.select("text_hash", F.explode("entities").alias("entity"))
    held = each.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).filter(F.col("n_e") >= SUPPORT)
    held = written(held, "entities")
    known = written(_salted_join(each, held, ["entity"]), "known")
    beside = (known.join(around.select("text_hash", "terms"), "text_hash")
              .select("text_hash", "entity", "n_e", F.explode("terms").alias("term")))
    pairs = (beside.groupBy("entity", "n_e", "term").agg(F.count(F.lit(1)).alias("n_et"))
             .filter(F.col("n_et") >= SUPPORT))
    pairs = written(pairs, "pairs")

    def count():
        def work(texts):
            seen: Counter = Counter()
            for text in texts:
                seen.update(terms_of(text, base_spans(text)))
            return list(seen), list(seen.values())
        return work

    # Only terms of pairs matter, but their number has no bound, so all are counted and then joined.
    texts, documents = _different(rows)
    words = flat_computed(texts, [T.StructField("term", T.StringType()),
                                  T.StructField("n", T.LongType())], count)
    frequent = words.groupBy("term").agg(F.sum("n").alias("n_t"))
    n = F.lit(float(max(documents, 1)))
    bits = F.log2(n / F.col("n_e"))
    told = F.log2(F.col("n_et") * n / (F.col("n_e") * F.col("n_t")))
    telling = (pairs.join(frequent, "term").filter((bits > 0) & (told >= GENERALISE * bits))
               .select("entity", "term", (told >= REMOVE * bits).alias("remove")))
    if pairs.isEmpty():  # then nothing needs to be counted
        telling = telling.limit(0)
    telling = written(telling, "telling")
    by_text = (_salted_join(beside.select("text_hash", "entity", "term"), telling, ["entity", "term"])
               .groupBy("text_hash", "term").agg(F.max("remove").alias("remove")))
    # A list is as long as a text has terms that tell of its own entities.
    return written(by_text.groupBy("text_hash").agg(
        F.collect_list("term").alias("terms"), F.collect_list("remove").alias("actions")), "terms")


def _different(rows: DataFrame) -> tuple[DataFrame, int]:
    """Each text once, and how many there are. Texts without copies are shuffled only if more than
    MOST_COPIED have some."""
    hashes = written(rows.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n")), "hashes")
    copied = hashes.filter("n > 1").select("text_hash")
    if copied.count() > MOST_COPIED:
        texts = rows.select("text").distinct()
    else:
        copied = F.broadcast(copied)
        texts = rows.join(copied, "text_hash", "left_anti").select("text").union(
            rows.join(copied, "text_hash", "left_semi").select("text").distinct())
    return texts, hashes.count()


def _salted_join(texts: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of rows with a text_hash; the rows of one entity are dealt to SALTS tasks."""
    parts = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = texts.withColumn("salt", F.pmod("text_hash", F.lit(SALTS)).cast("int"))
    return mine.join(parts, [*keys, "salt"]).drop("salt")


def with_terms(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` plus the terms to sanitise in each text and whether to remove them, and their names."""
    text_hash = fresh(docs, "found_hash")
    rows = docs.withColumn(text_hash, F.xxhash64(text_column()))
    found = revealing_terms(docs.select(text_column().alias("text"))
                            .withColumn("text_hash", F.xxhash64("text")))
    terms, actions, key = (fresh(rows, n) for n in ("found_terms", "found_actions", "found_hash"))
    found = found.select(F.col("text_hash").alias(key), F.col("terms").alias(terms),
                         F.col("actions").alias(actions))
    # Few texts have such terms; if the table is small, Spark broadcasts it by its written size.
    joined = rows.join(found, F.col(text_hash) == F.col(key), "left").drop(key, text_hash)
    return joined, terms, actions


def spans_of(text: str, terms: list[str] | None, removes: list[bool] | None
             ) -> list[tuple[int, int, str, str]]:
    """All spans of a text with their actions: replace, and for terms generalise or remove."""
    spans = [(*s, "replace") for s in base_spans(text)]
    if terms:
        wanted = dict(zip(terms, removes, strict=True))
        for match in _outside(text, [s[:3] for s in spans]):
            word = match[0].lower()
            if word in wanted:
                spans.append((*match.span(), "term", "remove" if wanted[word] else "generalise"))
        spans.sort(key=_order)
    return spans


def find_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, starts, ends, kinds, actions`` of all spans of every whole text, in order.

    Null texts are empty and have no spans; repeated rows stay, a null doc_id stays null.
    """
    rows, terms, actions = with_terms(docs.select(name_column("doc_id").alias("doc_id"),
                                                  text_column().alias("text")))
    kinds = (T.LongType(), T.LongType(), T.StringType(), T.StringType())
    names = ("starts", "ends", "kinds", "actions")

    def start():
        def work(doc_ids, texts, lists, removes):
            out = ([], [], [], [])
            for text, some, remove in zip(texts, lists, removes, strict=True):
                spans = spans_of(text, some, remove)
                for column, values in zip(out, zip(*spans, strict=True) if spans else ([],) * 4,
                                          strict=True):
                    column.append(list(values))
            return doc_ids, *out
        return work

    return flat_computed(rows.select("doc_id", "text", terms, actions), [
        rows.schema["doc_id"], *[T.StructField(n, T.ArrayType(k))
                                 for n, k in zip(names, kinds, strict=True)]], start)


def query_rows(docs: DataFrame) -> DataFrame:
    """Counts by kind, base_sha256 and spans of every row of ``docs``, all as the contract has them."""
    found = find_spans(docs)
    all_spans = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda s: F.concat_ws(
        ":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string")))
    base = F.filter(all_spans, lambda s: ~s.startswith("term:"))
    counts = [(F.size("kinds") - F.size(F.array_remove("kinds", kind))).cast("long").alias(f"n_{kind}")
              for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
                        F.array_join(all_spans, ",").alias("spans"))


def placeholder(found: str, kind: str, action: str) -> str:
    """What stands for a span: the kind of an entity, a more general word for a term, or nothing."""
    if action == "remove":
        return ""
    if action == "replace":
        return f"[{kind.upper()}]"
    if any(c.isdigit() for c in found):
        return "[NUMBER]"
    return "[NAME]" if found[:1].isupper() else "[WORD]"


def sanitised_text(text: str, spans: list[tuple[int, int, str, str]]) -> str:
    """The text with each span, or run of overlapping spans, put right; the first span decides."""
    out, at = [], 0
    for begin, end, kind, action in spans:
        if begin >= at:
            out += [text[at:begin], placeholder(text[begin:end], kind, action)]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` with personal data and revealing terms put right in their texts.

    Columns stay as they are, but for text and, if there is one, n_chars, which follows the new text;
    null texts stay null.
    """
    rows, terms, actions = with_terms(docs)
    new = fresh(rows, "new_text")

    def start():
        def work(texts, lists, removes):
            return [[text if text is None else sanitised_text(text, spans_of(text, some, remove))
                     for text, some, remove in zip(texts, lists, removes, strict=True)]]
        return work

    done = with_computed(rows, ["text", terms, actions], [T.StructField(new, T.StringType())], start)
    kinds = dict(docs.dtypes)
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col(new).alias(name))
        elif name == "n_chars":
            columns.append(F.when(F.col(new).isNull(), F.col(name)).otherwise(
                F.length(new)).cast(kinds[name]).alias(name))
        else:
            columns.append(name_column(name))
    return done.select(*columns)


def sha256_of(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
