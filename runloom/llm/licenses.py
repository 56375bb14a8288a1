"""License scans: winnowed fingerprints pick templates, banded alignment tells what matched.

Every template's word runs are hashed, and of each window of ``WINDOW`` runs the smallest hash goes into
an inverted index (run hash to template and place). A text looks up all of its runs, so any stretch of
``WINDOW + RUN - 1`` words that it shares with a template meets at least one of that template's
fingerprints. Meetings that would place the template at about the same spot are one candidate; there the
whole template is aligned with the words within ``BAND`` places of the diagonal (half the template, if
that is less, so that one place does not hide the next), and what matched is reported with its span.

The index has the size of the templates, which are fixed, so it goes along with the code.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from runloom.llm.batches import flat_computed, name_column, text_column
from runloom.llm.features import Vocabulary, known_runs, word_spans
from runloom.llm.license_texts import TEMPLATES

RUN = 3
WINDOW = 3
BAND = 12
LEAST_COVERAGE = 0.7
WHOLE_BELOW = 15  # words: in a statement shorter than this each word counts, the name above all
MATCH, MISS, GAP = 3, 1, 1
AT_ONCE = 256
_SCORE, _MATCHED = np.int64(1) << 40, np.int64(1) << 20


class Templates:
    """The words of all templates and the inverted index of their fingerprints."""

    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES):
        self.vocabulary = Vocabulary([text for _, text in templates])
        self.names = [name for name, _ in templates]
        self.words = [self.vocabulary.hashes(text) for _, text in templates]
        rows = []
        for i, words in enumerate(self.words):
            grams = known_runs(words, RUN)[1]
            chosen = set()
            for at in range(max(1, len(grams) - WINDOW + 1)):
                some = grams[at:at + WINDOW]
                if len(some):
                    # The last of equal hashes, so that neighbouring windows share their choice.
                    chosen.add(at + len(some) - 1 - int(some[::-1].argmin()))
            rows += [(int(grams[at]), i, at) for at in sorted(chosen)]
        rows.sort()
        self.grams, self.first = np.unique(np.array([r[0] for r in rows], np.uint64),
                                           return_index=True)
        self.first = np.append(self.first, len(rows))
        self.rows = rows

    def candidates(self, words: np.ndarray) -> list[tuple[int, int]]:
        """Template and the place where it would begin, one for each group of like places."""
        places, grams = known_runs(words, RUN)
        if not len(grams) or not len(self.grams):
            return []
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        hit = self.grams[at] == grams
        begins: dict[int, list[int]] = {}
        for place, gram in zip(places[hit].tolist(), at[hit].tolist(), strict=True):
            for _, template, own in self.rows[self.first[gram]:self.first[gram + 1]]:
                begins.setdefault(template, []).append(place - own)
        out = []
        for template, found in begins.items():
            found.sort()
            group = [found[0]]
            for begin in [*found[1:], None]:
                if begin is not None and begin - group[0] <= reach(len(self.words[template])):
                    group.append(begin)
                    continue
                out.append((template, group[len(group) // 2]))
                group = [begin]
        return out


def reach(size: int) -> int:
    """How far words may be off the diagonal: less than to the next place of a short template."""
    return min(BAND, size // 2)


def align_banded(templates: list[np.ndarray], texts: list[np.ndarray],
                 begins: list[int]) -> list[tuple[int, int, int]]:
    """Matched words, start and end in the text of each template's best local alignment in its band.

    Cell b of row i stands for the text word at ``begin + i + b - BAND``. Cells hold the score, the words
    matched so far and the start, packed into one integer each, best score first.
    """
    count, long, wide = len(templates), max(map(len, templates)), 2 * BAND + 1
    left = np.zeros((count, long), np.uint64)
    right = np.zeros((count, long + wide), np.uint64)
    inside = np.zeros((count, long + wide), bool)
    lengths = np.array([len(t) for t in templates])
    for i, (template, text, begin) in enumerate(zip(templates, texts, begins, strict=True)):
        left[i, :len(template)] = template
        low, high = max(0, begin - BAND), min(len(text), begin - BAND + long + wide)
        if high > low:
            right[i, low - begin + BAND:high - begin + BAND] = text[low:high]
            inside[i, low - begin + BAND:high - begin + BAND] = True
    columns = np.arange(wide, dtype=np.int64)
    near = np.abs(columns - BAND) <= np.array([reach(len(t)) for t in templates])[:, None]
    ramp = columns * (GAP * _SCORE)
    before = np.broadcast_to(columns, (count, wide)).copy()
    best, ends = np.zeros(count, np.int64), np.zeros(count, np.int64)
    rows = np.arange(count)
    for i in range(long):
        same = (right[:, i:i + wide] == left[:, i:i + 1]) & inside[:, i:i + wide] & near
        cell = before + np.where(same, MATCH * _SCORE + _MATCHED, -MISS * _SCORE)
        cell[:, :-1] = np.maximum(cell[:, :-1], before[:, 1:] - GAP * _SCORE)
        cell = np.maximum(cell, i + 1 + columns)  # score 0, starting behind this word
        cell = np.maximum.accumulate(cell + ramp, axis=1) - ramp
        at = cell.argmax(axis=1)
        top = cell[rows, at]
        better = (lengths > i) & (top // _SCORE > best // _SCORE)
        best[better], ends[better] = top[better], i + 1 + at[better]
        before = cell
    shift = np.array(begins) - BAND
    return list(zip((best % _SCORE // _MATCHED).tolist(), (best % _MATCHED + shift).tolist(),
                    (ends + shift).tolist(), strict=True))


def chosen(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Of overlapping findings the one with most matched words, ties to the shorter template."""
    out: list[tuple[int, int, int, int, int]] = []
    taken: list[tuple[int, int]] = []
    for row in sorted(found, key=lambda r: (-r[1], r[4], r[2], r[0])):
        _, _, start, end, _ = row
        if all(end <= a or b <= start for a, b in taken[-64:]) and (
                len(taken) <= 64 or all(end <= a or b <= start for a, b in taken)):
            taken.append((start, end))
            out.append(row)
    return sorted(out, key=lambda r: r[2])


def scan(docs: DataFrame, least: float = LEAST_COVERAGE,
         templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``doc_id, license, template, coverage, matched_words, start, end``, one row per place found.

    coverage is the share of the template's words that the alignment matched, at least ``least``, and all
    of them for templates of fewer than ``WHOLE_BELOW`` words. start and end are code points of the whole text, end exclusive. Of overlapping findings the one with most
    matched words stays. Null and empty texts hold nothing; repeated rows give repeated findings; a
    null doc_id stays null; an empty table gives no rows.
    """
    rows = docs.select(name_column("doc_id").alias("doc_id"), text_column().alias("text"))
    fields = [T.StructField("doc_id", rows.schema["doc_id"].dataType),
              T.StructField("license", T.StringType()), T.StructField("template", T.IntegerType()),
              T.StructField("coverage", T.DoubleType()), T.StructField("matched_words", T.LongType()),
              T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    wanted = list(templates)

    def start():
        known = Templates(wanted)

        def work(doc_ids, texts):
            waiting, found = [], {}

            def settle():
                nonlocal waiting
                for at in range(0, len(waiting), AT_ONCE):
                    some = waiting[at:at + AT_ONCE]
                    sides = align_banded([known.words[w[1]] for w in some], [w[3] for w in some],
                                         [w[2] for w in some])
                    for (row, template, _, _), (matched, a, b) in zip(some, sides, strict=True):
                        size = len(known.words[template])
                        if matched >= (size if size < WHOLE_BELOW else least * size):
                            found.setdefault(row, []).append((template, matched, a, b, size))
                waiting = []

            for row, text in enumerate(texts):
                hashes = known.vocabulary.hashes(text)
                waiting += [(row, t, begin, hashes) for t, begin in known.candidates(hashes)]
                if len(waiting) >= AT_ONCE:
                    waiting.sort(key=lambda w: len(known.words[w[1]]))
                    settle()
            waiting.sort(key=lambda w: len(known.words[w[1]]))
            settle()
            out = ([], [], [], [], [], [], [])
            for row in sorted(found):
                spans = word_spans(texts[row])
                for template, matched, a, b, size in chosen(found[row]):
                    values = (doc_ids[row], known.names[template], template, matched / size, matched,
                              spans[a][0], spans[b - 1][1])
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            return out
        return work

    return flat_computed(rows, fields, start)

