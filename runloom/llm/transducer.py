"""A finite-state transducer from bytes to the tokens of a byte-pair encoding.

Joining pairs by rank works on neighbours only. So parts that are never joined across a gap are joined
on either side of it as if they stood alone, and a row of tokens is the encoding of its bytes if and
only if every two neighbours among them are the encoding of theirs. That makes the tokens a regular
language: a transducer reads bytes along the trie of all tokens and, at the end of a token that may
follow the one before, may go back to the root and put the token out.

The transducer is not deterministic, for a token may be the beginning of longer ones. It is
determinised while it reads: a state is the set of places it can be in, each with the tokens that it
has read and not yet put out; what all have in common is put out. Every prefix of a text has one
encoding, so at every byte exactly one place is at the root, and a place dies no later than the
longest token after its last gap: the lookahead is bounded. States are made when they are first met
and remembered; a text costs one look-up a byte, however long it is.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator, Sequence

ROOT = 0
START = -1  # what stands before the first token
NONE = -1   # no token ends here
PLACES, FINAL = -1, -2  # keys of a state beside the bytes that lead on
MOST_STATES = 600_000
MOST_PAIRS = 2_000_000


def packed(tokens: Sequence[int]) -> bytes:
    """Token ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(tokens)}I", *tokens)


def joins(raw: bytes, ranks: dict[bytes, int]) -> tuple[list[bytes], list[tuple]]:
    """The plain rule, for a few bytes: join the neighbours of lowest rank, the leftmost of equals.

    Gives the parts that are left, and for each join its rank with the first and the last part after it.
    """
    parts = [raw[i:i + 1] for i in range(len(raw))]
    none = len(ranks)
    found = [ranks.get(raw[i:i + 2], none) for i in range(len(raw) - 1)]
    steps = []
    while found:
        best = min(found)
        if best == none:
            break
        at = found.index(best)
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
        del found[at]
        if at:
            found[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
        if at < len(found):
            found[at] = ranks.get(parts[at] + parts[at + 1], none)
        steps.append((best, parts[0], parts[-1]))
    return parts, steps


class Transducer:
    """Tokens by their bytes, where a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every byte has to be a token")
        self.ranks = ranks
        # Ids need not be consecutive; the order of joining is that of the ids.
        self.order = {raw: place for place, raw in enumerate(sorted(ranks, key=ranks.__getitem__))}
        self.raw_of = {i: raw for raw, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.child: dict[int, int] = {}
        self.packed_of = {i: packed([i]) for i in ranks.values()}
        tokens: dict[int, int] = {}
        nodes = 1
        for raw, i in ranks.items():
            node = ROOT
            for byte in raw:
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = nodes
                    nodes += 1
                node = self.child[key]
            tokens[node] = i
        self.token_at = [tokens.get(node, NONE) for node in range(nodes)]
        self.pairs: dict[int, bool] = {}
        self.histories: dict[int, list[tuple] | None] = {}
        self.most_states = most_states
        self._forget()

    def _forget(self) -> None:
        for state in self.number.values() if hasattr(self, "number") else ():
            state.clear()  # states refer to each other
        self.number: dict[tuple, dict] = {}
        self.start = self._state(((b"", START, ROOT),))

    def _history(self, token: int) -> list[tuple] | None:
        """How the token's bytes are joined, from its single bytes on; None if not to the token."""
        if token not in self.histories:
            raw = self.raw_of[token]
            parts, steps = joins(raw, self.order)
            self.histories[token] = [(0, raw[:1], raw[-1:]), *steps] if len(parts) == 1 else None
        return self.histories[token]

    def follows(self, before: int, token: int) -> bool:
        """Whether the two are the encoding of their bytes; after ``START``, the token of its own.

        On either side of the gap joins go on as in each token alone, the lower rank first and of equals
        the left one, unless the parts beside the gap have a rank that comes before both.
        """
        key = before << 32 | token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._stay_apart(before, token)
        return known

    def _stay_apart(self, before: int, token: int) -> bool:
        right = self._history(token)
        if before == START or right is None:
            return right is not None
        left = self._history(before)
        if left is None:
            return False
        none = len(self.order)
        i = j = 0
        while True:
            across = self.order.get(left[i][2] + right[j][1], none)
            next_left = left[i + 1][0] if i + 1 < len(left) else none
            next_right = right[j + 1][0] if j + 1 < len(right) else none
            if across < next_left and across <= next_right and across < none:
                return False
            if next_left == next_right == none:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def _state(self, places: tuple) -> dict:
        """A state by its places: its moves by byte, its ``PLACES``, and its ``FINAL`` tokens.

        The last place is the one at the root.
        """
        state = self.number.get(places)
        if state is None:
            state = self.number[places] = {PLACES: places, FINAL: places[-1][0]}
        return state

    def _make_move(self, state: dict, byte: int) -> tuple[dict, bytes]:
        child, token_at, pairs = self.child, self.token_at, self.pairs
        found = []
        ended, holding = None, True
        for held, before, node in state[PLACES]:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            found.append((held, before, node))
            if not held:
                holding = False
            token = token_at[node]
            if ended is None and token != NONE:
                fits = pairs.get(before << 32 | token)
                if self.follows(before, token) if fits is None else fits:
                    ended = held + self.packed_of[token], token, ROOT
        found.append(ended)
        put = b""
        if holding:
            first, last = min(found)[0], max(found)[0]
            same = 0
            while same < len(first) and first[same:same + 4] == last[same:same + 4]:
                same += 4
            put = first[:same]
            found = [(held[same:], before, node) for held, before, node in found]
        move = state[byte] = self._state(tuple(found)), put
        return move

    def encode(self, raw: bytes) -> bytes:
        """The packed ids of some bytes."""
        if len(self.number) > self.most_states:
            self._forget()
        state, out = self.start, b""
        for byte in raw:
            state, put = state.get(byte) or self._make_move(state, byte)
            if put:
                out += put
        return out + state[FINAL]

    def stream(self, pieces: Iterable[bytes]) -> Iterator[bytes]:
        """Packed ids of the joined ``pieces``, each put out as soon as the bytes read settle it."""
        state = self.start
        for piece in pieces:
            out = b""
            for byte in piece:
                state, put = state.get(byte) or self._make_move(state, byte)
                out += put
            yield out
        yield state[FINAL]
