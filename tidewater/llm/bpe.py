"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is one last token that the encoding of that prefix can end in.
A token may follow another only if merging the two tokens' bytes yields just these two, so the
last token of a prefix is the one token whose start joins validly to the last token of the
shorter prefix. The table of last tokens makes an append exact and cheap, and an edit re-encodes
from the edit's place until the table agrees with the old one again.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import regex
from pyspark.sql import DataFrame

from .shared import map_rows

_CUT = re.compile(r"(?<=\S) (?=\S)")


class PrefixEncoder:
    """Ranks, and the memory of which tokens may follow which."""

    def __init__(self, ranks: dict[bytes, int], memory: int = 1_000_000):
        self.ranks, self.memory = ranks, memory
        self.tokens = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Tokens that merges alone lead to; any other is used for a whole piece only.
        self.reachable = {b: i for b, i in ranks.items() if self.merge(b) == [b]}
        self._pairs: dict[tuple[int, int], bool] = {}

    @classmethod
    def load(cls, path: str) -> PrefixEncoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merge(self, text: bytes) -> list[bytes]:
        """The definition: again and again merge the leftmost adjacent pair of the lowest rank."""
        parts = [text[i : i + 1] for i in range(len(text))]
        rank = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both yields just these two."""
        if len(self._pairs) >= self.memory:
            self._pairs.clear()
        a, b = self.tokens[left], self.tokens[right]
        found = self._pairs[left, right] = self.merge(a + b) == [a, b]
        return found

    def last_tokens(self, text: bytes, table: list[int], upto: int | None = None) -> list[int]:
        """Extend table, the last token of each prefix of text, to upto bytes."""
        token_of, known, longest = self.reachable.get, self._pairs.get, self.longest
        for end in range(len(table) + 1, (len(text) if upto is None else upto) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = token_of(text[start:end])
                if token is None:
                    continue
                if start == 0:
                    break
                valid = known((table[start - 1], token))
                if valid or valid is None and self.may_follow(table[start - 1], token):
                    break
            else:
                raise ValueError("the ranks lack a byte")
            table.append(token)
        return table

    def backtrack(self, table: list[int]) -> list[int]:
        out, end = [], len(table)
        while end:
            out.append(table[end - 1])
            end -= len(self.tokens[table[end - 1]])
        return out[::-1]

    def piece(self, text: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(text)
        return [whole] if whole is not None else self.backtrack(self.last_tokens(text, []))

    def pieces(self, texts: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of many matches; in sorted order each keeps the table of the prefix shared with the one before."""
        out, table, before = {}, [], b""
        for text in sorted(texts):
            whole = self.ranks.get(text)
            if whole is not None:
                out[text] = [whole]
                continue
            shared = 0
            for x, y in zip(before, text):
                if x != y:
                    break
                shared += 1
            del table[shared:]
            out[text] = self.backtrack(self.last_tokens(text, table))
            before = text
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixTable:
    """One piece under appends and edits; ids() is always what encoding it anew gives."""

    def __init__(self, encoder: PrefixEncoder, text: bytes = b""):
        self.encoder, self.text, self.table = encoder, b"", []
        self.append(text)

    def append(self, more: bytes) -> None:
        self.text += more
        self.encoder.last_tokens(self.text, self.table)

    def splice(self, start: int, stop: int, new: bytes) -> int:
        """Replace text[start:stop]; return how many prefixes were encoded again.

        Once as many prefixes in a row as the longest token has bytes agree with the old table,
        all later ones do, for nothing else enters them.
        """
        old, shift = self.table, len(new) - (stop - start)
        self.text = self.text[:start] + new + self.text[stop:]
        table, same, done = old[:start], 0, start
        settled = start + len(new)
        while done < len(self.text):
            self.encoder.last_tokens(self.text, table, done + 1)
            done += 1
            same = same + 1 if done > settled and table[-1] == old[done - 1 - shift] else 0
            if same >= self.encoder.longest:
                table += old[done - shift :]
                break
        self.table = table
        return done - start

    def ids(self) -> list[int]:
        whole = self.encoder.ranks.get(self.text)
        return [whole] if whole is not None else self.encoder.backtrack(self.table)


class Stretches:
    """Values of the stretches of texts between single spaces, remembered up to a bound.

    A match of the pattern begins at each space between two characters that aren't white,
    whatever surrounds it, so the matches of a text are those of its stretches in turn.
    """

    def __init__(self, values, memory: int):
        """values: from a list of stretches, each with the space before it, to a list of values."""
        self.values, self.memory = values, memory
        self.first: dict[str, object] = {}
        self.later: dict[str, object] = {}

    def of(self, texts: list[str]):
        """For each text the list of its stretches' values; read in groups of some million characters."""
        for group in grouped(texts):
            cut = [t.split(" ") if t else [] for t in group]
            if len(self.later) + len(self.first) > self.memory:
                self.later.clear()
                self.first.clear()
            head = {c[0] for c in cut if c}.difference(self.first)
            new = set()
            for c in cut:
                new.update(c[1:])
            new.difference_update(self.later)
            odd, edges = {s for s in head | new if _white(s)}, {}
            if odd:
                for i, t in enumerate(group):
                    if not odd.isdisjoint(cut[i]):
                        cut[i] = _CUT.split(t)
                        edges.update({(k > 0, s): None for k, s in enumerate(cut[i]) if _white(s)})
                        head.update(cut[i][:1])
                        new.update(cut[i][1:])
                head = {s for s in head if not _white(s)}.difference(self.first)
                new = {s for s in new if not _white(s)}.difference(self.later)
            first, later, at_edge = list(head), list(new), list(edges)
            found = self.values(first + [" " + s for s in later] + [" " * k + s for k, s in at_edge])
            self.first.update(zip(first, found))
            self.later.update(zip(later, found[len(first) :]))
            edges = dict(zip(at_edge, found[len(first) + len(later) :]))
            for c in cut:
                if c and (_white(c[0]) or _white(c[-1])):
                    yield [edges[k > 0, s] if _white(s) else (self.later if k else self.first)[s] for k, s in enumerate(c)]
                else:
                    yield [self.first[c[0]], *map(self.later.__getitem__, c[1:])] if c else []


def _white(s: str) -> bool:
    """Empty, or with white space at an end: such a stretch isn't remembered, for it stands at a text's end only."""
    return not s or s[0].isspace() or s[-1].isspace()


def grouped(texts: list[str], chars: int = 2_000_000):
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def stretches(encoder: PrefixEncoder, pattern: str, memory: int = 500_000, pieces: int = 500_000) -> Stretches:
    """Values: ids as little-endian 32-bit integers."""
    find, known = regex.compile(pattern).findall, {}

    def values(new):
        matches = [[m.encode() for m in find(s)] for s in new]
        missing = {m for ms in matches for m in ms}.difference(known)
        if len(known) > pieces:
            known.clear()
            missing = {m for ms in matches for m in ms}
        for m, ids in encoder.pieces(list(missing)).items():
            known[m] = array("I", ids).tobytes()
        return [b"".join([known[m] for m in ms]) for ms in matches]

    return Stretches(values, memory)


_ENCODERS: dict[tuple[str, str], tuple[PrefixEncoder, Stretches]] = {}


def _encoders(path: str, pattern: str) -> tuple[PrefixEncoder, Stretches]:
    """One of each kind in a Python worker, whose later tasks find it warm."""
    if (path, pattern) not in _ENCODERS:
        encoder = PrefixEncoder.load(path)
        _ENCODERS[path, pattern] = encoder, stretches(encoder, pattern)
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): ids of every whole text. A null text is an empty one and has no ids."""

    def make():
        encoder, texts = _encoders(path, pattern)

        def work(keys, values):
            return keys, [list(array("I", b"".join(x))) for x in texts.of([v or "" for v in values])]

        return work

    key = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), make, f"`{id_col}` {key}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, bytes): the bytes that the ids stand for; null ids give none."""

    def make():
        encoder, _ = _encoders(path, ".")
        return lambda keys, ids: (keys, [encoder.decode(x or []) for x in ids])

    key = encoded.schema[id_col].dataType.simpleString()
    return map_rows(encoded.select(id_col, ids_col), make, f"`{id_col}` {key}, bytes binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every whole text, decode the ids, and keep the digests of both; one pass, no shuffle."""

    def make():
        encoder, texts = _encoders(path, pattern)
        token = encoder.tokens.__getitem__
        digits = list(map(str, range(max(encoder.tokens) + 1))).__getitem__

        def work(keys, values):
            counts, of_ids, of_bytes = [], [], []
            for parts in texts.of([v or "" for v in values]):
                ids = array("I", b"".join(parts))
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(digits, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(b"".join(map(token, ids))).hexdigest())
            return keys, counts, of_ids, of_bytes

        return work

    return map_rows(
        docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
