"""Best-fit packing of token pieces into sequences, improved by swaps.

Pieces are dealt at random into blocks of a bounded size, and each block is packed by itself:
best fit in decreasing order first, then local search. The search takes the least filled sequence
and moves documents to fuller ones, or exchanges one for one, two for one or one for two, so that
the sum of squared fills rises until sequences run empty. It looks at every document of every
underfull sequence, by length, and ends when no such step is left or no sequence can be saved.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Stretches
from .shared import arrow_schema, store

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if it prints, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """From texts to ids as little-endian 32-bit integers, by a vocabulary file of `tokenizers`.

    The file's added tokens are cut out of a text first, leftmost and longest, each as its one id, as that
    library does; what stands between them is encoded by the ranks.
    """

    def __init__(self, path: str, pattern: str, memory: int = 150_000):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added = file["added_tokens"]
        if file["normalizer"] or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: normalizers and added tokens that take in their surroundings aren't read")
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        self.parts = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.added, key=len, reverse=True)) or "(?!)")
        of = byte_of_char()
        ranks = {bytes(map(of.__getitem__, t)): i for t, i in file["model"]["vocab"].items() if set(t) <= of.keys() and t not in self.added}
        encode = tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.stretches = Stretches(lambda new: [array("I", encode(s)).tobytes() for s in new], memory)

    def of(self, texts: list[str]):
        """The ids of each text, in bytes."""
        if not any(t in text for t in self.added for text in texts):
            yield from map(b"".join, self.stretches.of(texts))
            return
        cut = [[x for x in self.parts.split(t) if x] for t in texts]
        plain = self.stretches.of([x for parts in cut for x in parts if x not in self.added])
        for parts in cut:
            yield b"".join([self.added[x] if x in self.added else b"".join(next(plain)) for x in parts])


_TEXTS: dict[tuple[str, str], Encoder] = {}


def _texts(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _TEXTS:
        _TEXTS[path, pattern] = Encoder(path, pattern)
    return _TEXTS[path, pattern]


def cut(size: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: all but the first are full."""
    first = (size - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, size, capacity)]


def token_pieces(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of at most capacity tokens of every whole text with end_id after it; a null text is an empty one."""
    schema = arrow_schema(PIECES)

    def run(batches):
        texts, end = _texts(path, pattern), array("I", [end_id]).tobytes()
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            out = []
            for key, ids in zip(keys, texts.of([t or "" for t in batch.column("text").to_pylist()])):
                ids += end
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    out.append((key, k, s, n, zlib.crc32(memoryview(ids)[4 * s : 4 * (s + n)])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(list(zip(*out)) or [[]] * 5, schema)], schema=schema
            )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has r tokens of room
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        above = rooms >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


def local_search(lengths: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Move and exchange documents between underfull bins until no step raises the sum of squared fills or no bin can be saved."""
    search = Search(lengths, bins, capacity)
    fewest = -(-sum(lengths) // capacity)
    stuck, changed = np.zeros(len(bins), dtype=bool), False
    while search.live > fewest:
        open_ = np.flatnonzero((search.fill > 0) & (search.fill < capacity) & ~stuck)
        if len(open_) == 0:
            if not changed:
                break
            stuck[:], changed = False, False  # what was stuck may fit since other bins have changed
            continue
        src = int(open_[np.argmin(search.fill[open_])])
        step = search.best_step(src)
        if step is None:
            stuck[src] = True
        else:
            search.apply(src, *step)
            stuck[src], changed = False, True
            stuck[step[0]] = False
    return [sorted(b, key=lambda i: (-lengths[i], i)) for b in search.bins if b]


class Search:
    """Bins of documents under exchanges."""

    def __init__(self, lengths: list[int], bins: list[list[int]], capacity: int):
        self.size, self.capacity = np.asarray(lengths, dtype=np.int64), capacity
        self.bins = [list(b) for b in bins]
        self.fill = np.array([sum(lengths[i] for i in b) for b in bins], dtype=np.int64)
        self.home = np.zeros(len(lengths), dtype=np.int64)
        for b, members in enumerate(bins):
            self.home[members] = b
        self.live = len(bins)
        self.by_length = np.argsort(self.size, kind="stable")
        ordered = self.size[self.by_length]
        self.first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(lengths) else np.zeros(0, dtype=np.int64)
        self.distinct = ordered[self.first]
        self._pairs: dict[int, dict[int, list[int]]] = {}
        self._flat: tuple[np.ndarray, np.ndarray] | None = None

    def apply(self, src: int, dst: int, out: list[int], back: list[int]) -> None:
        delta = int(self.size[out].sum() - self.size[back].sum())
        self.fill[src] -= delta
        self.fill[dst] += delta
        for moved, old, new in ((out, src, dst), (back, dst, src)):
            for i in moved:
                self.bins[old].remove(i)
                self.bins[new].append(i)
                self.home[i] = new
        self._pairs.pop(src, None)
        self._pairs.pop(dst, None)
        self._flat = None
        self.live -= self.fill[src] == 0

    def best_step(self, src: int):
        """(bin, documents out, documents back) of the step that fills another bin, no emptier, the most; None if there is none."""
        room = np.where((self.fill >= self.fill[src]) & (self.fill < self.capacity), self.capacity - self.fill, -1)
        room[src] = -1
        most = int(room.max())
        if most <= 0:
            return None
        best, step = 0, None
        one = {int(self.size[i]): [i] for i in self.bins[src]}
        gifts = self._two(src) | one
        sums = np.array(sorted(gifts), dtype=np.int64)
        # A move: the largest gift that some bin has room for, to the bin with the least room for it.
        fits = sums[sums <= most]
        if len(fits):
            g = int(fits[-1])
            best, step = g, (self._least_room(room, g), gifts[g], [])
        # An exchange for one: for each gift the shortest document whose bin has room for the difference.
        spare = np.maximum.reduceat(room[self.home][self.by_length], self.first)
        reach = np.maximum.accumulate(np.where(spare > 0, self.distinct + spare, -1))
        at = np.searchsorted(reach, sums)
        ok = at < len(reach)
        gain = np.where(ok, sums - self.distinct[np.minimum(at, len(reach) - 1)], 0)
        k = int(np.argmax(gain)) if len(gain) else 0
        if len(gain) and gain[k] > best:
            best, t = int(gain[k]), int(self.distinct[at[k]])
            own = self.by_length[self.first[at[k]] :][: np.searchsorted(self.size[self.by_length], t, "right") - self.first[at[k]]]
            own = own[room[self.home[own]] >= best]
            i = int(own[np.argmin(room[self.home[own]])])
            step = (int(self.home[i]), gifts[int(sums[k])], [i])
        if step is None:  # one for two
            theirs, owner = self._all_pairs()
            for g in sorted(one, reverse=True):
                gain = g - theirs
                gain[(gain > room[owner]) | (room[owner] <= 0)] = 0
                k = int(np.argmax(gain)) if len(gain) else 0
                if len(gain) and gain[k] > best:
                    best, b = int(gain[k]), int(owner[k])
                    step = (b, one[g], self._two(b)[int(theirs[k])])
        return step

    def _least_room(self, room: np.ndarray, least: int) -> int:
        fits = np.flatnonzero(room >= least)
        return int(fits[np.argmin(room[fits])])

    def _two(self, b: int) -> dict[int, list[int]]:
        """Two documents of the bin for each sum that two have."""
        if b not in self._pairs:
            of: dict[int, list[int]] = {}
            for i in self.bins[b]:
                of.setdefault(int(self.size[i]), []).append(i)
            kinds, out = sorted(of), {}
            for k, x in enumerate(kinds):
                if len(of[x]) > 1:
                    out[2 * x] = of[x][:2]
                for y in kinds[k + 1 :]:
                    out[x + y] = [of[x][0], of[y][0]]
            self._pairs[b] = out
        return self._pairs[b]

    def _all_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of two documents of one underfull bin, and their bins."""
        if self._flat is None:
            under = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity)).tolist()
            sums = [list(self._two(b)) for b in under]
            owner = np.repeat(np.array(under, dtype=np.int64), [len(x) for x in sums])
            self._flat = np.array([x for own in sums for x in own], dtype=np.int64), owner
        return self._flat


def pack(pieces: DataFrame, capacity: int = 2048, block: int = 4096) -> DataFrame:
    """Add sequence_id and offset to rows with doc_id, piece and length (1 to capacity).

    block: pieces packed together, about; a block of n pieces takes memory for n lengths, and which
    rows are in it is by chance, so that repeated rows and null ids are packed like any other.
    Columns named sequence_id or offset are replaced; without rows there are no sequences.
    """
    pieces = pieces.drop("sequence_id", "offset")
    rows = store(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    blocks = max(1, -(-rows.count() // block))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    schema = arrow_schema(ddl)

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("_row", "ascending")])
        lengths = table.column("length").to_pylist()
        number = table.column("_block")[0].as_py() << 32
        bins = local_search(lengths, best_fit(lengths, capacity), capacity)
        seq, off = [0] * len(lengths), [0] * len(lengths)
        for b, members in enumerate(bins):
            at = 0
            for i in members:
                seq[i], off[i] = number + b, at
                at += lengths[i]
        out = table.drop_columns(["_block", "_row"])
        return out.append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(off, pa.int64())).cast(schema)

    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)))
    return dealt.groupBy("_block").applyInArrow(fill, ddl)
