"""Tokens of two tokenizers aligned by the bytes they cover, with links counted over the corpus.

The tokens that end in a range of a text's bytes make a fragment: an open prefix up to the first
offset at which both tokenizers end a token, the closed groups after it, and an open suffix. Fragments
of adjacent ranges compose, and composing is associative: where both have such an offset, the left
one's suffix and the right one's prefix close to one group. A long text is cut into ranges of bytes
that are aligned in tasks of their own, and its fragments are composed in a tree of groupings.

Inside a range most of the text is stretches, each from a single space between characters that aren't
white up to the next one. Both tokenizers begin anew there: no match of the first one's pattern and no
piece of the second one crosses such a place. So a stretch's groups are the same wherever it stands,
and are remembered.

Links of a pair of ids are counted by documents. Documents are in batches of bounded size; only the
different pairs of a batch go to the counts and back, and a document's links are looked up in its batch.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import grouped
from .packing import byte_of_char
from .shared import arrow_schema, small_batches, store

_CUT = re.compile(r"(?<=\S) (?=\S)")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: A pair of ids is one number.
_SHIFT = 32


@dataclass
class Tokens:
    """Ids with the byte offsets of their ends."""

    ids: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(self.ids + other.ids, self.ends + other.ends)

    def cut(self, a: int, z: int) -> Tokens:
        return Tokens(self.ids[a:z], self.ends[a:z])


@dataclass
class Closed:
    """Groups in a row: how many, how many tokens, the links of each pair of ids, and the ids as text."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    links: Counter = field(default_factory=Counter)
    text: list[str] = field(default_factory=list)

    def __add__(self, other: Closed) -> Closed:
        return Closed(self.n_a + other.n_a, self.n_b + other.n_b, self.n_groups + other.n_groups, self.links + other.links, self.text + other.text)


def group(a: Tokens, b: Tokens) -> Closed:
    """One group of tokens that begin and end at the same offsets; of no tokens, none. Linked are those whose bytes overlap."""
    if not a.ids and not b.ids:
        return Closed()
    links, i, j = Counter(), 0, 0
    while i < len(a.ids) and j < len(b.ids):
        links[a.ids[i] << _SHIFT | b.ids[j]] += 1
        x, y = a.ends[i], b.ends[j]
        i, j = i + (x <= y), j + (y <= x)
    return Closed(len(a.ids), len(b.ids), 1, links, [f"{','.join(map(str, a.ids))}|{','.join(map(str, b.ids))}"])


@dataclass
class Fragment:
    """What stands before the first common end, the groups after it, and what follows the last one.

    closed is None where no common end is known; all tokens are then in `first`.
    """

    first: tuple[Tokens, Tokens] = field(default_factory=lambda: (Tokens(), Tokens()))
    closed: Closed | None = None
    last: tuple[Tokens, Tokens] = field(default_factory=lambda: (Tokens(), Tokens()))

    def __mul__(self, other: Fragment) -> Fragment:
        joined = lambda x, y: (x[0] + y[0], x[1] + y[1])
        if self.closed is None:
            return Fragment(joined(self.first, other.first), other.closed, other.last)
        if other.closed is None:
            return Fragment(self.first, self.closed, joined(self.last, other.first))
        return Fragment(self.first, self.closed + group(*joined(self.last, other.first)) + other.closed, other.last)


def begin() -> Fragment:
    """The start of a text, or any other known common end."""
    return Fragment(closed=Closed())


def fragment(a: Tokens, b: Tokens) -> Fragment:
    """Of adjacent tokens of each tokenizer that end in one range of bytes."""
    common = sorted(set(a.ends).intersection(b.ends))
    if not common:
        return Fragment((a, b))
    of = [({e: k + 1 for k, e in enumerate(t.ends)}, t) for t in (a, b)]
    parts, at = [], [0, 0]
    for e in common:
        upto = [places[e] for places, _ in of]
        parts.append(tuple(t.cut(x, y) for (_, t), x, y in zip(of, at, upto)))
        at = upto
    closed = sum((group(*p) for p in parts[1:]), Closed())
    return Fragment(parts[0], closed, tuple(t.cut(x, len(t.ids)) for (_, t), x in zip(of, at)))


class Pair:
    """Both tokenizers of a task, from vocabulary files of `tokenizers` and `sentencepiece`.

    The first one's ids are made by `tiktoken` from the same file's ranks, which is several times faster; the file's
    special tokens are plain text.
    """

    def __init__(self, path_a: str, path_b: str, pattern: str):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            file = json.load(f)
        if file["normalizer"] or not file["pre_tokenizer"]["use_regex"]:
            raise ValueError(f"{path_a}: normalizers and tokenizers without the pattern aren't read")
        of, special = byte_of_char(), {t["content"] for t in file["added_tokens"]}
        ranks = {bytes(map(of.__getitem__, t)): i for t, i in file["model"]["vocab"].items() if set(t) <= of.keys() and t not in special}
        self.encode_a = tiktoken.Encoding("align", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.bytes_a[i] = t
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.sizes = [np.array(list(map(len, known)), np.int64) for known in (self.bytes_a, self.bytes_b)]
        #: 3 i + k: an id and what stands after it.
        self.written = [f"{i}{after}" for i in range(max(map(len, self.sizes))) for after in ",|;"]

    def ids(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Both tokenizers' ids of stretches in a row, each after a space; None where either's bytes aren't the text's."""
        text = " ".join(stretches)
        found = self.encode_a(" " + text), self.b.encode(text, num_threads=1)
        raw = b" " + text.encode("utf-8", "surrogatepass")
        if any(b"".join(map(known.__getitem__, ids)) != raw for ids, known in zip(found, (self.bytes_a, self.bytes_b))):
            return None
        return tuple(np.array(ids, np.int64) for ids in found)

    def tokens(self, stretch: str) -> tuple[Tokens, Tokens] | None:
        found = self.ids([stretch])
        return found and tuple(Tokens(ids.tolist(), np.cumsum(size[ids]).tolist()) for ids, size in zip(found, self.sizes))


def white(s: str) -> bool:
    """Empty, or with white space at an end: a stretch at a text's end, which other stretches can't be written behind."""
    return not s or s != s.strip()


class Stretches:
    """Closed groups of stretches as flat arrays, remembered up to a bound."""

    def __init__(self, pair: Pair, memory: int = 150_000, chars: int = 100_000):
        self.pair, self.memory, self.chars = pair, memory, chars
        self.clear()

    def clear(self):
        self.place: dict[str, int] = {}
        self.odd: set[str] = set()
        self.text: list[str] = []
        self.counts = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, bad, n_links
        self.keys = np.zeros(0, np.int64)

    def learn(self, new: list[str]) -> None:
        inner, size, some = [s for s in new if not white(s)], 0, []
        counts, keys = [self.counts], [self.keys]
        for s in inner:
            some.append(s)
            size += len(s)
            if size > self.chars:
                self._learn(some, counts, keys)
                some, size = [], 0
        for some in (some, *[[s] for s in new if white(s)]):
            if some:
                self._learn(some, counts, keys)
        self.counts, self.keys = np.concatenate(counts), np.concatenate(keys)

    def _learn(self, new: list[str], counts: list, keys: list) -> None:
        """Encode stretches in a row. If bytes differ somewhere each half is tried, down to the stretches at fault."""
        both = self.pair.ids(new)
        if both is None and len(new) > 1:
            self._learn(new[: len(new) // 2], counts, keys)
            self._learn(new[len(new) // 2 :], counts, keys)
            return
        self.place.update(zip(new, range(len(self.text), len(self.text) + len(new))))
        if both is None:
            self.text.append("")
            counts.append(np.array([[0, 0, 0, 1, 0]]))
            return
        (a, b), (end_a, end_b) = both, [np.cumsum(size[ids]) for ids, size in zip(both, self.pair.sizes)]
        ends = np.union1d(end_a, end_b)  # between two of them one token of each side: a link
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        link_a, link_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        keys.append(a[link_a] << _SHIFT | b[link_b])
        # Ids as text: the tokens of each group in turn, with what stands after them.
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        last_a, last_b = common[group_a] == end_a, common[group_b] == end_b
        order = np.argsort(np.append(2 * group_a, 2 * group_b + 1), kind="stable")
        word = np.append(a * 3 + last_a, b * 3 + 2 * last_b)[order]
        parts = list(map(self.pair.written.__getitem__, word.tolist()))
        upto = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        whole, stop = "".join(parts), np.cumsum([1 + len(s.encode("utf-8", "surrogatepass")) for s in new])
        of = lambda at: np.searchsorted(at, stop, "right")  # noqa: E731  how many stand before each stretch's end
        n_a, n_b, n_groups, n_links = (np.diff(of(at), prepend=0) for at in (end_a, end_b, common, ends))
        chars = np.append(0, upto[np.cumsum(n_a + n_b) - 1]).tolist()
        self.text += [whole[x : z - 1] for x, z in zip(chars, chars[1:])]
        counts.append(np.stack([n_a, n_b, n_groups, np.zeros_like(n_a), n_links], axis=1))

    def cut(self, texts: list[str]) -> list[list[str]]:
        """Each text's stretches. Splitting at every space is right unless a part is empty or white at an end."""
        out = [t.split(" ") for t in texts]
        every = set().union(*out)
        odd = {s for s in every.difference(self.place) if white(s)} | every.intersection(self.odd)
        return [c if odd.isdisjoint(c) else _CUT.split(t) for c, t in zip(out, texts)] if odd else out

    def of(self, texts: list[str]):
        """Of texts that stand after a space: (n_a, n_b, n_groups, pairs, their links, groups) of each; None where bytes differ."""
        cut = self.cut(texts)
        if len(self.text) > self.memory:
            self.clear()
        new = set().union(*cut).difference(self.place)
        self.learn(list(new))
        self.odd.update(filter(white, new))
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(cut)), np.int64)
        size = np.array([len(c) for c in cut])
        sums = np.add.reduceat(self.counts[at], np.append(0, np.cumsum(size)[:-1]))
        # The pairs of each stretch of each text, in one array.
        begins, lengths = np.append(0, np.cumsum(self.counts[:, 4]))[:-1][at], self.counts[at, 4]
        flat = np.repeat(begins - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
        text_of = np.repeat(np.repeat(np.arange(len(cut)), size), lengths)
        pairs, number = np.unique(self.keys[flat], return_inverse=True)
        both, where = np.unique(text_of * len(pairs) + number, return_inverse=True)
        times = np.bincount(where)
        upto = np.searchsorted(both, np.arange(len(cut) + 1) * len(pairs))
        pairs = pairs[both % len(pairs)] if len(pairs) else both
        stop = np.append(0, np.cumsum(size)).tolist()
        for k in range(len(cut)):
            if sums[k, 3]:
                yield None
            else:
                own = slice(upto[k], upto[k + 1])
                yield (*sums[k, :3].tolist(), pairs[own], times[own], ";".join(map(self.text.__getitem__, at[stop[k] : stop[k + 1]].tolist())))


def safe(raw: bytes, at: int) -> bool:
    """Whether a stretch begins at this byte: a space between characters that aren't white."""
    if at == 0:
        return True
    before, after = raw[max(0, at - 4) : at].decode("utf-8", "ignore"), raw[at + 1 : at + 5].decode("utf-8", "ignore")
    return raw[at : at + 1] == b" " and bool(before) and bool(after) and not before[-1].isspace() and not after[0].isspace()


def stretch_around(raw: bytes, at: int) -> tuple[int, int]:
    """(begin, end) of the stretch that holds this offset; one that begins there is the one after it."""
    a, z = at, raw.find(b" ", at + 1)
    while not safe(raw, a):
        a = raw.rfind(b" ", 0, a)
        if a < 0:
            a = 0
    while z >= 0 and not safe(raw, z):
        z = raw.find(b" ", z + 1)
    return a, len(raw) if z < 0 else z


def ranges(raw: bytes, size: int) -> list[tuple[int, int, int, int]]:
    """(from, to, begin, end): ranges of about `size` bytes, each with the bytes of all stretches that reach into it.

    A stretch longer than a range isn't cut: the range ends with it.
    """
    out, at, left = [], 0, 0
    while at < len(raw):
        to, right, following = len(raw), len(raw), 0
        if len(raw) - at > size + size // 2:
            a, z = stretch_around(raw, at + size)
            to, right, following = (z, z, z) if z - a > size else (at + size, z if a < at + size else a, a)
        out.append((at, to, left, right))
        at, left = to, following
    return out


def of_range(stretches: Stretches, raw: bytes, at: int, to: int, left: int) -> Fragment | None:
    """The fragment of tokens that end in (at, to]; raw: the stretches that reach into it, from offset `left`. None where bytes differ."""
    parts, whole, edge = stretches.cut([raw[1:].decode("utf-8", "surrogatepass")])[0], [], begin() if at == 0 else Fragment()
    here, tail = left, Fragment()
    for s in parts:
        end = here + 1 + len(s.encode("utf-8", "surrogatepass"))
        if here >= at and end <= to:
            whole.append(s)
        else:
            both = stretches.pair.tokens(s)
            if both is None:
                return None
            own = []
            for t in both:
                keep = [k for k, e in enumerate(t.ends) if at < here + e <= to]
                own.append(Tokens([t.ids[k] for k in keep], [here + t.ends[k] for k in keep]))
            if here < at:
                edge = edge * fragment(*own)
            else:
                tail = fragment(*own)
        here = end
    if whole:
        found = next(stretches.of([" ".join(whole)]))
        if found is None:
            return None
        n_a, n_b, n_groups, pairs, times, text = found
        edge = edge * Fragment(closed=Closed(n_a, n_b, n_groups, Counter(dict(zip(pairs.tolist(), times.tolist()))), [text]))
    return edge * tail


_PAIRS: dict[tuple[str, ...], Stretches] = {}


def _stretches(*files: str) -> Stretches:
    if files not in _PAIRS:
        _PAIRS[files] = Stretches(Pair(*files))
    return _PAIRS[files]


ALIGNED = "batch long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, links array<int>"
_PIECE = "row string, doc_id long, chunk int, start long, stop long, begin long, raw binary"
_SIDES = [f"{part}_{side}{what}" for part in ("first", "last") for side in "ab" for what in ("", "_ends")]
_FRAGMENT = "row string, doc_id long, chunk int, known boolean, same boolean, n_a long, n_b long, n_groups long, pairs array<long>, links array<int>, text string, " + ", ".join(f"{c} array<long>" for c in _SIDES)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _numbers(long_texts: int):
    """Batch numbers of a task, of their own for whole and for composed texts."""
    at = (TaskContext.get().partitionId() * 2 + long_texts) << 24
    while True:
        yield at
        at += 1


def aligned(docs: DataFrame, path_a: str, path_b: str, pattern: str, size: int = 65_536) -> DataFrame:
    """ALIGNED, a row for each row of docs, written: counts and digest of its groups, its different pairs and how often each is linked.

    Null and empty texts, and those that either tokenizer doesn't give back byte by byte, have no tokens. Texts over
    `size` characters are cut into ranges of so many bytes. Repeated rows are rows of their own.
    """
    small_batches(docs.sparkSession, 1000)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none, of_text, of_piece, of_part = (0, 0, 0, "", [], []), arrow_schema(ALIGNED), arrow_schema(_PIECE), arrow_schema(_FRAGMENT)

    def whole(batches):
        stretches, number = _stretches(path_a, path_b, pattern), _numbers(0)
        for batch in batches:
            ids, texts, out, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], 0
            key = next(number)
            for some in grouped(texts):
                found = stretches.of([t for t in some if t]) if any(some) else iter(())
                for t in some:
                    got = next(found) if t else None
                    if got is None:
                        out.append((key, ids[at], *none))
                    else:
                        n_a, n_b, n_groups, pairs, times, groups = got
                        out.append((key, ids[at], n_a, n_b, n_groups, hashlib.sha256(groups.encode()).hexdigest(), pairs, times))
                    at += 1
            yield _batch(out, of_text)

    def pieces(batches):
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw, row = b" " + t.encode("utf-8", "surrogatepass"), uuid.uuid4().hex
                for k, (at, to, left, right) in enumerate(ranges(raw, size)):
                    yield _batch([(row, key, k, at, to, left, raw[left:right])], of_piece)

    def fragments(batches):
        stretches = _stretches(path_a, path_b, pattern)
        for batch in batches:
            yield _batch([
                _row(p["row"], p["doc_id"], p["chunk"], of_range(stretches, p["raw"], p["start"], p["stop"], p["begin"])) for p in batch.to_pylist()
            ], of_part)

    def composed(table: pa.Table) -> pa.Table:
        rows = sorted(table.drop_columns("above").to_pylist(), key=lambda r: r["chunk"])
        done = _fragment(rows[0])
        for r in rows[1:]:
            done = done * f if done and (f := _fragment(r)) else None
        return pa.Table.from_batches([_batch([_row(rows[0]["row"], rows[0]["doc_id"], rows[0]["chunk"] // 16, done)], of_part)])

    def ended(batches):
        number = _numbers(1)
        for batch in batches:
            key, out = next(number), []
            for r in batch.to_pylist():
                got = (r["n_a"], r["n_b"], r["n_groups"], hashlib.sha256(r["text"].encode()).hexdigest(), r["pairs"], r["links"]) if r["same"] else none
                out.append((key, r["doc_id"], *got))
            yield _batch(out, of_text)

    long = F.length("text") > size
    short = store(text.where(~long).mapInArrow(whole, ALIGNED), "aligned")
    cut = store(text.where(long).mapInArrow(pieces, _PIECE), "pieces")
    last = cut.agg(F.max("chunk")).first()[0]
    if last is None:
        return short
    found = store(cut.repartition("row", "chunk").mapInArrow(fragments, _FRAGMENT), "fragments")
    while last:
        found, last = found.withColumn("above", F.floor(F.col("chunk") / 16)).groupBy("row", "above").applyInArrow(composed, _FRAGMENT), last // 16
    return short.unionByName(store(found.mapInArrow(ended, ALIGNED), "composed"))


def _row(row: str, doc_id: int | None, chunk: int, f: Fragment | None) -> tuple:
    known = f is not None and f.closed is not None
    c = f.closed if known else Closed()
    sides = [x for part in (f.first, f.last) for t in part for x in (t.ids, t.ends)] if f else [[]] * 8
    return (row, doc_id, chunk, known, f is not None, c.n_a, c.n_b, c.n_groups, list(c.links), list(c.links.values()), ";".join(c.text), *sides)


def _fragment(r: dict) -> Fragment | None:
    if not r["same"]:
        return None
    t = [Tokens(r[f"{part}_{side}"], r[f"{part}_{side}_ends"]) for part in ("first", "last") for side in "ab"]
    closed = Closed(r["n_a"], r["n_b"], r["n_groups"], Counter(dict(zip(r["pairs"], r["links"]))), [r["text"]] if r["text"] else []) if r["known"] else None
    return Fragment((t[0], t[1]), closed, (t[2], t[3]))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): in how many rows of `aligned` a pair is linked, and whether no other pair of its first id is in more."""
    counts = store(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    first = F.shiftright("pair", _SHIFT).alias("a")
    most = counts.groupBy(first).agg(F.max("n").alias("most"))
    return counts.withColumn("a", first).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, path_a: str, path_b: str, pattern: str, size: int = 65_536) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs.

    n_best: links whose pair is in as many documents as any pair of its first id, ties included. count_sum: over links.
    """
    rows = aligned(docs, path_a, path_b, pattern, size)
    wanted = rows.select("batch", F.explode("pairs").alias("pair")).distinct()
    known = wanted.join(pair_counts(rows), "pair").select(F.col("batch").alias("of"), "pair", "n", "best")
    ddl = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    schema = arrow_schema(ddl)

    def looked_up(left: pa.Table, right: pa.Table) -> pa.Table:
        pair = right.column("pair").to_numpy()
        order = np.argsort(pair)
        pair, n = pair[order], right.column("n").to_numpy()[order]
        best = right.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
        size = pc.list_value_length(left.column("pairs")).to_numpy().astype(np.int64)
        flat = left.column("pairs").combine_chunks().flatten().to_numpy()
        links = left.column("links").combine_chunks().flatten().to_numpy().astype(np.int64)
        at, upto = np.searchsorted(pair, flat), np.append(0, np.cumsum(size))
        summed = lambda v: np.diff(np.append(0, np.cumsum(v))[upto]) if len(v) else np.zeros(len(size), np.int64)
        n_links, n_best, total = summed(links), summed(links * best[at] if len(flat) else links), summed(links * n[at] if len(flat) else links)
        cols = [*[left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")], n_links, n_best, total, left.column("groups_sha256")]
        return pa.table([c.cast(f.type) if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return rows.groupBy("batch").cogroup(known.groupBy("of")).applyInArrow(looked_up, ddl)
