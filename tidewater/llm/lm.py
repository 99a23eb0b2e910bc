"""Language-model scores by a weighted backoff automaton.

States are the contexts of up to two words that training texts hold. An arc reads a word and carries
the smoothed log-probability of the n-gram; the failure arc of a state carries the weight of going on
from the context shorter by a word. All n-grams of one to three words are counted, without a cutoff.

The model grows with the corpus, so no task holds it. Texts are dealt in chunks of about `tokens`
tokens and kept as numbers of words. A chunk first sends each of its different words, by 96 bits of
its hash, to a shard of words, which counts it and numbers it, frequent words first; no two words of
the corpus have one number. Then it sends each of its different pairs and triples as such numbers,
with its own count, to the shard of the n-gram; a shard adds up what all chunks sent and answers each
in the order it was asked; the chunk compiles its part of the automaton from the answers and traverses
its texts. An n-gram isn't sent if no other chunk holds one of its words, for then its count is the
chunk's own, or if no training text holds one. So counts are exact at any size, a frequent n-gram is one
key a chunk, and only numbers and counts are shuffled. Words' hashes go to their shards only.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_schema, remainder, small_batches, store

#: Stands for the end of a text; no word holds white space.
END = b"\n"
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]

#: A chunk: its words' hashes in order, the numbers of words in that order, texts as numbers of words, and by text the id, fold and length.
TEXTS = "chunk long, hashes binary, checks binary, places binary, numbers binary, ids array<long>, held array<boolean>, lengths array<long>, tokens long"
#: Questions and answers of a chunk and a shard. Keys of a question are columns, those of an answer are words' numbers and marks; a shard's sums have no chunk.
ASKED = "chunk long, shard long, keys array<binary>, counts binary, total long, kinds long"


def words(text: str | None) -> list[bytes]:
    """Words in lower case for A-Z, then the end."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    found.append(END)
    return found


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes, which compress well."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def spread(packed: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * _MULTIPLIERS[0] + (y ^ (y >> np.uint64(31))) * _MULTIPLIERS[1]
    z ^= z >> np.uint64(29)
    z *= _MULTIPLIERS[2]
    z ^= z >> np.uint64(32)
    return z


@dataclass
class Chunk:
    """Texts as numbers of their words; hashes and checks have one of each different word, lengths and held are by text.

    order: the words by hash and check, which take the place of these where the order is known.
    """

    hashes: np.ndarray | None
    checks: np.ndarray | None
    tokens: np.ndarray
    lengths: np.ndarray
    held: np.ndarray
    order: np.ndarray | None = None

    def __post_init__(self):
        at = np.arange(len(self.tokens)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.two, self.three = np.flatnonzero(at >= 1), np.flatnonzero(at >= 2)
        if self.order is None:
            self.order = np.lexsort((self.checks, self.hashes))
        self.learned = np.repeat(~self.held, self.lengths)

    def asked(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Hashes and checks of the different words in order, and how often the chunk's training texts hold each."""
        return [self.hashes[self.order], self.checks[self.order]], self.counted()

    def counted(self) -> np.ndarray:
        """How often the chunk's training texts hold each of the different words in order."""
        return np.bincount(self.tokens[self.learned], minlength=len(self.order))[self.order]

    def by_word(self, answers: np.ndarray) -> np.ndarray:
        """Answers in the order asked, by word."""
        out = np.empty_like(answers)
        out[self.order] = answers
        return out


class Grams:
    """A chunk's different pairs and triples as columns of its words' numbers in the corpus, a pair's third being 0, in order.

    own: by word, whether no other chunk holds it or no training text does; open: n-grams without such a word.
    """

    def __init__(self, chunk: Chunk, names: np.ndarray, own: np.ndarray | None = None):
        by = np.argsort(names)
        rank = np.empty(len(by), dtype=np.int64)
        rank[by] = np.arange(len(by))
        alone = np.zeros(len(by), dtype=bool) if own is None else own[by]
        own, n, r, self.chunk = names[by], len(by), rank[chunk.tokens], chunk
        # A triple is its first pair's place among the chunk's pairs, and its last word's: under 2**62 in any chunk.
        pairs, self.pair = np.unique(r[chunk.two - 1] * n + r[chunk.two], return_inverse=True)
        at = np.zeros(len(r), dtype=np.int64)
        at[chunk.two] = self.pair
        triples, self.triple = np.unique(at[chunk.three - 1] * n + r[chunk.three], return_inverse=True)
        a, b, c, p = pairs // n, pairs % n, triples % n, triples // n
        two = alone[a] | alone[b]
        self.open, self.cut = ~np.append(two, two[p] | alone[c]), len(pairs)
        a, b = own[a], own[b]
        self.columns = [np.append(a, a[p]), np.append(b, b[p]), np.append(np.zeros_like(a), own[c] + np.uint64(1))]

    def asked(self) -> np.ndarray:
        """How often the chunk's training texts hold each."""
        two, three = (x[self.chunk.learned[at]] for x, at in ((self.pair, self.chunk.two), (self.triple, self.chunk.three)))
        return np.append(np.bincount(two, minlength=self.cut), np.bincount(three, minlength=len(self.columns[0]) - self.cut))

    def shards(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """The open ones in an order by shard, and the shards in that order."""
        at = np.flatnonzero(self.open)
        a, b, c = (x[at] for x in self.columns)
        of = (mixed(mixed(a, b), c) >> np.uint64(32)) * np.uint64(number) >> np.uint64(32)
        order = np.argsort(of, kind="stable")
        return at[order], of[order]

    def by_place(self, answers: np.ndarray) -> np.ndarray:
        """Two rows: by place, the answer on the pair and on the triple that end there."""
        out = np.zeros((2, len(self.chunk.tokens)), dtype=np.int64)
        out[0, self.chunk.two], out[1, self.chunk.three] = answers[: self.cut][self.pair], answers[self.cut :][self.triple]
        return out


class Numbers:
    """Numbers texts' words as they come; a chunk's words are numbered by how often they occur."""

    def __init__(self):
        self.number: defaultdict = defaultdict()
        self.number.default_factory = self.number.__len__
        self.tokens, self.lengths, self.held, self.ids = array("I"), [], [], []

    def add(self, found: list[bytes], held: bool, doc_id: int | None = None) -> None:
        self.tokens.extend([self.number[w] for w in found])
        self.lengths.append(len(found))
        self.held.append(held)
        self.ids.append(doc_id)

    def chunk(self) -> Chunk:
        tokens = np.frombuffer(self.tokens, dtype=np.uint32)
        parts = np.dtype([("hash", ">u8"), ("check", ">u4"), ("rest", ">u4")])
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.number)), dtype=parts)
        often = np.argsort(-np.bincount(tokens, minlength=len(digests)), kind="stable")
        rank = np.empty(len(often), dtype=np.uint32)
        rank[often] = np.arange(len(often), dtype=np.uint32)
        hashes, checks = (digests[c][often].astype(np.uint64) for c in ("hash", "check"))
        return Chunk(hashes, checks, rank[tokens], np.array(self.lengths, dtype=np.int64), np.array(self.held, dtype=bool))


def left_over(context: np.ndarray, rate: float, power: float) -> np.ndarray:
    """Weight of a state's failure arc by how often training texts hold its context; an unseen one has weight 1."""
    return 1.0 / (1.0 + rate * context.astype(np.float64) ** power)


@dataclass
class Automaton:
    """The part of the automaton that a chunk's texts can meet, by place.

    order: the longest n-gram known that ends here, whose arc has log-probability `arc`; fail1 and fail2:
    the weights of the failure arcs of the states of one and of two words that stand before this place.
    An n-gram's probability is (1 - f) * c / context + f * that of the n-gram shorter by its first word,
    f being the state's failure weight; so the words' probabilities sum to one in every state.
    """

    order: np.ndarray
    arc: np.ndarray
    fail1: np.ndarray
    fail2: np.ndarray

    @staticmethod
    def build(chunk: Chunk, one: np.ndarray, two: np.ndarray, three: np.ndarray, total: int, kinds: int, rates=((0.4, 0.2), (0.4, 0.3))) -> Automaton:
        before, pair = np.zeros((2, len(one)), dtype=np.int64)
        before[chunk.two], pair[chunk.three] = one[chunk.two - 1], two[chunk.three - 1]
        f1, f2 = (left_over(c, *r) for c, r in zip((before, pair), rates))
        p = (one + 1.0) / (total + kinds + 1)
        p2 = (1 - f1) * two / np.maximum(before, 1) + f1 * p
        p3 = (1 - f2) * three / np.maximum(pair, 1) + f2 * p2
        order = np.where(three > 0, 3, np.where(two > 0, 2, np.where(one > 0, 1, 0)))
        arc = np.log10(np.where(order == 3, p3, np.where(order == 2, p2, p)))
        return Automaton(order, arc, np.log10(f1), np.log10(f2))

    def walk(self, start: int, end: int) -> float:
        """One traversal of a text from left to right, which carries the state: the sum of its arcs and failure weights."""
        state, total, at = 0, 0.0, slice(start, end)
        for n, arc, one, two in zip(self.order[at].tolist(), self.arc[at].tolist(), self.fail1[at].tolist(), self.fail2[at].tolist()):
            if state == 2 and n < 3:
                total += two
                state = 1
            if state == 1 and n < 2:
                total += one
            total += arc
            state = n if n < 2 else 2
        return total


def numbered(docs: DataFrame, tokens: int) -> DataFrame:
    """Chunks of docs (doc_id, held_out, text)."""
    schema = arrow_schema(TEXTS)

    def sent(number, some):
        c = some.chunk()
        (hashes, checks), places = c.asked()[0], c.order.astype("<u4")
        packed = {"hashes": squeezed(np.diff(hashes, prepend=np.uint64(0))), "checks": squeezed(checks), "places": squeezed(places), "numbers": squeezed(c.tokens)}
        row = {"chunk": number, **packed, "ids": some.ids, "held": some.held, "lengths": some.lengths, "tokens": len(c.tokens)}
        return pa.RecordBatch.from_pylist([row], schema=schema)

    def run(batches):
        number, some = TaskContext.get().partitionId() << 32, Numbers()
        for batch in batches:
            for doc_id, out, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))):
                found = words(text)
                if some.ids and len(some.tokens) + len(found) > tokens:
                    yield sent(number, some)
                    number, some = number + 1, Numbers()
                some.add(found, out, doc_id)
        if some.ids:
            yield sent(number, some)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, TEXTS)


def unpacked(row: dict) -> Chunk:
    """The chunk of a row of `numbered`, without the hashes."""
    lengths, held = np.array(row["lengths"], dtype=np.int64), np.array(row["held"], dtype=bool)
    return Chunk(None, None, spread(row["numbers"], "<u4"), lengths, held, spread(row["places"], "<u4").astype(np.int64))


def each_row(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def sent(chunk: int, first: int, of: np.ndarray, columns: list[np.ndarray], counts: np.ndarray, schema: pa.Schema):
    """A question for each shard, from keys and counts in the order of their shards `of`; the first shard has the number `first`."""
    begin = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)]).tolist()
    for s, e in zip(begin, [*begin[1:], len(of)]):
        keys = [squeezed(np.diff(columns[0][s:e], prepend=np.uint64(0))), *[squeezed(c[s:e]) for c in columns[1:]]]
        row = {"chunk": chunk, "shard": first + int(of[s]), "keys": keys, "counts": squeezed(counts[s:e])}
        yield pa.RecordBatch.from_pylist([row], schema=schema)


def word_questions(chunks: DataFrame, shards: int) -> DataFrame:
    """For each chunk and shard of words its different words with their counts."""
    schema = arrow_schema(ASKED)

    def run(batches):
        for row in each_row(batches):
            columns, n = [np.cumsum(spread(row["hashes"], "<u8"), dtype=np.uint64), spread(row["checks"], "<u8")], unpacked(row).counted()
            yield from sent(row["chunk"], 0, (columns[0] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), columns, n, schema)

    return chunks.mapInArrow(run, ASKED)


def gram_questions(chunks: DataFrame, shards: int) -> DataFrame:
    """For each chunk of `with_answers` and shard its open pairs and triples with their counts; their shards follow those of words."""
    schema = arrow_schema(ASKED)

    def run(batches):
        for row, chunk, names, own, _, _ in answered(batches, shards):
            grams = Grams(chunk, names, own)
            order, of = grams.shards(shards)
            yield from sent(row["chunk"], shards, of, [c[order] for c in grams.columns], grams.asked()[order], schema)

    return chunks.mapInArrow(run, ASKED)


def answers(asked: DataFrame, shards: int) -> DataFrame:
    """To each question the counts in all training texts, and to those about words their numbers and whether grams of them are the chunk's own; each word shard's tokens and different words."""
    schema = arrow_schema(ASKED)

    def column(rows: list[dict], k: int) -> np.ndarray:
        parts = [spread(r["keys"][k], "<u8") for r in rows]
        return np.concatenate([np.cumsum(x, dtype=np.uint64) for x in parts] if k == 0 else parts)

    def run(batches):
        for shard, rows in groupby(each_row(batches), lambda r: r["shard"]):
            rows = list(rows)
            columns = [column(rows, k) for k in range(len(rows[0]["keys"]))]
            order = np.lexsort(columns[::-1])
            first = np.zeros(len(order), dtype=bool)
            first[0] = True
            for c in columns:
                c = c[order]
                first[1:] |= c[1:] != c[:-1]
            del columns
            counts = [spread(r["counts"], "<i8") for r in rows]
            ends = np.cumsum([len(c) for c in counts])[:-1]
            begin = np.flatnonzero(first)
            sums = np.add.reduceat(np.concatenate(counts)[order], begin)
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.cumsum(first) - 1
            out = [{"chunk": r["chunk"], "shard": shard, "counts": squeezed(sums[own])} for r, own in zip(rows, np.split(place, ends))]
            if shard < shards:
                names = np.empty(len(sums), dtype=np.uint64)
                names[np.argsort(-sums, kind="stable")] = np.arange(len(sums), dtype=np.uint64) * np.uint64(shards) + np.uint64(shard)
                alone = ((np.diff(begin, append=len(order)) == 1) | (sums == 0)).astype(np.uint8)
                for r, own in zip(out, np.split(place, ends)):
                    r["keys"] = [squeezed(names[own]), squeezed(alone[own])]
                out.append({"total": int(sums.sum()), "kinds": int((sums > 0).sum())})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return asked.repartition(2 * shards, "shard").sortWithinPartitions("shard").mapInArrow(run, ASKED)


def with_answers(texts: DataFrame, found: DataFrame, chunks: int) -> DataFrame:
    """Each chunk with the answers to it after it, by shard."""
    own = found.where("chunk IS NOT NULL").select("chunk", "shard", "keys", "counts")
    both = texts.drop("hashes", "checks").withColumn("shard", F.lit(-1).cast("long")).unionByName(own, allowMissingColumns=True)
    return both.repartition(max(chunks, 1), "chunk").sortWithinPartitions("chunk", "shard")


def answered(batches, shards: int):
    """Of each chunk its row, itself, by word the number, whether its grams are the chunk's own and the count, and the counts of pairs and triples by shard."""
    for _, rows in groupby(each_row(batches), lambda r: r["chunk"]):
        head = next(rows)
        chunk, names, own, single, longer = unpacked(head), [], [], [], []
        for r in rows:
            (single if r["shard"] < shards else longer).append(spread(r["counts"], "<i8"))
            if r["shard"] < shards:
                names.append(spread(r["keys"][0], "<u8"))
                own.append(spread(r["keys"][1], "u1").astype(bool))
        yield head, chunk, *(chunk.by_word(np.concatenate(x)) for x in (names, own, single)), longer


def score(docs: DataFrame, fold: int = 7, held: int = 2, tokens: int = 1 << 20, shard: int = 1 << 21) -> DataFrame:
    """Counts, the unigram base and the automaton's log10 probability of every whole text.

    It learns from texts whose crc32(doc_id as text) mod fold isn't `held`, a null id's among
    them; a null text is an empty one, which has its end alone. Repeated rows are rows of their
    own. Without training texts N and V are 0 and each token has probability 1. A chunk has about
    `tokens` tokens, or one longer text; a shard some `shard` n-grams.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.coalesce(remainder("doc_id", fold) == held, F.lit(False)).alias("held_out"))
    texts = store(numbered(docs, tokens), "texts", lean=True)
    chunks, size = texts.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    shards = 1 + 2 * size // shard
    about_words = store(answers(word_questions(texts, shards), shards), "words", lean=True)
    about_grams = store(answers(gram_questions(with_answers(texts, about_words, chunks), shards), shards), "grams", lean=True)
    total, kinds = about_words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema = arrow_schema(ddl)

    def run(batches):
        for head, chunk, names, own, single, longer in answered(batches, shards):
            grams, one = Grams(chunk, names, own), single[chunk.tokens]
            (order, _), found = grams.shards(shards), grams.asked()
            found[order] = np.concatenate([np.zeros(0, np.int64), *longer])
            model = Automaton.build(chunk, one, *grams.by_place(found), total, kinds)
            ends = np.cumsum(chunk.lengths)
            starts = ends - chunk.lengths
            base = np.add.reduceat(np.log10((one + 1.0) / (total + kinds + 1)), starts)
            known = np.add.reduceat((one > 0).astype(np.int64), starts)
            scores = [model.walk(s, e) for s, e in zip(starts.tolist(), ends.tolist())]
            cols = [head["ids"], head["held"], chunk.lengths, known, np.full(len(starts), total), base, scores]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return with_answers(texts, about_words.unionByName(about_grams), chunks).mapInArrow(run, ddl)
