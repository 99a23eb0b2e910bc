"""Importance resampling towards a target's distribution of hashed word n-grams.

A task's different words, each between two delimiters, are the dictionary of an Aho-Corasick automaton
whose payloads are a word's CRC, that of a space and the word, and its length. A scan of the delimited
text emits the payloads in turn. The CRC of adjacent words follows from theirs: that of the left part is
moved on by as many zero bytes as the right part has, and both are added. So the bucket of every run of
words comes from payloads, and no run is ever built as text.

All rows' buckets are counted, the counts of both tables give each bucket's gain, and a second scan sums
them. The draw needs places in one order over all documents; see `operators/running.py`.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.running import running
from .shared import arrow_schema, small_batches, store

BUCKETS = 10_000
#: A-Z in lower case; ASCII letters, digits and all bytes above make words, all others delimit them.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def folded(text: str | None) -> bytes:
    """The text's bytes in lower case, with delimiters as spaces and one at each end."""
    return b" " + (text or "").encode("utf-8", "surrogatepass").translate(_FOLD) + b" "


def _apply(columns: list[int], value: int) -> int:
    """A linear map of 32 bits, by the images of single bits."""
    out = 0
    for k in range(32):
        if value >> k & 1:
            out ^= columns[k]
    return out


@lru_cache(maxsize=4096)
def _zeros(n: int) -> tuple[int, ...]:
    """What n zero bytes after a text do to its CRC, for each bit of it: n is halved until it is one."""
    if n == 0:
        return tuple(1 << k for k in range(32))
    if n == 1:
        one = []
        for k in range(32):
            v = 1 << k
            for _ in range(8):
                v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
            one.append(v)
        return tuple(one)
    half = list(_zeros(n // 2))
    twice = tuple(_apply(half, half[k]) for k in range(32))
    return tuple(_apply(list(_zeros(1)), v) for v in twice) if n & 1 else twice


@lru_cache(maxsize=1024)
def shift_table(n: int) -> np.ndarray:
    """The same map by bytes of the CRC: four rows of 256."""
    columns = _zeros(n)
    table = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for k in range(8):
            step = 1 << k
            table[byte, step : 2 * step] = table[byte, :step] ^ np.uint32(columns[8 * byte + k])
    return table


def composed(left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs of texts, each put together of one with CRC left and one with CRC right and so many bytes."""
    if not len(lengths):
        return left
    if (top := int(lengths.max())) < 1 << 16:
        known = np.flatnonzero(np.bincount(lengths))
        place = np.zeros(top + 1, np.int64)
        place[known] = np.arange(len(known))
        which = place[lengths]
    else:
        known, which = np.unique(lengths, return_inverse=True)
    tables = np.stack([shift_table(int(n)) for n in known])
    out = right.copy()
    for byte in range(4):
        out ^= tables[which, byte, left >> np.uint32(8 * byte) & np.uint32(255)]
    return out


class Dictionary:
    """Different words with their payloads, and the automaton that finds them; forgotten beyond a bound."""

    def __init__(self, memory: int = 200_000):
        self.memory = memory
        self.clear()

    def clear(self):
        self.automaton = ahocorasick.Automaton()
        self.words: set[bytes] = set()
        self.crc = self.spaced = np.zeros(0, np.uint32)
        self.size = np.zeros(0, np.int64)

    def learn(self, words: set[bytes]) -> None:
        new = list(words.difference(self.words))
        if len(self.words) + len(new) > self.memory:
            self.clear()
            new = list(words)
        if not new:
            return
        for k, w in enumerate(new, len(self.crc)):
            self.automaton.add_word((b" " + w + b" ").decode("latin-1"), k)
        self.automaton.make_automaton()
        self.words.update(new)
        self.crc = np.append(self.crc, np.array([zlib.crc32(w) for w in new], np.uint32))
        self.spaced = np.append(self.spaced, np.array([zlib.crc32(b" " + w) for w in new], np.uint32))
        self.size = np.append(self.size, np.array([len(w) for w in new], np.int64))

    def scan(self, text: bytes) -> np.ndarray:
        """Numbers of the words of a folded text, in order; all of them have been learned."""
        if not self.words:
            return np.zeros(0, np.int64)
        return np.fromiter((k for _, k in self.automaton.iter(text.decode("latin-1"))), np.int64)

    def buckets(self, numbers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, bucket) of all runs of one to three words; at: the text of each word."""
        crc, spaced, size = self.crc[numbers], self.spaced[numbers], self.size[numbers] + 1
        two = composed(crc[:-1], spaced[1:], size[1:])
        three = composed(two[:-1], spaced[2:], size[2:])
        same_two, same_three = at[1:] == at[:-1], at[2:] == at[:-2]
        text = np.concatenate([at, at[1:][same_two], at[2:][same_three]])
        return text, np.concatenate([crc, two[same_two], three[same_three]]) % np.uint32(BUCKETS)


def _pieces(texts: list[str | None], most: int = 4_000_000):
    """(text's number, folded piece): whole texts, and longer ones cut at spaces."""
    for k, t in enumerate(texts):
        raw, at = folded(t), 0
        while len(raw) - at > most:
            cut = raw.find(b" ", at + most)
            if cut in (-1, len(raw) - 1):
                break
            yield k, raw[at : cut + 1]
            at = cut
        yield k, raw[at:]


def _grouped(texts: list[str | None], most: int = 4_000_000):
    some, size = [], 0
    for k, raw in _pieces(texts, most):
        some.append((k, raw))
        size += len(raw)
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def runs(dictionary: Dictionary, texts: list[str | None]):
    """(text, bucket) arrays of the runs of all texts, some million bytes at a time; runs across pieces of one text included."""
    before = (np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64), -1)
    for some in _grouped(texts):
        dictionary.learn(set(b"".join([raw for _, raw in some]).split()))
        found = [dictionary.scan(raw) for _, raw in some]
        at = np.repeat([k for k, _ in some], [len(f) for f in found]).astype(np.int64)
        numbers = np.concatenate(found)
        crc, spaced, size, k = before
        if len(crc) and k == some[0][0] and len(numbers):
            yield _across(before, dictionary, numbers[at == k][:2], k)
        text, bucket = dictionary.buckets(numbers, at)
        yield text, bucket
        last = numbers[at == some[-1][0]]
        if k == some[-1][0]:  # a text of many pieces may have few words in the last one
            crc, spaced, size = (np.append(x, y[last])[-2:] for x, y in ((crc, dictionary.crc), (spaced, dictionary.spaced), (size, dictionary.size)))
        else:
            crc, spaced, size = (y[last][-2:] for y in (dictionary.crc, dictionary.spaced, dictionary.size))
        before = (crc, spaced, size, some[-1][0])


def _across(before: tuple, dictionary: Dictionary, numbers: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of up to three words that begin in the piece before, of which the last two words are known."""
    crc = np.append(before[0], dictionary.crc[numbers])
    spaced = np.append(before[1], dictionary.spaced[numbers])
    size = np.append(before[2], dictionary.size[numbers]) + 1
    two = composed(crc[:-1], spaced[1:], size[1:])
    three = composed(two[:-1], spaced[2:], size[2:])
    n = len(before[0])
    new = np.concatenate([two[n - 1 : n], three[max(0, n - 2) : n]]) % np.uint32(BUCKETS)
    return np.full(len(new), k), new


def bucket_counts(rows: DataFrame) -> DataFrame:
    """(bucket, n) of the runs of words of all rows' text; a task gives a row for each bucket at most."""
    small_batches(rows.sparkSession)

    def run(batches):
        dictionary, counts = Dictionary(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, bucket in runs(dictionary, batch.column(0).to_pylist()):
                counts += np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])

    return rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame) -> np.ndarray:
    """Each bucket's floor(1000 ln((t+1)(S+B)/((s+1)(T+B)))): a row for each of B buckets is read, whatever the input."""
    counts = []
    for rows in (raw, target):
        n = np.zeros(BUCKETS)
        got = bucket_counts(rows).toArrow()
        n[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
        counts.append(n)
    s, t = counts
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row; a text that is null or has no words weighs 0."""
    small_batches(docs.sparkSession)
    box = docs.sparkSession.sparkContext.broadcast(gain)
    ddl = "doc_id long, n_words long, n_features long, weight long"
    schema = arrow_schema(ddl)

    def run(batches):
        dictionary, own = Dictionary(), box.value
        for batch in batches:
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for text, bucket in runs(dictionary, batch.column(1).to_pylist()):
                n += np.bincount(text, minlength=len(n))
                weight += np.bincount(text, own[bucket], len(n)).astype(np.int64)  # whole numbers far below 2**53
            # n features are w, 2 w - 1 or 3 w - 3 of w words.
            words = np.where(n >= 3, (n + 3) // 3, (n > 0).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(words), pa.array(n), pa.array(weight)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; rank is null unless the row is drawn.

    Of N rows with at least `least` words floor(percent N / 100) are drawn, without replacement: those of the highest
    weight plus Gumbel noise that follows from seed and doc_id. Ties go to the smaller doc_id, nulls last, then to fewer
    features; a null doc_id's noise is that of an empty one. Rows equal in all of these are alike in the result.
    """
    rows = weighed(docs, gains(docs, target))
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(head, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    noise = F.floor(-1000 * F.log(-F.log(u)))
    rows = store(rows.withColumn("score", F.col("weight") + noise).withColumn("fit", (F.col("n_words") >= least).cast("long")), "weighed")
    most = F.lit(rows.agg(F.floor(F.lit(percent) * F.coalesce(F.sum("fit"), F.lit(0)) / 100)).first()[0])
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranked = running(rows, order, {"place": (F.sum, "fit")})
    rank = F.when((F.col("fit") == 1) & (F.col("place") <= most), F.col("place"))
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
