"""Document fingerprints by consistent weighted sampling.

A document is a set of words weighted by how often they occur. For each term and sample a rate
and a height of gamma shape 2 and a uniform shift follow from the term's hash alone; the sample is
the term, and step, of the least height over the weight. Two documents take the same sample with
the probability of their generalised Jaccard similarity.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .shared import arrow_schema

#: Words: ASCII letters in lower case, digits and all bytes above.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    """Signatures of `samples` parts; what was drawn for `memory` terms is kept at most, and all three draws for `often` repeated ones."""

    def __init__(self, samples: int, memory: int = 60_000, often: int = 12_000):
        self.samples, self.memory, self.often = samples, memory, often
        self.salt = np.arange(1, 5 * samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self._clear()

    def _clear(self):
        self.place: dict[bytes, int] = {}
        self.hash = np.zeros(self.memory, dtype=np.uint64)
        self.height = np.zeros((self.memory, self.samples), dtype=np.float32)
        self.slot = np.full(self.memory, -1, dtype=np.int32)
        self.draws = np.zeros((self.often, 3, self.samples), dtype=np.float32)
        self.used = 0

    def drawn(self, hashes: np.ndarray):
        """Rate, log height and shift, terms by samples: five uniform numbers of 23 bits from three hashes."""
        bits = _mixed(hashes[:, None] ^ self.salt[None, : 3 * self.samples]).view("<u4").reshape(len(hashes), 3, self.samples, 2)
        u = (bits >> np.uint32(9)).astype(np.float32)
        u += np.float32(0.5)
        u *= np.float32(2.0**-23)
        both = np.log(u[:, :2, :, 0] * u[:, :2, :, 1])
        return -both[:, 0], np.log(-both[:, 1]), u[:, 2, :, 0]

    def kept(self, at: np.ndarray):
        """The draws of terms by their places, drawn once while they are remembered."""
        if len(at) > self.often:
            return self.drawn(self.hash[at])
        new = at[self.slot[at] < 0]
        if self.used + len(new) > self.often:
            self.slot[:], self.used, new = -1, 0, at
        if len(new):
            self.slot[new] = np.arange(self.used, self.used + len(new))
            self.draws[self.used : self.used + len(new)] = np.stack(self.drawn(self.hash[new]), axis=1)
            self.used += len(new)
        got = self.draws[self.slot[at]]
        return got[:, 0], got[:, 1], got[:, 2]

    def add(self, terms: list[bytes]) -> None:
        """Keep what the terms draw at weight 1: there the step is 0, and one number a sample is enough."""
        start = len(self.place)
        h = _hashes(terms)
        for i, t in enumerate(terms):
            self.place[t] = start + i
        self.hash[start : start + len(terms)] = h
        for s in range(0, len(terms), 2048):
            rate, height, shift = self.drawn(h[s : s + 2048])
            self.height[start + s : start + s + len(rate)] = height + rate * (shift - np.float32(1))

    def signature(self, words: list[bytes]) -> np.ndarray:
        """16 bits a sample, as samples unsigned integers; without words all zero. Of equal heights the smaller hash wins."""
        if not words:
            return np.zeros(self.samples, dtype=np.uint16)
        new = set(words).difference(self.place)
        if len(self.place) + len(new) > self.memory:
            self._clear()
            new = set(words)
        if len(new) > self.memory:
            return self._large(words)
        if new:
            self.add(sorted(new))
        at = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))
        at, times = np.unique(at, return_counts=True)
        order = np.argsort(self.hash[at])
        at, times = at[order], times[order]
        heights = self.height[at]
        steps = None
        many = np.flatnonzero(times > 1)
        if len(many):
            rate, height, shift = self.kept(at[many])
            step = np.floor(np.log(times[many]).astype(np.float32)[:, None] / rate + shift)
            heights[many] = height + rate * (shift - step - 1)
            steps = np.zeros(heights.shape, dtype=np.int32)
            steps[many] = step
        best = heights.argmin(axis=0)
        step = steps[best, np.arange(self.samples)] if steps is not None else np.zeros(self.samples, dtype=np.int32)
        return self._named(self.hash[at[best]], step)

    def _large(self, words: list[bytes]) -> np.ndarray:
        """The same for a text of more terms than are kept, in bounded pieces."""
        terms = Counter(words)
        h = _hashes(list(terms))
        times = np.fromiter(terms.values(), dtype=np.int64, count=len(terms))
        order = np.argsort(h)
        h, times = h[order], times[order]
        least = np.full(self.samples, np.inf, dtype=np.float32)
        name, steps = np.zeros(self.samples, dtype=np.uint64), np.zeros(self.samples, dtype=np.int32)
        for s in range(0, len(h), 2048):
            rate, height, shift = self.drawn(h[s : s + 2048])
            step = np.floor(np.log(times[s : s + 2048]).astype(np.float32)[:, None] / rate + shift)
            value = (height + rate * (shift - step - 1)).astype(np.float32)
            best = value.argmin(axis=0)
            k = np.arange(self.samples)
            less = value[best, k] < least
            least = np.where(less, value[best, k], least)
            name = np.where(less, h[s : s + 2048][best], name)
            steps = np.where(less, step[best, k].astype(np.int32), steps)
        return self._named(name, steps)

    def _named(self, hashes: np.ndarray, steps: np.ndarray) -> np.ndarray:
        mixed = _mixed(hashes ^ (steps.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ self.salt[: self.samples])
        return (mixed >> np.uint64(48)).astype(np.uint16)


def _hashes(terms: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, terms), dtype=np.uint64, count=len(terms))


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


_SAMPLERS: dict[int, Sampler] = {}


def _sampler(samples: int) -> Sampler:
    if samples not in _SAMPLERS:
        _SAMPLERS[samples] = Sampler(samples)
    return _SAMPLERS[samples]


def fingerprints(docs: DataFrame, samples: int = 64) -> DataFrame:
    """(doc_id, fingerprint): 4 hex digits a sample for every whole text; null and empty texts have zeros."""
    from .shared import map_rows

    def make():
        s = _sampler(samples)
        return lambda keys, texts: (keys, [s.signature(split_words(t or "")).astype(">u2").tobytes().hex() for t in texts])

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, per_range: int = 2000) -> DataFrame:
    """Rows (range, doc_id, text, halo): texts dealt by ranges of doc_id, and each range's next document at its end.

    Ranges hold about per_range ids, at any size. The first row of a range goes to the range before as
    its halo too; that of the first range goes to the last. So neighbours meet without a global sort in
    one task. What goes to every task is one id for each range. Rows without a doc_id have no place
    in the order, and no halo; they are dealt over as many ranges of their own.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id").where("doc_id IS NOT NULL")
    n = docs.select("doc_id").count()
    cuts = max(1, -(-n // per_range))
    firsts = ids.repartitionByRange(cuts, "doc_id").groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("first"))
    box = spark.sparkContext.broadcast(np.sort(firsts.select("first").toArrow().column("first").to_numpy()))

    @F.pandas_udf("struct<range:int,before:int>")
    def place(keys: pd.Series) -> pd.DataFrame:
        firsts = box.value
        at = np.searchsorted(firsts, keys.to_numpy(), "right") - 1
        opens = firsts[at] == keys.to_numpy()
        before = pd.Series(np.where(opens, (at - 1) % len(firsts), -1))
        return pd.DataFrame({"range": at.astype(np.int32), "before": before.astype(np.int32)})

    placed = docs.where("doc_id IS NOT NULL").select("doc_id", "text", place("doc_id").alias("p"))
    own = F.struct(F.col("p.range").alias("range"), F.lit(False).alias("halo"))
    also = F.struct(F.col("p.before").alias("range"), F.lit(True).alias("halo"))
    rows = placed.select(F.explode(F.when(F.col("p.before") < 0, F.array(own)).otherwise(F.array(own, also))).alias("to"), "doc_id", "text")
    lone = -1 - F.pmod(F.monotonically_increasing_id(), F.lit(cuts))
    rows = rows.select("to.range", "doc_id", "text", "to.halo").unionByName(
        docs.where("doc_id IS NULL").select(lone.cast("int").alias("range"), "doc_id", "text", F.lit(False).alias("halo"))
    )
    return rows.repartition(2 * cuts, "range").sortWithinPartitions("range", "halo", "doc_id", "text")


def edits(docs: DataFrame, samples: int = 64) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and the likeness to that and to the next document.

    The edited text ends, for the last half of the code points, in the first as many of the next
    document, in ascending (doc_id, text); after the last comes the first. A null text is an empty
    one; a row without a doc_id is compared with itself.
    """
    ddl = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    schema = arrow_schema(ddl)

    def run(batches):
        s = _sampler(samples)
        sign = lambda t: s.signature(split_words(t))
        held = None  # the row whose next one is awaited: range, id, text, signature

        def made(held, text, its):
            _, key, own, mine = held
            n = len(own)
            edited = own[: n - n // 2] + text[: n // 2]
            other = sign(edited)
            return (
                key, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mine.astype(">u2").tobytes().hex(),
                other.astype(">u2").tobytes().hex(), float((mine == other).mean()), float((mine == its).mean()),
            )

        for batch in batches:
            out = []
            for place, key, text, halo in zip(*[batch.column(c).to_pylist() for c in ("range", "doc_id", "text", "halo")]):
                text = text or ""
                if halo and (held is None or held[0] != place):
                    continue  # a further copy of the halo's row
                its = sign(text)
                if key is None:
                    out.append(made((place, key, text, its), text, its))
                    continue
                if held is not None:
                    out.append(made(held, text, its))
                held = None if halo else (place, key, text, its)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return with_next(docs.select("doc_id", "text")).mapInArrow(run, ddl)
