"""Near copies by exact Jaccard similarity of word shingles, with SimHash and prefix candidates.

Fingerprints of 64 bits can't reach a similarity of 0.8: such pairs differ in up to 17 bits, and blocks
for that many would be so short that all texts meet. So SimHash links propose the closest pairs and
prefixes propose all pairs: with the shingles of each set in one fixed order, two sets of Jaccard
similarity 0.8 share one of their first n - ceil(0.8 n) + 1. Every candidate is verified on the whole
sets. Any order is right; it is by hash, and shingles that many texts of a sample hold come last, so
that few texts meet in a common line.

A pair is looked for at the first shingle that both share. All that they share comes from there on, so
both sets have to have enough left at that place; texts that share boilerplate and not enough else meet
only where too little is left. For the smaller set this means a place in its first ninth: such texts are
light in the shingle's bucket, and a bucket without any has no pairs.

A shingle's texts are a bucket. Up to `few` of them are paired all; of more, each is paired with two
centres first, and after that light ones with all that are not yet in their group, so that one large
group of near copies isn't squared. Buckets of shingles that come last are dealt out by salt.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import arrow_schema, map_rows, store
from .simhash import SEED, links, majority, runs


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of shingles of so many words, in lower case for A-Z; a shorter text is one shingle."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, ends, at = b" ".join(found), [], -1
    for w in found:
        at += len(w) + 1
        ends.append(at)
    starts, k, hash_of = [0, *[e + 1 for e in ends]], max(min(words, len(found)) - 1, 0), xxhash.xxh64_intdigest
    values = [hash_of(joined[s:e], SEED) for s, e in zip(starts, ends[k:])] or [hash_of(b"", SEED)]
    return np.unique(np.array(values, dtype="<u8"))


def signature(values: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(values.tobytes(), SEED)).astype(np.int64))


def parity(values: np.ndarray, size: int = 0) -> list[int]:
    """So many bits, or two to four times as many as shingles and 256 at least; two sets differ in at least as many shingles as these in bits."""
    size = size or 1 << max(8, (2 * len(values) - 1).bit_length())
    odd = np.bincount((values & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def halves(bits: Column, size: Column) -> Column:
    """Bits folded once, if there are more than so many longs; the parity of half as many places."""
    both = F.zip_with(F.slice(bits, F.lit(1), size), F.slice(bits, size + 1, size), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(bits) > size, both).otherwise(bits)


def differing(a: Column, b: Column) -> Column:
    """In how many bits two parities differ whose lengths are equal or one is twice the other."""
    size = F.least(F.size(a), F.size(b))
    xor = F.zip_with(halves(a, size), halves(b, size), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long"))
    return F.aggregate(xor, F.lit(0).cast("long"), lambda n, x: n + x)


class Parities:
    """Many parities in one matrix for each length, to compare one with any of them."""

    def __init__(self, bits: list[np.ndarray]):
        sizes = np.array([len(b) for b in bits])
        self.bits = bits
        self.of = [(int(n), np.flatnonzero(sizes == n)) for n in np.unique(sizes)]
        self.rows = {n: np.stack([bits[i] for i in at]) for n, at in self.of}

    def differing(self, k: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the wanted places (booleans) those of the same or the next length, and in how many bits each differs from the k-th."""
        own, places, counts = self.bits[k], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, at in self.of:
            some = wanted[at]
            if not some.any() or n not in (len(own) // 2, len(own), 2 * len(own)):
                continue
            theirs, mine = self.rows[n][some], own
            if n > len(own):
                theirs = theirs[:, : len(own)] ^ theirs[:, len(own) :]
            elif n < len(own):
                mine = own[:n] ^ own[n:]
            places.append(at[some])
            counts.append(np.bitwise_count(theirs ^ mine).sum(axis=1, dtype=np.int64))
        return np.concatenate(places), np.concatenate(counts)


def common_shingles(docs: DataFrame, sample: int = 16_384, least: int = 8) -> np.ndarray:
    """Shingles of at least so many of about `sample` texts, chosen by hash. They only set an order."""
    one_in = max(1, -(-docs.count() // sample))
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(one_in)) == 0).select("text")
    flat = map_rows(some, lambda: lambda texts: ([shingles(t).view(np.int64).tolist() for t in texts],), "s array<long>")
    found = flat.select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return np.sort(found.select("h").toArrow().column("h").to_numpy().view(np.uint64))


def keyed(docs: DataFrame, one: str = "k1", two: str = "k2") -> DataFrame:
    """Rows with 128 bits of doc_id and text: what tells rows apart, for ids may be null or repeated."""
    return docs.withColumn(one, F.xxhash64("doc_id", "text")).withColumn(two, F.xxhash64("text", F.lit(1), "doc_id"))


def free(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def described(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(doc_id, k1, k2, sig, n, coarse, bits, fp, keys, own): every text's set by signature, size, short and long parity, SimHash and prefix.

    own: how many of the prefix aren't among the common shingles, which come after those.
    """
    box = docs.sparkSession.sparkContext.broadcast(common)

    def make():
        late = box.value

        def work(ids, one, two, texts):
            out = []
            for key, k1, k2, text in zip(ids, one, two, texts):
                s = shingles(text)
                last = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s if len(late) else np.zeros(len(s), bool)
                first = np.concatenate([s[~last], s[last]])[: len(s) + (-4 * len(s) // 5) + 1]
                fp = int(np.uint64(majority(s)).astype(np.int64))
                own = min(len(first), len(s) - int(last.sum()))
                out.append((key, k1, k2, signature(s), len(s), parity(s, 256), parity(s), fp, first.view(np.int64).tolist(), own))
            return zip(*out)

        return work

    ddl = "doc_id long, k1 long, k2 long, sig long, n int, coarse array<long>, bits array<long>, fp long, keys array<long>, own int"
    return map_rows(keyed(docs.select("doc_id", "text")).select("doc_id", "k1", "k2", "text"), make, ddl)


def fits(n: np.ndarray, m: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether sets of n and m whose first common shingle is the p-th and q-th, from 0, can reach the similarity."""
    return (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * np.minimum(n - p, m - q) >= 4 * (n + m))


def meetings(sets: DataFrame, few: int, salts: int = 64) -> DataFrame:
    """(large, a, b, at, n): candidate pairs of signatures, and (bucket, signature, its place and size) of buckets that aren't paired here.

    Those are of more than `few`, with a light one, and those of common shingles, which are dealt out by salt.
    """
    every = sets.select("sig", "n", "own", F.posexplode("keys").alias("at", "h"))
    rare = every.where("at < own").withColumn("salt", F.lit(-1))
    late = every.where("at >= own").withColumn("salt", F.pmod(F.xxhash64("sig"), F.lit(salts)).cast("int"))
    # Sizes by classes of a quarter: a common shingle's rows stay if a light one is about as large as their partners can be.
    kind = lambda c: F.floor(F.log(c) / math.log(1.25)).cast("int")
    lit = late.where("9 * at <= n").groupBy("h").agg(F.collect_set(kind(F.col("n"))).alias("kinds"))
    low, high = kind(F.ceil(F.col("n") * 4 / 5)), kind(F.least(F.col("n"), F.expr("(9 * (n - at) - 4 * n) div 4")))
    late = late.join(lit, "h").where(F.exists("kinds", lambda k: k.between(low, high))).drop("kinds")
    met = rare.unionByName(late).select("h", "salt", "sig", "n", "at")
    ddl = "large boolean, a long, b long, at int, n int"
    schema = arrow_schema(ddl)

    def run(batches):
        for c in runs(batches, ["h", "salt"]):
            h, salt, sig, n, at = c["h"], c["salt"], c["sig"], c["n"].astype(np.int64), c["at"].astype(np.int64)
            begin = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])))
            length = np.diff(np.append(begin, len(h)))
            light = 9 * at <= n
            some = np.add.reduceat(light, begin) > 0
            large = (salt[begin] >= 0) | (length > few) & some
            size = np.repeat(np.where(large | ~some, 0, length), length)  # of buckets paired here
            left, right = [], []
            for d in range(1, min(few, int(length.max()))):
                i = np.flatnonzero((h[d:] == h[:-d]) & (salt[d:] == salt[:-d]) & (size[d:] > 0))
                i = i[fits(n[i], n[i + d], at[i], at[i + d])]
                left.append(sig[i])
                right.append(sig[i + d])
            for b, k in zip(begin[large & some].tolist(), length[large & some].tolist()):
                own = slice(b, b + k)
                mixed = (sig[own] ^ h[own]).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                for centre in np.lexsort((mixed, ~light[own]))[:2] + b:
                    i = np.arange(b, b + k)
                    i = i[(i != centre) & fits(n[own], n[centre], at[own], at[centre])]
                    left.append(np.full(len(i), sig[centre]))
                    right.append(sig[i])
            none = np.zeros(0, np.int64)
            a, b = np.concatenate([none, *left]), np.concatenate([none, *right])
            if len(a):
                a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            many = np.repeat(large, length)
            for s, k in zip(begin[large & (salt[begin] < 0)].tolist(), length[large & (salt[begin] < 0)].tolist()):
                own = slice(s, s + k)
                sizes, low, high = np.sort(n[own][light[own]]), -(-4 * n[own] // 5), np.minimum(n[own], (9 * (n[own] - at[own]) - 4 * n[own]) // 4)
                many[own] = np.searchsorted(sizes, high, "right") > np.searchsorted(sizes, low)
            flag = np.append(np.zeros(len(a), bool), np.ones(int(many.sum()), bool))
            if len(flag):
                small = [pa.array(np.append(np.zeros_like(a), x[many]), pa.int32()) for x in (at, n)]
                cols = [pa.array(flag), pa.array(np.append(a, h[many])), pa.array(np.append(b, sig[many])), *small]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return met.repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(run, ddl)


def divided(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members (h, sig, at, n) of buckets with a light one and more than one group, with their group as top, and their bucket's sizes."""
    tops = groups.select(F.col("node").alias("sig"), "component")
    found = members.join(tops, "sig", "left").select("h", "sig", "at", "n", F.coalesce("component", "sig").alias("top"))
    found = store(found, "members")
    counts = found.groupBy("h").agg(F.count("*").alias("rows"), F.count_if(F.expr("9 * at <= n")).alias("lights"), F.min("top").alias("x"), F.max("top").alias("y")).where("x < y AND lights > 0")
    return store(found.join(counts.select("h", "rows", "lights"), "h"), "divided")


def across(rows: DataFrame, sets: DataFrame, every: bool, side: int = 2048) -> DataFrame:
    """(h, a, b, rest): pairs in buckets of `divided` that are in different groups and can be similar, by the parities of sets.

    Light ones and all ones are cut in sides, each pair of which is compared in a task of its own. Without `every` a task
    gives only as many of the pairs as unite its groups, those of the nearest parities; rest tells that there are more.
    A text meets its parity once, however many buckets it is in.
    """
    cut = lambda c: F.ceil(F.col(c) / side).cast("int")
    part = lambda c, seed: F.pmod(F.xxhash64("sig", F.lit(seed)), cut(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), cut(c) - 1))
    cols = ["h", "i", "j", "light", "sig", "at", "n", "top", "bits"]
    texts = rows.groupBy("sig").agg(F.collect_list(F.struct("h", "at", "n", "top", "rows", "lights")).alias("places"))
    rows = texts.join(sets.select("sig", "bits"), "sig").select("sig", "bits", F.inline("places"))
    sided = (
        rows.withColumns({"i": each("lights"), "light": F.lit(False)}).withColumn("j", part("rows", 0)).select(cols)
        .unionByName(rows.where("9 * at <= n").withColumns({"j": each("rows"), "light": F.lit(True)}).withColumn("i", part("lights", 1)).select(cols))
    )
    ddl = "h long, a long, b long, rest boolean"
    keys, schema = ["h", "i", "j"], arrow_schema(ddl)

    def run(batches):
        for c in runs(batches, keys):
            change = np.append(True, np.any([c[k][1:] != c[k][:-1] for k in keys], axis=0))
            begin = np.flatnonzero(change)
            for s, e in zip(begin.tolist(), np.append(begin[1:], len(change)).tolist()):
                light, sig, n, at, top = c["light"][s:e].astype(bool), c["sig"][s:e], c["n"][s:e].astype(np.int64), c["at"][s:e].astype(np.int64), c["top"][s:e]
                if light.all() or not light.any():
                    continue
                bits = Parities([x.view(np.uint64) for x in c["bits"][s:e]])
                other, own_light, out, rest = ~light, 9 * at <= n, [], False
                for k in np.flatnonzero(light).tolist():
                    # Of two light ones the pair is taken once.
                    ok = other & (top != top[k]) & (~own_light | (sig > sig[k])) & fits(n, n[k], at, at[k])
                    near, differ = bits.differing(k, ok)
                    ok = 9 * differ <= n[near] + n[k]
                    near, differ = near[ok], differ[ok]
                    if not every and len(near) > 1:  # the nearest of each group
                        order = np.lexsort((differ, top[near]))
                        order = order[np.append(True, top[near][order][1:] != top[near][order][:-1])]
                        rest |= len(order) < len(near)
                        near, differ = near[order], differ[order]
                    if len(near):
                        out.append(np.stack([np.full(len(near), k), near, differ]))
                if not out:
                    continue
                i, j, differ = np.concatenate(out, axis=1)
                if not every:
                    order = np.argsort(differ, kind="stable")
                    numbers = np.unique(top, return_inverse=True)[1]
                    ends = list(zip(numbers[i[order]].tolist(), numbers[j[order]].tolist()))
                    pick = order[uniting(ends, int(numbers.max()) + 1)]
                    rest |= len(pick) < len(i)
                    i, j = i[pick], j[pick]
                cols = [np.full(len(i), c["h"][s]), np.minimum(sig[i], sig[j]), np.maximum(sig[i], sig[j]), np.full(len(i), rest)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], schema=schema)

    return sided.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ddl)


def uniting(ends: list[tuple[int, int]], n: int) -> list[int]:
    """Which of the pairs, in turn, join two groups that none before them joined."""
    top, out = list(range(n)), []

    def root(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for k, (a, b) in enumerate(ends):
        x, y = root(a), root(b)
        if x != y:
            top[max(x, y)] = min(x, y)
            out.append(k)
    return out


def sets_of(docs: DataFrame, ends: DataFrame, size: int = 1 << 25) -> DataFrame:
    """(sig, s): whole sets of at least the texts in ends, chosen by a bitmap of their keys so that no text is shuffled."""
    place = F.pmod(F.col("k1"), F.lit(size))
    word = ends.select(place.alias("p")).groupBy(F.expr("shiftright(p, 6)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("v"))
    word, bits = word.toArrow(), np.zeros(size // 64, dtype=np.int64)
    bits[word.column("w").to_numpy()] = word.column("v").to_numpy()
    box = docs.sparkSession.sparkContext.broadcast(bits)

    def make():
        wanted = box.value

        def work(places, texts):
            found = [shingles(t) for p, t in zip(places, texts) if int(wanted[p >> 6]) >> (p & 63) & 1]
            return [[signature(s) for s in found], [s.view(np.int64).tolist() for s in found]]

        return work

    return map_rows(keyed(docs.select("doc_id", "text")).select(place.alias("p"), "text"), make, "sig long, s array<long>")


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs of signatures whose whole sets have a Jaccard similarity of 0.8 or more."""
    def side(cols: list[str], x: str) -> DataFrame:
        return sets.select(F.col("sig").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols])

    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    limit = F.col("n_a") + F.col("n_b")
    likely = pairs.join(side(["n", "coarse"], "a"), "a").join(side(["n", "coarse"], "b"), "b").where(
        (5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b")) & (9 * differing(F.col("coarse_a"), F.col("coarse_b")) <= limit)
    )
    left = likely.select("a", "b", "n_a", "n_b").join(side(["bits", "k1"], "a"), "a").join(side(["bits", "k1"], "b"), "b")
    left = left.where(9 * differing(F.col("bits_a"), F.col("bits_b")) <= limit)
    left = store(left.select("a", "b", "n_a", "n_b", "k1_a", "k1_b"), "candidates")
    ends = left.select(F.explode(F.array(*[F.struct(F.col(x).alias("sig"), F.col(f"k1_{x}").alias("k1")) for x in "ab"])).alias("e"))
    ends = ends.select("e.*").distinct()
    whole = store(sets_of(docs, ends).join(ends.select("sig"), "sig", "left_semi").dropDuplicates(["sig"]), "sets")
    one, two = (whole.select(F.col("sig").alias(x), F.col("s").alias(f"s_{x}")) for x in "ab")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return left.join(one, "a").join(two, "b").where(9 * shared >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def united(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Groups (node, component) that further links of nodes join: only groups that are joined take part in the rounds."""
    top = lambda x: groups.select(F.col("node").alias(x), F.col("component").alias(f"top_{x}"))
    ends = links.join(top("a"), "a", "left").join(top("b"), "b", "left")
    joined = store(connected_components(ends.select(*[F.coalesce(f"top_{x}", x).alias(x) for x in "ab"])), "joined")
    moved = groups.join(joined.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left")
    alone = joined.join(groups.select("node"), "node", "left_anti")
    return store(moved.select("node", F.coalesce("now", "component").alias("component")).unionByName(alone), "groups")


def kept(docs: DataFrame, few: int = 8, rounds: int = 1) -> DataFrame:
    """One row of docs for each group connected by pairs of similarity 0.8 or more in shingles of five words.

    It is the row of the smallest doc_id, nulls last; among rows of one id the text decides, by hash, and
    among rows of one id and text the other columns in turn, the smallest first. Null and empty texts are
    one set. Groups in large buckets are united in at most `rounds` rounds of few pairs each; then all
    pairs left between groups are verified, so the rounds change the work but not the result. Buckets
    that have given all their pairs aren't looked at again.
    """
    prints = store(described(docs, common_shingles(docs)), "described")
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2").alias("who")
    ids = prints.groupBy("sig").agg(*[F.first(c).alias(c) for c in ("n", "coarse", "bits", "fp")], F.min(who).alias("who"))
    sets = store(ids.select("*", F.col("who.k1").alias("k1")), "distinct")
    near = links(sets.groupBy("fp").agg(F.min("sig").alias("node")))
    met = store(meetings(prints.select("sig", "n", "keys", "own").dropDuplicates(["sig"]), few), "meetings")
    found = store(verified(near.unionByName(met.where("NOT large").select("a", "b")), sets, docs), "verified")
    groups = store(connected_components(found), "groups")
    members = met.where("large").select(F.col("a").alias("h"), F.col("b").alias("sig"), "at", "n")
    every = rounds == 0
    while not (rows := divided(members, groups)).isEmpty():
        pairs = store(across(rows, sets, every), "across")
        more = store(verified(pairs.select("a", "b"), sets, docs), "verified")
        if not more.isEmpty():
            groups = united(groups, more)
        if every:
            break
        rounds -= 1
        left = pairs.where("rest").select("h").distinct()
        members, every = rows.drop("top", "rows", "lights").join(left, "h", "left_semi"), rounds == 0 or more.isEmpty()
    tops = sets.join(groups.withColumnRenamed("node", "sig"), "sig", "left").select("who", F.coalesce("component", "sig").alias("top"))
    one, two = free(docs, "k1"), free(docs, "k2")
    keep = tops.groupBy("top").agg(F.min("who").alias("who")).select(F.col("who.k1").alias(one), F.col("who.k2").alias(two))
    again = prints.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select(F.col("k1").alias(one), F.col("k2").alias(two))
    again = store(again.join(keep, [one, two], "left_semi"), "again")
    order = [f.name for f in docs.schema if f.name not in ("doc_id", "text") and f.dataType.typeName() not in ("map", "variant")]
    rows = keyed(docs, one, two)
    repeated = rows.join(again, [one, two], "left_semi")
    first = repeated.groupBy(one, two).agg(F.min_by(F.struct(*docs.columns), F.struct(*order) if order else F.lit(0)).alias("row")).select("row.*")
    return rows.join(again, [one, two], "left_anti").join(keep, [one, two], "left_semi").select(docs.columns).unionByName(first)
