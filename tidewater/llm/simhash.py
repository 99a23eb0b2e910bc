"""SimHash fingerprints, and groups of fingerprints that differ in few bits.

A fingerprint of 64 bits is split into `parts` blocks; two that differ in at most `distance` bits
agree in at least parts - distance blocks, so joining on every choice of that many blocks finds
each such pair. Equal fingerprints are one row from the start. A bucket of more than `side` rows
is cut into sides, and each pair of sides is compared in a task of its own that returns a link of
each row found near another, enough to keep the group connected, but never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import arrow_schema, map_rows, store

SEED = 42


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits over shingles of so many words, in lower case for A-Z; without words zero."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined, ends, at = b" ".join(found), [], -1
    for w in found:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends]]
    hash_of, k = xxhash.xxh64_intdigest, min(words, len(found)) - 1
    values = np.array([hash_of(joined[s:e], SEED) for s, e in zip(starts, ends[k:])], dtype="<u8")
    return majority(values)


def majority(values: np.ndarray) -> int:
    """The bits that are set in over half the values."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(values), 4096):
        bits = np.unpackbits(values[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): every whole text's fingerprint as a signed long; a null text has no words."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return map_rows(
        docs.select("doc_id", "text"),
        lambda: lambda keys, texts: (keys, [signed(fingerprint(t, words)) for t in texts]),
        "doc_id long, fp long",
    )


def block_masks(parts: int, distance: int) -> list[int]:
    """The bits of each choice of parts - distance blocks, as signed 64-bit masks."""
    cuts = [round(64 * i / parts) for i in range(parts + 1)]
    masks = []
    for chosen in combinations(range(parts), parts - distance):
        m = sum(((1 << (cuts[j + 1] - cuts[j])) - 1) << cuts[j] for j in chosen)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def near_in_bucket(fp: np.ndarray, side: np.ndarray, one: bool, distance: int):
    """Index pairs that keep connected what is near: within a side, or between two sides."""
    if one:
        rest, out = np.arange(len(fp)), []
        while len(rest) > 1:  # grow from a row at a time: all that is near it needs no other link to it
            near = np.bitwise_count(fp[rest[1:]] ^ fp[rest[0]]) <= distance
            out += [(int(rest[0]), int(j)) for j in rest[1:][near]]
            rest = rest[1:]
            if len(out) > 4 * len(fp):
                out = forest(out, len(fp))
        return forest(out, len(fp))
    left, right, out = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max()), []
    for i in left.tolist():
        near = right[np.bitwise_count(fp[right] ^ fp[i]) <= distance]
        out += [(i, int(j)) for j in near]
        if len(out) > 4 * len(fp):
            out = forest(out, len(fp))
    return forest(out, len(fp))


def forest(pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs."""
    top = list(range(n))

    def root(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    out = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            top[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def links(nodes: DataFrame, distance: int = 3, parts: int = 5, side: int = 1024) -> DataFrame:
    """(a, b): links between nodes (node, fp) whose fingerprints differ in 1 to distance bits, connecting all such groups.

    side: rows of a bucket compared at once. 5 blocks give 10 keys of 25 or 26 bits.
    """
    masks = block_masks(parts, distance)
    keyed = nodes.select("node", "fp", F.posexplode(F.array([F.lit(m) for m in masks])).alias("k", "mask")).select(
        "node", "fp", F.col("k").alias("kind"), F.col("fp").bitwiseAND(F.col("mask")).alias("bits")
    )
    counts = store(keyed.groupBy("kind", "bits").agg(F.count("*").alias("rows")).where("rows > 1"), "buckets")
    cut = F.ceil(F.col("rows") / side).cast("int")
    own = F.when(cut > 1, F.pmod(F.xxhash64("fp"), cut)).otherwise(F.lit(0)).cast("int")
    met = (
        keyed.join(counts, ["kind", "bits"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), cut - 1)))
        .select("kind", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "fp")
    )
    keys = ["kind", "bits", "i", "j"]
    schema = arrow_schema("a long, b long")

    def run(batches):
        for cols in runs(batches, keys):
            found = compare(cols, distance)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)

    return met.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(run, "a long, b long")


def runs(batches, keys: list[str]):
    """Batches cut where the keys change, so that no bucket is split; numpy columns."""
    kept: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        if kept is not None:
            cols = {n: np.concatenate([kept[n], cols[n]]) for n in cols}
        last = np.ones(len(cols[keys[0]]), dtype=bool)
        for k in keys:
            last &= cols[k] == cols[k][-1]
        at = int(np.argmax(last))  # where the last run begins
        if at:
            yield {n: c[:at] for n, c in cols.items()}
        kept = {n: c[at:] for n, c in cols.items()}
    if kept is not None:
        yield kept


def compare(cols: dict[str, np.ndarray], distance: int, few: int = 32) -> list[tuple[int, int]]:
    """Links within each run of equal (kind, bits, i, j)."""
    change = np.zeros(len(cols["fp"]), dtype=bool)
    change[0] = True
    for k in ("kind", "bits", "i", "j"):
        change[1:] |= cols[k][1:] != cols[k][:-1]
    begin = np.flatnonzero(change)
    length = np.diff(np.append(begin, len(change)))
    run = np.repeat(np.arange(len(begin)), length)
    fp, node, own = cols["fp"].astype(np.int64).view(np.uint64), cols["node"], cols["own"]
    crossing = cols["i"] != cols["j"]
    small = (length <= few)[run]
    out: list[tuple[int, int]] = []
    for d in range(1, few):
        near = (run[d:] == run[:-d]) & small[d:] & (~crossing[d:] | (own[d:] != own[:-d]))
        if not near.any():
            break
        at = np.flatnonzero(near)
        at = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= distance]
        out += zip(node[at].tolist(), node[at + d].tolist())
    for r in np.flatnonzero(length > few):
        s = slice(begin[r], begin[r] + length[r])
        if crossing[begin[r]] and own[s].min() == own[s].max():
            continue
        for a, b in near_in_bucket(fp[s], own[s], not crossing[begin[r]], distance):
            out.append((int(node[s][a]), int(node[s][b])))
    return out


def groups(prints: DataFrame, distance: int = 3, parts: int = 5) -> DataFrame:
    """Add component_id, the smallest doc_id reachable by links of at most distance bits, to rows (doc_id, fp).

    Rows without a doc_id take part in no link and are a component null.
    """
    prints = store(prints, "fingerprints")
    nodes = store(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = connected_components(links(nodes, distance, parts))
    tops = store(
        nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "tops"
    )
    joined = prints.join(tops, "fp", "left")
    return joined.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
