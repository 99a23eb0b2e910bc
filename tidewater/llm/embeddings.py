"""Near-duplicate embeddings: exact pairs at a cosine threshold by dual traversal of cover trees.

On unit vectors a cosine of c is a distance of sqrt(2 - 2c). The tree's upper levels are fitted on
a bounded sample and every vector descends in them to a cell; a cell's covering radius is the
greatest distance of its vectors, all of them. Pairs of cells farther apart than both radii and
the threshold are pruned. Each pair left is a task: it builds a tree for either side, with nested
levels of halving radii, and walks both together, pruning pairs of nodes the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import arrow_schema, store
from .simhash import forest

#: Slack of the bounds for rounding; the pairs themselves are compared exactly.
SLACK = 1e-9


class CoverTree:
    """Nodes (centre, radius, members or children) over rows of unit vectors.

    A node's children are centres no nearer than half the node's scale, and every member goes to a
    centre within it. A node whose children would be nearly as many as its members is a leaf, for
    then the data have no structure at that scale.
    """

    def __init__(self, points: np.ndarray, leaf: int = 48):
        self.points, self.leaf = points, leaf
        self.root = self._node(np.arange(len(points)), 0, 2.0) if len(points) else None

    def _node(self, members: np.ndarray, centre: int, scale: float):
        gap = np.sqrt(np.maximum(2 - 2 * self.points[members] @ self.points[centre], 0.0))
        radius = float(gap.max())
        children = []
        while len(members) > self.leaf and scale > 1e-3:
            scale /= 2
            if scale >= radius:
                continue
            children = self._split(members, scale)
            break
        return centre, radius, members, children

    def _split(self, members: np.ndarray, scale: float) -> list:
        limit, rest, parts = max(2, len(members) // 4), members, []
        while len(rest):
            if len(parts) >= limit:
                return []
            centre = int(rest[0])
            inside = 2 - 2 * self.points[rest] @ self.points[centre] <= scale * scale
            inside[0] = True
            parts.append((centre, rest[inside]))
            rest = rest[~inside]
        return [self._node(m, c, scale) for c, m in parts] if len(parts) > 1 else []


def near_pairs(a: CoverTree, b: CoverTree, cosine: float, same: bool):
    """Yield index arrays (i, j) of all pairs at the threshold; with same, each pair once, i < j."""
    reach = np.sqrt(max(2 - 2 * cosine, 0.0)) + SLACK
    stack = [(a.root, b.root)] if a.root and b.root else []
    while stack:
        x, y = stack.pop()
        apart = np.sqrt(max(2 - 2 * float(a.points[x[0]] @ b.points[y[0]]), 0.0))
        if apart - x[1] - y[1] > reach:
            continue
        if x[3] and (x[1] >= y[1] or not y[3]):
            stack += [(c, y) for c in x[3]]
        elif y[3]:
            stack += [(x, c) for c in y[3]]
        else:
            for s in range(0, len(x[2]), 512):
                rows = x[2][s : s + 512]
                i, j = np.nonzero(a.points[rows] @ b.points[y[2]].T >= cosine)
                i, j = rows[i], y[2][j]
                if same:
                    keep = i < j
                    i, j = i[keep], j[keep]
                if len(i):
                    yield i, j


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, unit): unit vectors as 64-bit floats in binary; null where nothing can link.

    That is so for a null label or vector, a zero vector, and null or non-finite components.
    """
    ddl = "vec_id long, label long, unit binary"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            units = []
            for label, v in zip(batch.column("label").to_pylist(), batch.column("embedding")):
                unit = None
                if label is not None and v.is_valid and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    top = np.abs(x).max(initial=0.0)
                    if 0 < top < np.inf:
                        x = x / top
                        unit = (x / np.sqrt(x @ x)).tobytes()
                units.append(unit)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast("int64"), batch.column("label").cast("int64"), pa.array(units, pa.binary())], schema=schema)

    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, ddl)


def upper_levels(sample: list[tuple[int, bytes]], sizes: dict[int, int], block: int) -> dict:
    """Centres of cells by (label, dimensions): farthest points of the sample, about one for each `block` vectors."""
    by: dict[tuple[int, int], list[np.ndarray]] = {}
    for label, unit in sample:
        v = np.frombuffer(unit)
        by.setdefault((label, len(v)), []).append(v)
    out = {}
    for key, rows in by.items():
        x = np.array(rows)
        wanted = min(len(x), max(1, -(-sizes.get(key[0], 0) // block)))
        chosen, gap = [0], 1 - x @ x[0]
        while len(chosen) < wanted:
            nxt = int(gap.argmax())
            if gap[nxt] <= 0:
                break
            chosen.append(nxt)
            gap = np.minimum(gap, 1 - x @ x[nxt])
        out[key] = x[chosen]
    return out


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, block: int = 4096, sample: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id and kept for every vector with links of at least `cosine` inside its label.

    block: about how many vectors a task compares with as many others. sample: vectors that the
    upper levels are fitted on. Equal vectors of a label are one row in the search. Vectors of
    different length never link. A row without a vec_id links with nothing; repeated ids are rows
    of their own, of one component.
    """
    rows = store(unit_vectors(vectors), "units")
    usable = rows.where("unit IS NOT NULL AND vec_id IS NOT NULL")
    classes = store(
        usable.groupBy("label", "unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
        .withColumn("place", F.xxhash64("rep", "label")), "classes",
    )
    shares = {r["label"]: r["n"] for r in classes.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > block).orderBy(F.desc("n")).limit(sample).collect()}
    picked = [(r["label"], bytes(r["unit"])) for r in classes.select("place", "label", "unit").orderBy("place").limit(sample).collect()] if shares else []
    centres = upper_levels([p for p in picked if p[0] in shares], shares, block)
    box = vectors.sparkSession.sparkContext.broadcast(centres)
    ddl = "label long, rep long, n long, unit binary, cell int, gap double"
    schema = arrow_schema(ddl)

    def descend(batches):
        for batch in batches:
            cells, gaps = [], []
            for label, unit in zip(batch.column("label").to_pylist(), batch.column("unit").to_pylist()):
                c = box.value.get((label, len(unit) // 8))
                cos = c @ np.frombuffer(unit) if c is not None else np.zeros(1)
                k = int(cos.argmax())
                cells.append(k)
                gaps.append(float(np.sqrt(max(2 - 2 * cos[k], 0.0))) if c is not None else 2.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in ("label", "rep", "n", "unit")], pa.array(cells, pa.int32()), pa.array(gaps)], schema=schema)

    placed = store(classes.select("label", "rep", "n", "unit").mapInArrow(descend, ddl), "cells")
    cells = placed.groupBy("label", F.octet_length("unit").alias("size"), "cell").agg(F.count("*").alias("rows"), F.max("gap").alias("radius"))
    cells = store(cells.withColumn("sides", F.ceil(F.col("rows") / block).cast("int")), "radii")
    reach = float(np.sqrt(max(2 - 2 * cosine, 0.0))) + SLACK

    # Which cells meet: few rows, for there is one for each `block` vectors.
    one, two = cells.alias("p"), cells.alias("q")
    met = one.join(two, (F.col("p.label") == F.col("q.label")) & (F.col("p.size") == F.col("q.size")) & (F.col("p.cell") <= F.col("q.cell")))
    met = met.select("p.label", "p.size", F.col("p.cell").alias("c"), F.col("q.cell").alias("d"), F.col("p.radius").alias("r"), F.col("q.radius").alias("s"), F.col("p.sides").alias("m"), F.col("q.sides").alias("k"))

    def close(batches):
        for b in batches:
            keep = []
            for label, size, c, d, r, s in zip(*[b.column(x).to_pylist() for x in ("label", "size", "c", "d", "r", "s")]):
                x = box.value.get((label, size // 8))
                keep.append(c == d or x is None or np.sqrt(max(2 - 2 * float(x[c] @ x[d]), 0.0)) - r - s <= reach)
            yield b.filter(pa.array(keep, pa.bool_()))

    met = met.mapInArrow(close, met.schema)
    met = met.select("label", "size", "c", "d", "r", "s", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"), "k").select(
        "label", "size", "c", "d", "r", "s", "i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j")
    ).where("c < d OR i <= j")
    pairs = store(met.withColumn("pair", F.monotonically_increasing_id()), "pairs")
    def end(rows: DataFrame, own: str, side: str, other: str, radius: str, number: int) -> DataFrame:
        return rows.select("pair", "label", "size", F.col(own).alias("cell"), F.col(side).alias("side"), F.lit(number).alias("end"), F.col(other).alias("other"), F.col(radius).alias("far"))

    two = pairs.where("c < d OR i < j")
    alone = end(pairs.where("c = d AND i = j"), "c", "i", "d", "s", 2)
    ends = alone.unionByName(end(two, "c", "i", "d", "s", 0)).unionByName(end(two, "d", "j", "c", "r", 1))
    sided = placed.withColumn("size", F.octet_length("unit")).join(cells.select("label", "size", "cell", "sides"), ["label", "size", "cell"])
    sided = sided.withColumn("side", F.pmod(F.xxhash64("rep"), F.col("sides")).cast("int"))
    dealt = sided.join(ends, ["label", "size", "cell", "side"]).select("label", "cell", "other", "far", "pair", "end", "rep", "n", "unit")

    def within(batches):
        """Without the vectors that are too far from the other cell's centre for a link into it."""
        for batch in batches:
            keep = []
            for label, cell, other, far, unit in zip(*[batch.column(x).to_pylist() for x in ("label", "cell", "other", "far", "unit")]):
                x = box.value.get((label, len(unit) // 8))
                keep.append(cell == other or x is None or np.sqrt(max(2 - 2 * float(x[other] @ np.frombuffer(unit)), 0.0)) - far <= reach)
            yield batch.select(["pair", "end", "rep", "n", "unit"]).filter(pa.array(keep, pa.bool_()))

    dealt = dealt.mapInArrow(within, "pair long, end int, rep long, n long, unit binary")
    out = "rep long, links long, a long, b long"
    found_schema = arrow_schema(out)

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("end", "ascending"), ("rep", "ascending")])
        end, rep, n = (table.column(c).to_numpy() for c in ("end", "rep", "n"))
        x = np.frombuffer(b"".join(table.column("unit").to_pylist())).reshape(len(rep), -1)
        first, same = int((end != 1).sum()), bool((end == 2).any())
        left = CoverTree(x[:first])
        right = left if same else CoverTree(x[first:])
        links, tree = np.zeros(len(rep), dtype=np.int64), []
        for i, j in near_pairs(left, right, cosine, same):
            j = j if same else j + first
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            tree += zip(i.tolist(), j.tolist())
            if len(tree) > 8 * len(rep) + 100_000:
                tree = forest(tree, len(rep))
        tree = forest(tree, len(rep))
        got = np.flatnonzero(links)
        none = [None] * len(got)
        return pa.table([
            pa.array(rep[got].tolist() + [None] * len(tree), pa.int64()), pa.array(links[got].tolist() + [None] * len(tree), pa.int64()),
            pa.array(none + [int(rep[i]) for i, _ in tree], pa.int64()), pa.array(none + [int(rep[j]) for _, j in tree], pa.int64()),
        ], schema=found_schema)

    found = store(dealt.groupBy("pair").applyInArrow(compare, out), "found")
    links = store(found.where("rep IS NOT NULL").groupBy("rep").agg(F.sum("links").alias("links")), "counts")
    tops = connected_components(found.where("a IS NOT NULL").select("a", "b"))
    info = store(
        classes.select("label", "unit", "rep", "n").join(links, "rep", "left").join(tops.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "unit", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("top")), "info",
    )
    joined = rows.join(info, ["label", "unit"], "left")
    component = F.coalesce(F.when(F.col("vec_id").isNotNull(), F.col("top")), F.col("vec_id"))
    return joined.select(
        "vec_id", F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"), (F.col("vec_id") == component).alias("kept"),
    )
