"""Near-duplicate embeddings by a forest of random-projection trees with spill.

Equal vectors are one node with a count. Each tree splits a bounded sample again and again at the median of a
random projection, the same one for all splits of a level; at each split, vectors near the threshold go to both
sides. All vectors are routed to their leaves in all trees and compared there by exact cosine. Leaves that the sample
was too small to split are split further, each by the median of its own vectors' projections, in rounds until
every leaf is small or does not come apart. Splits would cut through dense groups that are larger than a leaf, so
each such group is a ball: a leaf with all vectors near enough to be linked with it, whatever their number. Vectors well
inside a ball have all their links there and go no further down. Balls are looked for in the sample first, then in each overfull leaf
on some vectors of its own, before it is split. A pair that meets in several leaves counts in
the first one only, so links are counted without ever being written out; of each leaf go on only
counts and links that span its components. A leaf with many vectors is split into blocks, and
each pair of blocks is a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, components, saved

#: Vectors and bytes of the sample that shapes the trees at most, trees, vectors wanted in a leaf, and in a block at most.
SAMPLE, SAMPLE_BYTES, TREES, LEAF, BLOCK = 16_384, 64 << 20, 8, 400, 1024
#: Vectors within this many standard deviations of a split's threshold go to both sides.
SPILL = 0.12
#: Rows of the sample whose cosines with all of it are held at once.
ROWS = 256
#: A leaf with more than this many times the wanted vectors is split further; a split must leave less than this share on a side.
OVERFULL, APART = 4, 0.9


#: Vectors of an overfull leaf among which dense groups are looked for, and vectors that are held against its balls at once.
PROBE, PIECE = 256, 4096


def direction(dim: int, *seed: int) -> np.ndarray:
    out = np.random.default_rng(seed).standard_normal(dim)
    return out / np.linalg.norm(out)


def dense_balls(sample: np.ndarray, threshold: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres of the groups that do not fit a leaf, and of each the least cosines of what lies deep inside and of what belongs to its ball.

    Dense is a point with more than `least` linked ones in the sample. The densest one left is a centre, and stands for
    the dense points within twice the angle of a link. Deep are vectors no farther than the farthest of them; the ball ends one
    angle of a link beyond, so every link of a deep vector is inside.
    """
    link = float(np.arccos(np.clip(threshold, -1, 1)))
    degree = np.concatenate([np.zeros(0, int), *((sample[a : a + ROWS] @ sample.T >= threshold).sum(axis=1) for a in range(0, len(sample), ROWS))])
    order = np.argsort(-degree, kind="stable")
    waiting = order[degree[order] > least]
    centres, angles = [], []
    while len(waiting):
        centre = sample[waiting[0]]
        angle = np.arccos(np.clip(sample[waiting] @ centre, -1, 1))
        own = angle <= 2 * link
        own[0] = True
        centres.append(centre)
        angles.append(float(angle[own].max()))
        waiting = waiting[~own]
    deep = np.cos(np.array(angles)) + 1e-9
    reach = np.cos(np.minimum(np.pi, np.array(angles) + link)) - 1e-9
    return np.array(centres).reshape(-1, sample.shape[1]), deep, reach


class Forest:
    """Splits as arrays: threshold, margin, children and level; a negative child is a leaf. Balls are the first leaves.

    The directions are a row for each tree and level, and are made again from their seeds where they are used.
    What is sent to the tasks are the splits (48 bytes each, fewer than trees * sample) and the balls' centres (at most
    one for every eight vectors of the sample).
    """

    def __init__(self, sample: np.ndarray, n_vectors: int, threshold: float, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, seed: int = 7):
        self.seed, self.dim = seed, sample.shape[1]
        self.cuts: list[tuple[float, float, int, int, int]] = []
        self.least = max(8, int(leaf * len(sample) / max(1, n_vectors)))
        self.centres, self.deep, self.reach = dense_balls(sample, threshold, self.least)
        self.n_leaves, self.spill = len(self.centres), spill
        self.roots = [self._grow(sample, tree, 0) for tree in range(trees)]

    def _grow(self, points: np.ndarray, tree: int, level: int) -> int:
        if len(points) > 2 * self.least:
            at = points @ direction(self.dim, self.seed, tree, level)
            cut, margin = float(np.median(at)), float(self.spill * at.std())
            left, right = points[at <= cut + margin], points[at > cut - margin]
            if max(len(left), len(right)) < APART * len(points):  # else these points do not come apart
                here = len(self.cuts)
                self.cuts.append((cut, margin, 0, 0, level))
                self.cuts[here] = (cut, margin, self._grow(left, tree, level + 1), self._grow(right, tree, level + 1), level)
                return here
        self.n_leaves += 1
        return -self.n_leaves

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for each leaf of each row, by row, leaves in order of their trees. What is deep in a ball is in no tree."""
        cosines = points @ self.centres.T
        inside, ball = np.nonzero(cosines >= self.reach)
        others = np.flatnonzero(~(cosines >= self.deep).any(axis=1))
        rows, leaves = [inside], [ball + 1]

        def down(node: int, at: np.ndarray, values: np.ndarray) -> None:
            if node < 0:
                rows.append(at)
                leaves.append(np.full(len(at), -node))
                return
            cut, margin, left, right, level = self.cuts[node]
            value = values[at, level]
            down(left, at[value <= cut + margin], values)
            down(right, at[value > cut - margin], values)

        levels = 1 + max((c[4] for c in self.cuts), default=0)
        for tree, root in enumerate(self.roots):
            way = np.array([direction(self.dim, self.seed, tree, level) for level in range(levels)])
            down(root, others, points @ way.T)
        row, leaf = np.concatenate(rows), np.concatenate(leaves)
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]


def _units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length in double precision, shorter ones filled up with zeros; and which rows are valid."""
    out, good = np.zeros((len(column), dim)), np.zeros(len(column), bool)
    for i, x in enumerate(column):
        if x.is_valid:
            values = x.values
            if values.null_count == 0 and len(values):
                v = values.to_numpy(zero_copy_only=False).astype(np.float64)
                size = np.linalg.norm(v)
                if np.isfinite(v).all() and size > 0:
                    scale = np.abs(v).max()
                    v = v / scale  # neither overflows nor vanishes
                    out[i, : len(v)], good[i] = v / np.linalg.norm(v), True
    return out, good


def _leaf(table: pa.Table, dim: int, threshold: float) -> pa.Table:
    """Of a leaf, or a pair of its blocks: partial counts of links (b null) and spanning links (n null)."""
    ids, counts = table.column("node").to_numpy(), table.column("n").to_numpy()
    leaf, i, j = (table.column(x)[0].as_py() for x in ("leaf", "i", "j"))
    own = table.column("own").to_numpy()
    x = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(-1, dim)
    leaves = [np.frombuffer(b, np.int64) for b in table.column("leaves").to_pylist()]
    earlier = [b[b < leaf] for b in leaves]
    links = x @ x.T >= threshold
    np.fill_diagonal(links, False)
    if i != j:
        links &= own[:, None] != own[None, :]
    first = links.copy()
    names, place = np.unique(np.concatenate(earlier), return_inverse=True)
    order = np.argsort(place, kind="stable")
    members = np.repeat(np.arange(len(ids)), [len(b) for b in earlier])[order]
    for both in np.split(members, np.cumsum(np.bincount(place, minlength=len(names)))[:-1]) if len(names) else []:
        if len(both) > 1:  # these have met in an earlier leaf
            first[np.ix_(both, both)] = False
    n_links = first @ counts
    left, right = [], []
    waiting = links.any(axis=1)
    for seed in range(len(ids)):
        if not waiting[seed]:
            continue
        waiting[seed], queue = False, [seed]
        while queue:
            at = queue.pop()
            found = np.flatnonzero(links[at] & waiting)
            waiting[found] = False
            queue += found.tolist()
            left += [ids[at]] * len(found)
            right += ids[found].tolist()
    some = n_links > 0
    a = np.r_[ids[some], np.array(left, np.int64)]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array([None] * int(some.sum()) + right, pa.int64()), "n": pa.array(n_links[some].tolist() + [None] * len(left), pa.int64())})


def _probe(rows: DataFrame, dim: int, threshold: float, leaf: int) -> DataFrame:
    """(leaf, centres, deep, reach) of overfull leaves with dense groups, found among some PROBE vectors of each; a leaf with more balls has more rows.

    rows: (node, leaf, size, unit) of all vectors in them. The vectors looked at are drawn by a hash, so a leaf's group is small however large the leaf.
    """
    picked = rows.where(F.pmod(F.xxhash64("node", "leaf"), F.lit(1 << 30)) < F.lit(float(PROBE << 30)) / F.col("size"))

    def find(t: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float64).reshape(-1, dim)
        least = max(8, int(leaf * len(x) / t.column("size")[0].as_py()))
        centres, deep, reach = dense_balls(x, threshold, least)
        n = len(centres)
        return pa.table({"leaf": pa.array([t.column("leaf")[0].as_py()] * n, pa.int64()), "ball": pa.array(range(n), pa.int32()), "centre": pa.array([c.tobytes() for c in centres], pa.binary()), "deep": pa.array(deep, pa.float64()), "reach": pa.array(reach, pa.float64())})

    return saved(picked.select("leaf", "size", "unit").groupBy("leaf").applyInArrow(find, "leaf bigint, ball int, centre binary, deep double, reach double"), "balls")


def _gather(rows: DataFrame, balls: DataFrame, dim: int) -> DataFrame:
    """(node, leaf, ball, deep): the vectors of rows in the balls of their leaf. A leaf is held against its balls in pieces of some PIECE vectors."""
    pieces = F.ceil(F.col("size") / PIECE).cast("int")
    some = rows.join(balls.select("leaf").distinct(), "leaf", "left_semi")
    dealt = some.select("node", "unit", "leaf", F.pmod(F.xxhash64("node", F.lit(2)), pieces).cast("int").alias("piece"))
    sizes = some.select("leaf", pieces.alias("pieces")).distinct()
    copies = balls.join(sizes, "leaf").withColumn("piece", F.explode(F.expr("sequence(0, pieces - 1)"))).drop("pieces")

    def inside(vectors: pa.Table, own: pa.Table) -> pa.Table:
        if not vectors.num_rows or not own.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "leaf": pa.array([], pa.int64()), "ball": pa.array([], pa.int32()), "deep": pa.array([], pa.bool_())})
        x, c = (np.frombuffer(b"".join(t.column(n).to_pylist()), np.float64).reshape(-1, dim) for t, n in ((vectors, "unit"), (own, "centre")))
        cosines = x @ c.T
        row, ball = np.nonzero(cosines >= own.column("reach").to_numpy())
        deep = cosines[row, ball] >= own.column("deep").to_numpy()[ball]
        return pa.table({"node": vectors.column("node").to_numpy()[row], "leaf": vectors.column("leaf").to_numpy()[row], "ball": own.column("ball").to_numpy()[ball], "deep": deep})

    return saved(dealt.groupBy("leaf", "piece").cogroup(copies.groupBy("leaf", "piece")).applyInArrow(inside, "node bigint, leaf bigint, ball int, deep boolean"), "inside")


def _split(nodes: DataFrame, routes: DataFrame, n_balls: int, dim: int, leaf: int, spill: float, threshold: float, seed: int = 11) -> DataFrame:
    """Rows (node, n, unit, leaf, leaves) where leaves of more than OVERFULL * leaf vectors are split again and again.

    A round first looks for dense groups in each overfull leaf. Each is a ball, a leaf of its own that is not split; what lies deep in one
    leaves the leaf that is split. Then the vectors are projected on one direction, and the median and the spread of each
    leaf are an aggregate, so no task or driver holds a leaf. The leaves' numbers grow by a bit a round, balls have negative ones. A leaf
    that does not come apart is left to the blocks; so are balls. Rounds grow with the logarithm of the largest leaf.
    """
    start = F.when(F.col("leaf") > n_balls, F.shiftleft("leaf", 31) + 1).otherwise(F.col("leaf"))
    routes = saved(routes.select("node", start.alias("leaf")), "routes")
    stuck: list[DataFrame] = []
    for level in range(30):
        sizes = routes.groupBy("leaf").agg(F.count("*").alias("size")).where((F.col("leaf") > n_balls) & (F.col("size") > OVERFULL * leaf))
        for table in stuck:
            sizes = sizes.join(table, "leaf", "left_anti")
        sizes = saved(sizes, "overfull")
        if not sizes.take(1):
            break
        way = direction(dim, seed, level)

        def project(batches: Iterator[pa.RecordBatch], way: np.ndarray = way) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, dim)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x @ way)], names=["node", "at"])

        here = routes.join(sizes, "leaf")
        vectors = here.join(nodes.select("node", "unit"), "node")
        balls = _probe(vectors, dim, threshold, leaf)
        if balls.take(1):
            found = _gather(vectors, balls, dim)
            number = -F.shiftrightunsigned(F.xxhash64("leaf", "ball"), 1) - 1
            deep = found.where("deep").select("node", "leaf").distinct()
            routes = saved(routes.join(deep, ["node", "leaf"], "left_anti").unionByName(found.select("node", number.alias("leaf"))), "routes")
            here = routes.join(sizes.select("leaf"), "leaf")
        values = nodes.select("node", "unit").mapInArrow(project, "node bigint, at double")
        full = saved(here.select("node", "leaf").join(values, "node"), "projections")
        cuts = full.groupBy("leaf").agg(F.percentile_approx("at", 0.5, 1000).alias("cut"), (F.stddev_pop("at") * spill).alias("margin"), F.count("*").alias("size"))
        left, right = F.col("at") <= F.col("cut") + F.col("margin"), F.col("at") > F.col("cut") - F.col("margin")
        placed = full.join(cuts, "leaf").withColumns({"left": left, "right": right})
        apart = placed.groupBy("leaf").agg(F.greatest(F.count_if("left"), F.count_if("right")).alias("larger"), F.count("*").alias("size"))
        apart = saved(apart.select("leaf", ((F.col("larger") < APART * F.col("size")) & (F.col("size") > OVERFULL * leaf)).alias("apart")), "apart")
        stuck.append(apart.where("NOT apart").select("leaf"))
        sides = F.filter(F.array(F.when(F.col("left"), F.shiftleft("leaf", 1)), F.when(F.col("right"), F.shiftleft("leaf", 1) + 1)), lambda x: x.isNotNull())
        deeper = placed.join(apart.where("apart").select("leaf"), "leaf").select("node", F.explode(sides).alias("leaf"))
        rest = routes.join(apart.where("apart").select("leaf"), "leaf", "left_anti")
        routes = saved(rest.unionByName(deeper), "routes")
    names = ["node", "n", "unit", "leaf", "leaves"]
    lists = routes.distinct().groupBy("node").agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))  # a few dozen a node

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            sizes = column.value_lengths().to_numpy()
            at = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            raw = pa.array([np.array(x, np.int64).tobytes() for x in column.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:3]), column.flatten(), raw.take(at)], names=names)

    return nodes.join(lists, "node").select("node", "n", "unit", "leaves").mapInArrow(unfold, "node bigint, n bigint, unit binary, leaf bigint, leaves binary")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE) -> DataFrame:
    """A row for each row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Linked are vectors found with cosine >= threshold, in double precision. n_links counts other rows;
    component_id is the smallest vec_id reachable; kept: vec_id is its component's. Null vectors, zero ones, and
    those with null or non-finite components link with nothing. Shorter vectors are filled up with zeros. A repeated
    vec_id counts as another vector; a null one links, but is no component's smallest unless all are null.
    The trees are shaped by at most `sample` vectors; all are routed, and leaves that are still too large are split on
    their own vectors. A group with more than `leaf` links to a vector, as far as the sample or some vectors of an overfull leaf show it, is
    compared as a whole. Other columns are left out, whatever their names.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    dim = vectors.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
    dim = max(1, dim)

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = _units(batch.column(1), dim)
            raw = [r.tobytes() if g else None for r, g in zip(x, good, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["vec_id", "unit"])

    rows = saved(vectors.mapInArrow(units, "vec_id bigint, unit binary"), "units")
    # equal vectors once; the node's number is a hash of its bytes
    nodes = saved(rows.where("unit IS NOT NULL").groupBy("unit").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")).withColumn("node", F.xxhash64("unit")), "nodes")
    n_nodes = nodes.count()
    most = max(64, min(sample, SAMPLE_BYTES // (8 * dim)))
    picked = [r[0] for r in nodes.orderBy(F.xxhash64("node"), "node").limit(most).select("unit").toLocalIterator()]
    grown = Forest(np.frombuffer(b"".join(picked), np.float64).reshape(-1, dim), n_nodes, threshold, trees, leaf, spill)
    forest = spark.sparkContext.broadcast(grown)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "n", "unit", "leaf", "leaves"]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float64).reshape(-1, dim)
            row, leaves = forest.value.route(x)
            cuts = np.searchsorted(row, np.arange(len(x) + 1))
            raw = [leaves[a:b].astype(np.int64).tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(row)) for c in batch.columns] + [pa.array(leaves, pa.int64()), pa.array(raw, pa.binary()).take(pa.array(row))], names=names)

    routed = nodes.select("node", "n", "unit").mapInArrow(route, "node bigint, n bigint, unit binary, leaf bigint, leaves binary")
    counts = saved(routed.groupBy("leaf").agg(F.count("*").alias("size")), "sizes")
    if counts.where((F.col("leaf") > len(grown.centres)) & (F.col("size") > OVERFULL * leaf)).take(1):
        routed = _split(nodes.select("node", "n", "unit"), routed.select("node", "leaf"), len(grown.centres), dim, leaf, spill, threshold)
        counts = saved(routed.groupBy("leaf").agg(F.count("*").alias("size")), "sizes")
    sizes = counts.select("leaf", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    few = sizes.count() * 12 <= BROADCAST_BYTES
    placed = (
        routed.join(F.broadcast(sizes) if few else sizes, "leaf")
        .withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        .drop("blocks", "other")
    )
    found = saved(placed.groupBy("leaf", "i", "j").applyInArrow(lambda t: _leaf(t, dim, threshold), "a bigint, b bigint, n bigint"), "links")
    degree = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("other"))
    joined = components(found.where("b IS NOT NULL").select("a", "b"))
    facts = nodes.select("node", "unit", "vec_id", "n").join(degree, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = facts.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    facts = facts.join(least, "component").select("unit", (F.coalesce("other", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    return rows.join(facts, "unit", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )
