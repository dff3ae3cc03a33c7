"""Nearest neighbours by a forest of random-projection trees searched through one shared priority queue.

Trees are fitted on a bounded sample (``sample`` vectors, those with the smallest hashed ids): a node splits at the
median of the sample's projections on the difference of two of its vectors. Every row is indexed: it goes to one leaf
of each tree. A query walks all trees at once, always from the open branch with the smallest distance to the
hyperplanes crossed so far, until it has ``visits`` leaves; its candidates in them are ranked by exact distance. How
many leaves that takes is measured on the sample: the fewest that find ``recall`` of the true neighbours of some of its
vectors. The trees are the same for sample and table, so the share of rows looked at is the same in both, and neighbours
in the table are nearer and easier to find. A query goes on until the leaves visited of one tree hold enough rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_by_run, column, materialise

TREES, LEAF, RECALL, SAMPLE = 12, 256, 0.94, 20_000
#: Sample vectors whose neighbours are searched to choose the number of visits.
PROBES = 64
#: Rows of a leaf that one row group holds at most, about; larger leaves are dealt out by hashed id.
BLOCK = 4096
#: Queries of a leaf that one row group compares at most, about.
ASKED = 8192


class Forest:
    """``trees`` perfect binary trees of equal depth; node k has the children 2k + 1 and 2k + 2."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 5):
        self.depth, dims, rng = depth, sample.shape[1], np.random.default_rng(seed)
        inner = 2**depth - 1
        self.normals, self.cuts = np.zeros((trees, inner, dims), np.float32), np.zeros((trees, inner), np.float64)
        for t in range(trees):
            members = {0: np.arange(len(sample))}
            for node in range(inner):
                own = members.pop(node)
                a, b = sample[rng.choice(own, 2, replace=len(own) < 2)] if len(own) else (np.zeros(dims), np.zeros(dims))
                normal = np.asarray(a, np.float64) - b
                if not normal.any():
                    normal = rng.standard_normal(dims)
                self.normals[t, node] = normal / np.linalg.norm(normal)
                at = sample[own] @ self.normals[t, node].astype(np.float64)
                self.cuts[t, node] = np.median(at) if len(own) else 0.0
                right = at > self.cuts[t, node]
                members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of each vector in each tree (trees x rows)."""
        out = np.zeros((len(self.normals), len(x)), np.int64)
        for t in range(len(self.normals)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", x, self.normals[t, node].astype(np.float64)) > self.cuts[t, node]
                node = 2 * node + 1 + right
            out[t] = node - (2**self.depth - 1)
        return out

    def search(self, q: np.ndarray, visits: int, sizes: np.ndarray | None = None, wanted: int = 0) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue: ``visits`` of them, and more until those of one tree hold
        ``wanted`` rows by ``sizes`` (tree, leaf), if there are as many."""
        held = np.zeros(len(self.normals), np.int64)
        margins = np.einsum("tnd,d->tn", self.normals, q) - self.cuts
        inner, found = 2**self.depth - 1, []
        heap = [(0.0, t, 0) for t in range(len(self.normals))]
        while heap and (len(found) < visits or held.max() < wanted):
            far, t, node = heapq.heappop(heap)
            while node < inner:
                m = margins[t, node]
                near, other = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(heap, (max(far, abs(m)), t, other))
                node = near
            found.append((t, node - inner))
            if sizes is not None:
                held[t] += sizes[t, node - inner]
        return found


def visits_needed(forest: Forest, sample: np.ndarray, k: int, recall: float, probes: int = PROBES) -> int:
    """Fewest leaves a search has to visit to find ``recall`` of the ``k`` nearest in the sample, averaged over probes."""
    size = 2**forest.depth
    at = forest.leaves(sample)
    seen: list[np.ndarray] = []
    for i in range(min(probes, len(sample))):
        order = np.zeros((len(at), size), np.int64)
        for n, (t, leaf) in enumerate(forest.search(sample[i], len(at) * size)):
            order[t, leaf] = n + 1
        d = distances(sample[i : i + 1], sample)[0]
        d[i] = np.inf
        seen.append(order[np.arange(len(at))[:, None], at[:, np.argsort(d)[:k]]].min(axis=0))
    found = np.sort(np.concatenate(seen))
    return int(found[max(0, int(np.ceil(recall * len(found))) - 1)])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: no null, zero, ragged or non-finite vectors, no null ids; each row once.

    Ragged are vectors of another length than most (of equally frequent lengths the smallest).
    """
    v = column(vectors, vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(column(vectors, id_col).cast("long").alias("vec_id"), v.alias("v"))
    rows = materialise(rows.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull() & fine & F.exists("v", lambda x: x != 0)).distinct(), "vectors")
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (top["n"] if top else 0))


def _matrix(vectors: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = vectors.combine_chunks().flatten() if isinstance(vectors, pa.ChunkedArray) else vectors.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dims)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of all q to all x in double precision, squares summed in the order of the components."""
    total = np.zeros((len(q), len(x)))
    for d in range(q.shape[1]):
        total += np.square(q[:, d, None] - x[None, :, d])
    return np.sqrt(total)


def neighbours(
    vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding",
    trees: int = TREES, leaf: int = LEAF, recall: float = RECALL, sample: int = SAMPLE, block: int = BLOCK, asked_rows: int = ASKED,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found for each row whose id is divisible by ``every``.

    Candidates are all rows but those with the query's id. Of equal vectors the ``k`` + 1 smallest ids are enough, so
    copies never crowd a leaf; the candidates and the queries of a leaf that is large all the same are dealt out in
    blocks. All candidates, if there are fewer than ``k``. Empty table: empty result.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    base = materialise(first.select("vec_id", "v"), "candidates")
    n = base.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    drawn = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    points, names = np.array(drawn["v"].tolist(), np.float64), drawn["vec_id"].to_numpy()
    dims = points.shape[1]
    depth = max(0, min(int(np.ceil(np.log2(max(1, n / leaf)))), int(np.log2(max(1, len(points) / 4)))))
    fitted = Forest(points, trees, depth)
    visits = visits_needed(fitted, points, k, recall)
    forest = spark.sparkContext.broadcast(fitted)  # at most sample / 4 nodes a tree
    sampled = spark.sparkContext.broadcast((names, points, fitted.leaves(points)))  # at most ``sample`` vectors

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            at = forest.value.leaves(x)
            for t in range(len(at)):
                keys = pa.array(t * 2**depth + at[t])
                yield pa.RecordBatch.from_arrays([keys, batch.column(0), batch.column(1), pa.array(np.zeros(len(x)))], ["leaf", "id", "v", "bound"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                asked_by, q = part.column(0).to_numpy(), _matrix(part.column(1), dims)
                found = [forest.value.search(x, visits, held.value, k + 1) for x in q]
                # Sampled rows in the visited leaves are found there again: nothing beyond the k-th of them matters.
                bound = np.full(len(q), np.inf)
                own, points_, at_leaf = sampled.value
                for i, visited in enumerate(found):
                    open_ = np.zeros((len(at_leaf), 2**depth), bool)
                    open_[tuple(zip(*visited))] = True
                    near = open_[np.arange(len(at_leaf))[:, None], at_leaf].any(axis=0) & (own != asked_by[i])
                    if near.sum() >= k:
                        bound[i] = np.partition(distances(q[i : i + 1], points_[near])[0], k - 1)[k - 1]
                owner = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                keys = pa.array([t * 2**depth + leaf_ for f in found for t, leaf_ in f], pa.int64())
                yield pa.RecordBatch.from_arrays([keys, part.column(0).take(owner), part.column(1).take(owner), pa.array(bound).take(owner)], ["leaf", "id", "v", "bound"])

    placed = base.mapInArrow(place, "leaf long, id long, v array<double>, bound double")
    sizes = np.zeros(trees * 2**depth, np.int64)
    for r in placed.groupBy("leaf").count().collect():  # a number for each leaf
        sizes[r["leaf"]] = r["count"]
    held = spark.sparkContext.broadcast(sizes.reshape(trees, -1))
    queries = rows.where(F.col("vec_id") % every == 0)
    asked = queries.mapInArrow(ask, "leaf long, id long, v array<double>, bound double")
    # Candidates of a leaf by ``block``, and its queries by ``asked_rows`` if they spread evenly; all pairs of parts meet.
    blocks, parts = np.maximum(1, -(-sizes // block)), int(queries.count() * visits / (trees * 2**depth)) // asked_rows + 1
    large = spark.createDataFrame([(int(i), int(blocks[i])) for i in np.flatnonzero(blocks > 1)], "leaf long, blocks int")
    if (blocks > 1).any() or parts > 1:
        count = F.coalesce("blocks", F.lit(1))
        part = lambda own, other: (own * parts + other).cast("int")
        placed = placed.join(F.broadcast(large), "leaf", "left").withColumn("own", F.pmod(F.xxhash64("id"), count)).drop("blocks")
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("part", part(F.col("own"), F.col("other")))
        asked = asked.join(F.broadcast(large), "leaf", "left").withColumn("own", F.explode(F.sequence(F.lit(0), count - 1)))
        asked = asked.withColumn("part", part(F.col("own"), F.pmod(F.xxhash64("id"), F.lit(parts))))
    else:
        placed, asked = placed.withColumn("part", F.lit(0)), asked.withColumn("part", F.lit(0))
    key = (F.col("leaf") * F.lit(1 << 20) + F.col("part")).alias("key")
    both = asked.select(key, F.lit(0).alias("side"), "id", "v", "bound").unionByName(placed.select(key, F.lit(1).alias("side"), "id", "v", "bound"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_by_run(batches, "key"):
            keys, side, ids, bound = (table.column(c).to_numpy() for c in ("key", "side", "id", "bound"))
            x = _matrix(table.column("v"), dims)
            bounds = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            out: list[tuple] = []
            for a, b in zip(bounds, bounds[1:]):
                cut = a + int(np.searchsorted(side[a:b], 1))
                own = ids[cut:b]
                for lo in range(a, cut, 512):
                    hi = min(cut, lo + 512)
                    if cut == b:
                        break
                    d = distances(x[lo:hi], x[cut:b])
                    d[ids[lo:hi, None] == own[None, :]] = np.inf
                    for i, row in enumerate(d):
                        best = np.lexsort((own, row))[:k]
                        best = best[np.isfinite(row[best]) & (row[best] <= bound[lo + i])]
                        out.append((np.full(len(best), ids[lo + i]), own[best], row[best]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], ["query_id", "vec_id", "score"])

    near = both.repartition("key").sortWithinPartitions("key", "side", "id").mapInArrow(compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
