"""Nearest neighbours by inner product: vantage-point trees over shards, with relaxed triangle-inequality pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dosewise.llm.common import saved, small_or_shuffled

#: Vectors of a shard, of a leaf, and of a block of queries.
SHARD_ROWS = 16384
LEAF_ROWS = 64
BLOCK_ROWS = 1024
#: Prunes a subtree whose bound, times this, is beyond the k-th distance; 1 is exact.
FACTOR = 1.5


# ---------------------------------------------------------------- trees


class Tree:
    """A vantage-point tree: a node is (pivot row, low and high distance of both halves, halves), a leaf the number of its rows in `leaves`.

    Inner products are distances here: with one more component, sqrt(top**2 - |x|**2) for rows and 0 for queries,
    |q - x|**2 = |q|**2 + top**2 - 2 q.x, and the triangle inequality holds.
    """

    def __init__(self, rows: np.ndarray, top: float, leaf: int = LEAF_ROWS, ids: np.ndarray | None = None):
        self.rows, self.top = rows, top
        self.ids = np.arange(len(rows)) if ids is None else ids
        self.lifted = np.column_stack([rows, np.sqrt(np.maximum(top * top - (rows * rows).sum(axis=1), 0))])
        self.leaf, self.rng = leaf, np.random.default_rng(len(rows))
        self.leaves: list[np.ndarray] = []
        self.root = self._grow(np.arange(len(rows)))

    def _grow(self, at: np.ndarray):
        if len(at) <= self.leaf:
            self.leaves.append(at)
            return len(self.leaves) - 1
        pivot = at[self.rng.integers(len(at))]
        far = np.sqrt(np.maximum(((self.lifted[at] - self.lifted[pivot]) ** 2).sum(axis=1), 0))
        order = np.argsort(far, kind="stable")
        half = len(at) // 2
        near, rest = order[:half], order[half:]
        return pivot, (far[near[0]], far[near[-1]]), (far[rest[0]], far[rest[-1]]), self._grow(at[near]), self._grow(at[rest])

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """For each query, k rows of largest inner product (fewer: row -1), found under the factor, and the products; ties to smaller ids."""
        score, row = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1)
        least = np.full(len(queries), -np.inf)  # the k-th product so far
        # all rows are lifted to one length, so a distance needs a product alone; slack covers its rounding
        base, slack = (queries * queries).sum(axis=1) + self.top * self.top, 1e-7 * self.top
        # products that differ by rounding alone are ties
        unit = np.maximum(1e-14 * self.top * np.sqrt((queries * queries).sum(axis=1)), 1e-300)

        home = np.full(len(queries), -1)  # the leaf that each query saw first

        def take(leaf: int, some: np.ndarray) -> None:
            at = self.leaves[leaf]
            new = queries[some] @ self.rows[at].T
            better = new.max(axis=1, initial=-np.inf) >= least[some] - unit[some]
            some, new = some[better], new[better]
            s = np.concatenate([score[some], new], axis=1)
            r = np.concatenate([row[some], np.broadcast_to(at, new.shape)], axis=1)
            best = np.lexsort((self.ids[r], -np.rint(s / unit[some, None])), axis=1)[:, :k]
            score[some], row[some] = np.take_along_axis(s, best, 1), np.take_along_axis(r, best, 1)
            least[some] = score[some].min(axis=1)

        def bounds(node, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Least distances to both halves."""
            d = np.sqrt(np.maximum(base[some] - 2 * (queries[some] @ self.rows[node[0]]), 0))
            return tuple(np.maximum(np.maximum(low - d, d - high), 0) for low, high in node[1:3])

        def descend(node, some: np.ndarray) -> None:
            """Every query to the leaf on its side of all pivots, which gives it a k-th product to prune by."""
            if isinstance(node, int):
                home[some] = node
                take(node, some)
            elif len(some):
                near, far = bounds(node, some)
                descend(node[3], some[near <= far])
                descend(node[4], some[near > far])

        def visit(node, some: np.ndarray) -> None:
            """Each node once, with all queries that its bound leaves."""
            if isinstance(node, int):
                take(node, some[home[some] != node])
            elif len(some):
                for bound, child in zip(bounds(node, some), node[3:], strict=True):
                    reach = np.sqrt(np.maximum(base[some] - 2 * least[some], 0))  # infinite until k rows are found
                    visit(child, some[factor * (bound - slack) <= reach + slack])

        descend(self.root, np.arange(len(queries)))
        visit(self.root, np.arange(len(queries)))
        return row, score


# ---------------------------------------------------------------- search


def _usable(vector):
    x = F.col("v")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda c: c != 0), F.lit(False))


def _packed(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _pack(table: pa.Table) -> pa.Table:
    """One row of a block or shard: ids (a list a vector), all vectors as bytes, and how many shards and what greatest length all of this dimension have."""
    ids = table["ids"].combine_chunks()
    return pa.table({**{c: table[c][:1] for c in ("dim", "part", "shards", "top")}, "ids": pa.array([ids.to_pylist()], pa.list_(pa.list_(pa.int64()))), "v": pa.array([_packed(table["v"]).tobytes()], pa.binary())})


def _searcher(k: int, factor: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, tree = None, None
        for batch in batches:
            for dim, part, top, ids, v, query_ids, q in zip(*(batch[c].to_pylist() for c in ("dim", "part", "top", "ids", "v", "query_ids", "q")), strict=True):
                if kept != (dim, part):
                    rows = np.frombuffer(v).reshape(-1, dim)
                    kept, tree = (dim, part), Tree(rows, top, ids=np.array([x[0] for x in ids]))
                queries = np.frombuffer(q).reshape(-1, dim)
                found, _ = tree.search(queries, min(k + 5, len(tree.rows)), factor)  # some to spare, for ties among rounded products
                out_q, out_v, out_s = [], [], []
                for i, rows in enumerate(found):
                    rows = rows[rows >= 0]
                    exact = (tree.rows[rows] * queries[i]).sum(axis=1)
                    own = query_ids[i][0]
                    hits = sorted((-s, x) for s, r in zip(exact.tolist(), rows.tolist(), strict=True) for x in ids[r] if x != own)[:k]
                    out_q += [own] * len(hits)
                    out_v += [x for _, x in hits]
                    out_s += [-s for s, _ in hits]
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    return search


def nearest(vectors: DataFrame, is_query, id: str = "vec_id", vector: str = "embedding", k: int = 20, factor: float = FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that meets `is_query`, its k nearest other rows by inner product
    in double precision, largest first, ties to smaller ids; all other rows where there are fewer than k.

    Every row is indexed. Equal vectors share one place in the index with their k + 1 smallest ids, of which no
    list of k can need more; so a vector that very many rows hold costs no more than others. Each shard of about
    shard_rows vectors has one tree, and every block of queries visits every shard; lists are merged per query.
    `factor` above 1 trades recall for time; 1 is exact. Vectors that are null, zero, empty or hold a null, NaN or infinity take no part, nor
    does a null id; vectors of different lengths never meet; repeated rows of one id and vector count once, an id with two vectors as both.
    An empty table gives an empty result.
    """
    rows = vectors.where(is_query.isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("ask"))
    rows = saved(rows.where(F.col("id").isNotNull() & _usable(F.col("v"))).withColumn("dim", F.size("v")), "vectors")
    longest = F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"), F.greatest(F.ceil(F.sum(F.col("ask").cast("int")) / BLOCK_ROWS), F.lit(1)).cast("int").alias("blocks"), (F.sqrt(longest) * (1 + 1e-9)).alias("top"))
    sizes = small_or_shuffled(saved(sizes, "dims"))

    smallest = W.partitionBy("v").orderBy("id")
    distinct = rows.select("dim", "v", "id").withColumn("r", F.dense_rank().over(smallest)).where(F.col("r") <= k + 1)
    distinct = distinct.groupBy("dim", "v").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    packed = "dim int, part int, shards int, top double, ids array<array<bigint>>, v binary"
    index = distinct.join(sizes, "dim").withColumn("part", F.pmod(F.xxhash64("v"), "shards").cast("int")).groupBy("dim", "part").applyInArrow(_pack, packed)
    asked = rows.where("ask").select("dim", "v", F.array("id").alias("ids")).distinct()
    asked = asked.join(sizes, "dim").withColumn("part", F.pmod(F.xxhash64("ids", "v"), "blocks").cast("int")).groupBy("dim", "part").applyInArrow(_pack, packed)
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("part"), F.col("ids").alias("query_ids"), F.col("v").alias("q"))
    both = saved(index, "index").join(asked.hint("merge"), ["dim", "part"])
    lists = both.mapInArrow(_searcher(k, factor), "query_id long, vec_id long, score double").distinct()
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
