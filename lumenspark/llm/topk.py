"""Exact top-k inner products by dual-tree search over cover trees.

Queries and candidates are dealt into blocks by a hash of their ids. A task gets one block of each and indexes both in a
cover tree. Each node has a centre and the covering radius of all its points. Its children are the next level: their centres
are a net of the node's points (its own centre among them) with a scale of its own, no larger than the node's, so that

* covering: every point lies within the scale of its child's centre, and
* separation: the children's centres lie at least the scale apart.

Unlike in a textbook cover tree the scale of the next level is not a fixed share of the last one but what ``FAN`` centres,
each the farthest from those before, reach: in many dimensions halving a radius would make every point a child.

The search descends both trees together. For a pair of nodes with centres a, b and radii r, s no inner product exceeds
``a.b + r |b| + s |a| + r s``; a pair is left out when that is below the worst k-th score of the query group. What is left
meets in exact integer products. Points that are equal form a leaf of radius 0, in which only the k + 1 smallest ids can ever
be results. Bounds cross blocks: each query first meets one block of candidates, and its k-th score there is where its search
of all other blocks starts. Each task returns at most k rows a query, and a window over these few rows ends the search.

Scores are integers. Up to 2^52 they are computed in exact double arithmetic, above in 64-bit arithmetic; components are held
to 2^62 and scores beyond 2^63 wrap, as the result's type has no room for them.

Scale: every block of queries meets every block of candidates, so vectors are shuffled once for each block of the other side;
bounds prune little on vectors without structure.

Edge cases: vectors that are null or hold null or non-finite components take no part (and give no rows as queries); vectors
of different length are never compared; equal rows among the queries are one query; the query's own id is no candidate,
however often it occurs; with fewer candidates than k all are returned; ties go to the smaller id, repeated rows count each;
ids are integers (others raise), rows without one take no part; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspark.llm.shared import keep

LEAF = 256
FAN = 16
QUERY_BLOCK = 4096
ROW_BLOCK = 8192


class Node:
    __slots__ = ("centre", "radius", "norm", "points", "scale", "children", "worst")

    def __init__(self, centre, radius, points, scale=0.0, children=()):
        self.centre, self.radius, self.points, self.scale, self.children = centre, radius, points, scale, children
        self.norm = float(np.sqrt(centre @ centre))
        self.worst = -math.inf


def build(x: np.ndarray, points: np.ndarray | None = None, at: int | None = None) -> Node:
    """Cover tree of the rows of ``x``; ``points`` in ascending order, ``at`` the centre among them."""
    points = np.arange(len(x)) if points is None else points
    centre = x[points[0] if at is None else at]
    far = np.sqrt(((x[points] - centre) ** 2).sum(1))
    radius = float(far.max()) * (1 + 1e-12)
    if len(points) <= LEAF or radius == 0:
        return Node(centre, radius, points)
    owner, nearest = np.zeros(len(points), np.int64), far
    chosen = [int(np.flatnonzero(points == (points[0] if at is None else at))[0])]
    while (n := len(chosen)) < FAN and nearest.max() > 0:
        new = int(nearest.argmax())
        chosen.append(new)
        d = np.sqrt(((x[points] - x[points[new]]) ** 2).sum(1))
        closer = d < nearest
        owner[closer], nearest = n, np.where(closer, d, nearest)
    # Farthest-first: the last centre was as far from the others as any, so what is left is covered at a smaller distance.
    return Node(centre, radius, points, float(nearest.max()), [build(x, points[owner == i], points[c]) for i, c in enumerate(chosen)])


class Search:
    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        order = np.lexsort((row_ids,))
        self.rows, self.row_ids = rows[order], row_ids[order]
        self.queries, self.query_ids, self.k = queries, query_ids, k
        self.q, self.x = queries.astype(np.float64), self.rows.astype(np.float64)
        largest = np.sqrt((self.q**2).sum(1).max()) * np.sqrt((self.x**2).sum(1).max())
        self.exact, self.slack = largest < 2.0**52, 1e-9 * largest + 0.5
        kind = np.float64 if self.exact else np.int64
        self.none = kind(-np.inf) if self.exact else np.iinfo(np.int64).min
        self.score = np.full((len(queries), k), self.none, kind)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max, np.int64)
        #: A score that each query's results must reach.
        self.floor = np.full(len(queries), self.none, kind) if floor is None else floor.astype(kind)
        self.pairs = 0

    def run(self) -> None:
        queries = build(self.q)
        self.start(queries)
        self.visit(queries, build(self.x))

    def start(self, query: Node) -> None:
        for child in query.children:
            self.start(child)
        query.worst = float(self.floor[query.points].min()) if (self.floor[query.points] > self.none).all() else -math.inf

    @staticmethod
    def bounds(a: list[Node], b: list[Node]) -> np.ndarray:
        ca, cb = np.stack([n.centre for n in a]), np.stack([n.centre for n in b])
        ra, rb = np.array([n.radius for n in a])[:, None], np.array([n.radius for n in b])[None]
        na, nb = np.array([n.norm for n in a])[:, None], np.array([n.norm for n in b])[None]
        return ca @ cb.T + ra * nb + rb * na + ra * rb

    def visit(self, query: Node, row: Node) -> None:
        if not query.children and not row.children:
            self.compare(query, row)
            return
        mine = query.children or [query]
        theirs = row.children or [row]
        bound = self.bounds(mine, theirs) + self.slack
        for i, a in enumerate(mine):
            for j in np.argsort(-bound[i], kind="stable").tolist():
                if bound[i, j] < a.worst:
                    break
                self.visit(a, theirs[j])
        if query.children:
            query.worst = min(a.worst for a in query.children)

    def compare(self, query: Node, row: Node) -> None:
        """Products of two leaves. Only those that reach a query's k-th score so far are sorted into its results."""
        self.pairs += 1
        rows = row.points[: self.k + 1] if row.radius == 0 and self.distinct else row.points
        q, k = query.points, self.k
        got = self.q[q] @ self.x[rows].T if self.exact else self.queries[q] @ self.rows[rows].T
        ids = self.row_ids[rows]  # ascending
        lo, hi = np.searchsorted(ids, self.query_ids[q], "left"), np.searchsorted(ids, self.query_ids[q], "right")
        for i in np.flatnonzero(lo < hi).tolist():
            got[i, lo[i] : hi[i]] = self.none
        passes = (got >= np.maximum(self.score[q, -1], self.floor[q])[:, None]) & (got > self.none)
        many = np.flatnonzero(passes.sum(1) > 2 * k)
        if len(many) and got.shape[1] > k:  # all that tie with the leaf's own k-th stay
            passes[many] &= got[many] >= np.partition(got[many], got.shape[1] - k, axis=1)[:, got.shape[1] - k][:, None]
        r, c = np.nonzero(passes)
        if not len(r):
            return
        touched = np.unique(r)
        old = np.repeat(touched, k)
        at = q[touched]
        owner = np.concatenate((old, r))
        score = np.concatenate((self.score[at].ravel(), got[r, c]))
        found = np.concatenate((self.found[at].ravel(), ids[c]))
        order = np.lexsort((found, -score if self.exact else ~score, owner))
        begin = np.searchsorted(owner[order], touched)
        take = order[(begin[:, None] + np.arange(k)[None]).ravel()]
        self.score[at], self.found[at] = score[take].reshape(-1, k), found[take].reshape(-1, k)
        reached = np.maximum(self.score[q, -1], self.floor[q])
        query.worst = float(reached.min()) if (reached > self.none).all() else -math.inf

    @property
    def distinct(self) -> bool:
        """Whether ids are distinct: a query's own id then costs one place among equal points."""
        if not hasattr(self, "_distinct"):
            self._distinct = len(np.unique(self.row_ids)) == len(self.row_ids)
        return self._distinct


def _integers(column: pa.Array) -> list[np.ndarray | None]:
    """floor(64 x) of each usable vector."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out: list[np.ndarray | None] = []
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) if len(flat) else np.empty(0)
    at = 0
    lengths = [0 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()]
    for valid, n in zip(column.is_valid().to_pylist(), lengths, strict=True):
        v = values[at : at + n]
        at += n
        out.append(np.clip(np.floor(64 * v), -(2.0**62), 2.0**62).astype(np.int64) if valid and np.isfinite(v).all() else None)
    return out


def _prepare(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            vectors = _integers(batch.column(1))
            use = [i for i, v in enumerate(vectors) if v is not None]
            blobs = pa.array([vectors[i].tobytes() for i in use], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(use, pa.int64())), blobs, pa.array([len(vectors[i]) for i in use], pa.int32())], names=["id", "v", "dim"])

    return df.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).mapInArrow(run, "id long, v binary, dim int")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products over ``rows``."""
    q, x = _prepare(queries, id_column, vector_column).dropDuplicates(["id", "v"]), _prepare(rows, id_column, vector_column)
    n_q, n_x = queries.count(), rows.count()
    q_blocks, x_blocks = max(1, math.ceil(n_q / query_block)), max(1, math.ceil(n_x / row_block))
    block = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("qb", block(1, q_blocks)).withColumn("xb", each(x_blocks))
    right = x.withColumn("xb", block(2, x_blocks)).withColumn("qb", each(q_blocks))

    def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
        def matrix(t: pa.Table) -> np.ndarray:
            if not t["dim"][0].as_py():
                return np.zeros((t.num_rows, 1), np.int64)
            return np.frombuffer(b"".join(t["v"].to_pylist()), np.int64).reshape(t.num_rows, -1)

        out: list[tuple] = []
        if a.num_rows and b.num_rows:
            lowest = np.iinfo(np.int64).min
            floor = a["floor"].combine_chunks().fill_null(lowest).to_numpy()
            s = Search(matrix(a), a["id"].to_numpy(), matrix(b), b["id"].to_numpy(), k)
            s.floor = np.where(floor > lowest, floor.astype(s.score.dtype), s.none)
            s.run()
            ok = s.score > s.none
            out = [np.repeat(s.query_ids, k)[ok.ravel()], s.found.ravel()[ok.ravel()], s.score.ravel()[ok.ravel()].astype(np.int64)]
        return pa.table({n: pa.array(out[i] if len(out) else [], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

    def search(a: DataFrame, b: DataFrame) -> DataFrame:
        keys = ["dim", "qb", "xb"]
        return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")

    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    none = F.lit(None).cast("long").alias("floor")
    if x_blocks == 1:
        found = search(left.select("*", none), right)
    else:
        home = F.col("xb") == F.pmod(F.col("qb"), F.lit(x_blocks))
        first = keep(search(left.where(home).select("*", none), right.where(home)).withColumn("rank", ranked).where(F.col("rank") <= k).drop("rank"))
        floors = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        found = first.union(search(left.where(~home).join(floors, "id", "left"), right.where(~home)))
    return found.withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
