"""Approximate nearest neighbours by learned partitions.

On a bounded sample: a neighbour graph, cut into balanced parts that sever few of its edges; then a
small classifier learns the part of a vector. It indexes every vector under its most probable part and
routes a query to its most probable parts, as many as held-out queries of the sample need for the asked
recall. Parts are searched in blocks of bounded size, so a part that a common vector floods is many
tasks; distances are exact, on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import saved

SAMPLE = 4096  # rows that the index is fitted on, at most
PART_ROWS = 64  # vectors a part should hold while there are few parts
MOST_PARTS = 128
RECALL = 0.97  # asked of held-out queries of the sample
BLOCK = 4096  # vectors, or queries, that one task compares at once


def _nearest(x: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k nearest rows of x to each row of queries, which are rows of x themselves."""
    norms, out = (x**2).sum(axis=1), []
    for part in range(0, len(queries), 64):
        at = queries[part : part + 64]
        far = norms[None, :] - 2 * x[at] @ x.T
        far[np.arange(len(at)), at] = np.inf
        out.append(np.argpartition(far, min(k, len(x) - 1) - 1, axis=1)[:, :k])
    return np.concatenate(out)


def _bisect(nodes: np.ndarray, x: np.ndarray, graph: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of the nodes with few graph edges between them: a median cut, then swaps of equal numbers."""
    centred = x[nodes] - x[nodes].mean(axis=0)
    axis = np.linalg.svd(centred.T @ centred)[0][:, 0]
    side = np.zeros(len(nodes), bool)
    side[np.argsort(centred @ axis, kind="stable")[len(nodes) // 2 :]] = True
    place = np.full(len(x), -1)
    place[nodes] = np.arange(len(nodes))
    a = np.repeat(np.arange(len(nodes)), graph.shape[1])
    b = place[graph[nodes].ravel()]
    a, b = a[b >= 0], b[b >= 0]
    for _ in range(rounds):
        cut = np.where(side[a] != side[b], 1, -1)
        gain = np.bincount(a, cut, len(nodes)) + np.bincount(b, cut, len(nodes))
        zero, one = (np.flatnonzero(side == s) for s in (False, True))
        zero, one = (s[np.argsort(-gain[s], kind="stable")] for s in (zero, one))
        n = min(len(zero), len(one))
        n = int(((gain[zero[:n]] + gain[one[:n]]) > 0).sum()) // 2  # half of them: neighbours swap too
        if not n:
            break
        side[zero[:n]], side[one[:n]] = True, False
    return nodes[~side], nodes[side]


def _parted(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        groups = [half for g in groups for half in _bisect(g, x, graph)]
    label = np.zeros(len(x), np.int64)
    for k, g in enumerate(groups):
        label[g] = k
    return label


@dataclass
class Router:
    """One hidden layer; order(x) lists the parts of each vector, most probable first."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    @property
    def parts(self) -> int:
        return len(self.b2)

    def scores(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def order(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.scores(x), axis=1, kind="stable")


def _train(x: np.ndarray, label: np.ndarray, parts: int, hidden: int = 96, epochs: int = 30, seed: int = 7) -> Router:
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), float(x.std()) or 1.0
    z = (x - mean) / scale
    p = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(z)), max(1, len(z) // 256)):
            h = np.maximum(z[at] @ p[0] + p[1], 0)
            s = h @ p[2] + p[3]
            s = np.exp(s - s.max(axis=1, keepdims=True))
            s /= s.sum(axis=1, keepdims=True)
            s[np.arange(len(at)), label[at]] -= 1
            s /= len(at)
            back = (s @ p[2].T) * (h > 0)
            grads = [z[at].T @ back, back.sum(axis=0), h.T @ s, s.sum(axis=0)]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g**2
                p[i] = p[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Router(mean, scale, *p)


def fit(x: np.ndarray, rows: int, k: int = 10, recall: float = RECALL) -> Router:
    """A router for a table of `rows` vectors, from its sample x (double precision)."""
    parts = 1
    while parts < MOST_PARTS and rows > PART_ROWS * parts and len(x) >= 32 * parts:
        parts *= 2
    if parts == 1:
        d = x.shape[1] if x.ndim == 2 else 1
        return Router(np.zeros(d), 1.0, np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = _nearest(x, np.arange(len(x)), k)
    tested = np.arange(0, len(x), max(2, len(x) // 512))
    learnt = np.setdiff1d(np.arange(len(x)), tested)
    label = _parted(x, graph, parts)
    router = _train(x[learnt], label[learnt], parts)
    order = router.order(x)
    where = np.empty_like(order)  # where[i, p]: the place of part p in the order of i
    np.put_along_axis(where, order, np.arange(parts)[None, :].repeat(len(x), 0), axis=1)
    needed = where[tested[:, None], order[graph[tested], 0]]
    share = np.array([(needed < p).mean() for p in range(1, parts + 1)])
    router.probes = int(np.argmax(share >= recall)) + 1 if (share >= recall).any() else parts
    return router


def _vectors(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def usable(rows: DataFrame) -> DataFrame:
    """id, v of the rows that can take part: an id, a vector of the commonest length, finite and not zero."""
    v = F.col("embedding").cast("array<double>")
    ok = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ok)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (length[0] if length else 0))


def _route(router: Router, held: list[int], k: int, queries: bool):
    """Rows with their parts: the most probable for the index; for a query more, until they hold k others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.array(held or [0])
        for batch in batches:
            if not len(batch):
                continue
            order = router.order(_vectors(batch.column(1)))
            if queries:
                enough = np.argmax(np.cumsum(sizes[order], axis=1) > min(k, sizes.sum() - 1), axis=1) + 1
                parts = [o[: max(router.probes, n)] for o, n in zip(order, enough)]
            else:
                parts = list(order[:, :1])
            taken = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(taken)), batch.column(1).take(pa.array(taken)), pa.array(np.concatenate(parts).astype(np.int32))],
                names=["id", "v", "part"],
            )

    return run


def _search(k: int):
    def run(key, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        vectors = vectors.sort_values("id", kind="stable")
        ids, x, asked, q = vectors["id"].to_numpy(), np.stack(vectors["v"].to_numpy()), queries["id"].to_numpy(), np.stack(queries["v"].to_numpy())
        norms, found = (x**2).sum(axis=1), []
        for part in range(0, len(q), 256):
            block = q[part : part + 256]
            rough = norms[None, :] + (block**2).sum(axis=1)[:, None] - 2 * block @ x.T
            rough[asked[part : part + 256, None] == ids[None, :]] = np.inf  # however often its own id is there
            nth = min(k, len(x)) - 1
            limit = np.partition(rough, nth, axis=1)[:, nth]
            for i, (own, vector) in enumerate(zip(asked[part : part + 256], block)):
                near = np.flatnonzero(rough[i] <= limit[i] + 1e-9 * (1 + norms.max()))
                near = near[ids[near] != own]
                exact = np.sqrt(((x[near] - vector) ** 2).sum(axis=1))
                best = np.lexsort((ids[near], exact))[:k]
                found.append(pd.DataFrame({"query_id": own, "vec_id": ids[near[best]], "score": exact[best]}))
        return pd.concat(found)

    return run


def search(rows: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found to each row whose vec_id is divisible by `every`.

    All rows but the query's own id are candidates. Rows without an id, and vectors that are null, zero,
    hold a null or non-finite component or have another length than most, take no part. Ties go to the
    smaller vec_id. Fewer than k candidates: all. Rows that repeat an id and vector count once. Empty
    table: no rows. Other columns are ignored.
    """
    good = saved(usable(rows).dropDuplicates(["id", "v"]), "ann-rows")
    # the sample: the rows of smallest hash, as many as SAMPLE, whatever the size of the table
    sample = good.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    total = good.count()
    x = np.stack(sample["v"].to_numpy()) if len(sample) else np.zeros((0, 1))
    router = fit(x, total, k)
    index = saved(good.mapInArrow(_route(router, [], k, False), "id long, v array<double>, part int"), "ann-index")
    held = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}  # one row for each part
    sizes = [held.get(p, 0) for p in range(router.parts)]
    asked = index.filter(F.col("id") % every == 0).select("id", "v").dropDuplicates(["id", "v"])
    routed = saved(asked.mapInArrow(_route(router, sizes, k, True), "id long, v array<double>, part int"), "ann-queries")
    per_part = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}
    blocks = F.element_at(F.array(*[F.lit(max(1, -(-sizes[p] // BLOCK))) for p in range(router.parts)]), F.col("part") + 1)
    shares = F.element_at(F.array(*[F.lit(max(1, -(-per_part.get(p, 0) // BLOCK))) for p in range(router.parts)]), F.col("part") + 1)
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    vectors = index.join(F.broadcast(routed.select("part").distinct()), "part", "left_semi") if router.parts > 1 else index
    vectors = vectors.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("share", everywhere(shares))
    queries = routed.withColumn("share", F.pmod(F.xxhash64("id"), shares).cast("int")).withColumn("block", everywhere(blocks))
    keys = ["part", "block", "share"]
    found = vectors.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(_search(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
