"""Approximate nearest neighbours by collision counting on sorted projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20
#: Projections, half width of a window in units of the radius, share of the projections that
#: must collide, growth of the radius, vectors of a block, queries of a group.
PROJECTIONS = 48
WIDTH = 1.0
SHARE = 0.58
GROWTH = 1.2
BLOCK = 8192
GROUP = 2048


class Projections:
    """Sorted projections of a block of vectors, ready for collision counting.

    Vectors are scaled by the block's longest and lifted to the unit sphere, so the largest
    inner product is the least distance from the query's direction.
    """

    def __init__(self, vectors: np.ndarray, projections: int = PROJECTIONS, seed: int = 11):
        self.vectors = np.ascontiguousarray(vectors, dtype=np.float64)
        norms = np.sqrt((self.vectors**2).sum(axis=1))
        self.longest = norms.max()
        unit = self.vectors / self.longest
        lift = np.sqrt(np.maximum(0.0, 1 - (unit**2).sum(axis=1)))
        self.points = np.concatenate([unit, lift[:, None]], axis=1)
        rng = np.random.default_rng(seed)
        self.axes = rng.standard_normal((self.points.shape[1], projections))
        projected = self.points @ self.axes
        lines = projected.T.copy()
        self.order = np.argsort(lines, axis=1, kind="stable")
        self.sorted = np.take_along_axis(lines, self.order, axis=1)
        # The first windows around the middle hold a quarter of the vectors.
        self.first = max(1e-6, float(np.quantile(np.abs(projected), 0.25)))

    def search(
        self,
        queries: np.ndarray,
        skip: np.ndarray,
        ids: np.ndarray,
        k: int,
        width: float = WIDTH,
        share: float = SHARE,
        growth: float = GROWTH,
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (places, inner products) of the k nearest found, nearest first, ties
        by id; vectors with the query's id in ``skip`` are left out.

        The radius grows (virtual rehashing) and with it the window around the query in each
        sorted projection; a vector's count is the number of windows it has entered. Vectors
        with enough collisions are verified by their inner product. A query's search ends
        when k verified ones lie within the radius, or when all vectors have been verified.
        A wider first window verifies more vectors than a narrow one, never fewer.
        """
        queries = np.asarray(queries, dtype=np.float64)
        norms = np.sqrt((queries**2).sum(axis=1))
        m, n = self.order.shape
        targets = (queries / norms[:, None]) @ self.axes[:-1]
        need = int(np.ceil(share * m))
        slack = 1e-9 * norms * self.longest  # beyond what rounding changes
        low = np.stack([np.searchsorted(s, t) for s, t in zip(self.sorted, targets.T, strict=True)], axis=1)
        high = low.copy()
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0))] * len(queries)
        counts = np.zeros((len(queries), n), dtype=np.int16)
        live, radius, ends = np.arange(len(queries)), self.first / width, []
        while len(live):
            half = radius * width
            lower, upper = low[live], high[live]
            for j, line in enumerate(self.sorted):
                lower[:, j] = np.searchsorted(line, targets[live, j] - half, "left")
                upper[:, j] = np.searchsorted(line, targets[live, j] + half, "right")
            open_ = np.ones(len(live), dtype=bool)
            for i, q in enumerate(live.tolist()):
                rings = [r[a:b] for r, a, b in zip(self.order, lower[i], low[q], strict=True)]
                rings += [r[a:b] for r, a, b in zip(self.order, high[q], upper[i], strict=True)]
                before = counts[q]
                now = before + np.bincount(np.concatenate(rings), minlength=n)
                whole = bool((lower[i] == 0).all() and (upper[i] == n).all())
                new = np.flatnonzero((before < need) & (now >= need))
                counts[q] = now
                new = new[ids[new] != skip[q]]
                places, scores = found[q]
                if len(new):
                    products = self.vectors[new] @ queries[q]
                    if len(places) == k:
                        new = new[products >= scores[-1] - slack[q]]
                    elif len(new) > k:
                        least = np.partition(products, -k)[-k]
                        new = new[products >= least - slack[q]]
                    # Row sums, so equal vectors have equal products wherever they stand.
                    products = (self.vectors[new] * queries[q]).sum(axis=1)
                    places, scores = np.concatenate([places, new]), np.concatenate([scores, products])
                    best = np.lexsort((ids[places], -scores))[:k]
                    found[q] = places, scores = places[best], scores[best]
                if whole:
                    open_[i] = False
                elif len(places) == k:
                    cosine = scores[-1] / (norms[q] * self.longest)
                    open_[i] = np.sqrt(max(0.0, 2 - 2 * cosine)) > radius
            low[live], high[live] = lower, upper
            live = live[open_]
            ends += [radius] * int((~open_).sum())
            radius *= growth
        # The next queries begin shortly before the radius that most of these needed.
        if ends:
            self.first = max(self.first, float(np.quantile(ends, 0.1)) * width / growth)
        return found


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame,
    queries: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = K,
    projections: int = PROJECTIONS,
    block: int = BLOCK,
    group: int = GROUP,
) -> DataFrame:
    """(query_id, rank, id, score): for each vector that ``queries`` holds for, the k others
    found with the largest inner products, in double precision on the vectors as they are.

    Vectors are dealt into blocks of about ``block`` by a hash of their id, queries into
    groups; each block meets each group once, as a task's group of bounded size, and searches
    it by collision counting. The best k of each block meet in a ranking, of which no task
    before the shuffle sends more than k a query.

    Unusable vectors (null, zero, or with null or non-finite components) and null ids take
    no part. Of several rows with one id the least vector counts. Vectors of different
    length never meet. Fewer candidates than k are all returned; ties go to the smaller id.
    """
    column = F.col(f"`{vector_column}`")
    key = F.col(f"`{id_column}`").cast("long")
    rows = (
        vectors.where(usable(column) & key.isNotNull())
        .select(key.alias("id"), column.cast("array<double>").alias("v"), queries.alias("q"))
        .groupBy("id")
        .agg(F.min("v").alias("v"), F.max("q").alias("q"))
        .withColumn("dim", F.size("v"))
    )
    # One row for each length of the vectors: how many blocks and groups it takes.
    sizes = rows.groupBy("dim").agg(
        F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"),
        F.greatest(F.ceil(F.count_if("q") / group), F.lit(1)).cast("int").alias("groups"),
    )
    rows = rows.join(F.broadcast(sizes), "dim")
    b = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    g = F.pmod(F.xxhash64("id", F.lit("query")), F.col("groups")).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    index = rows.select("dim", b.alias("b"), F.explode(each("groups")).alias("g"), "id", "v")
    asked = rows.where("q").select("dim", F.explode(each("blocks")).alias("b"), g.alias("g"), "id", "v")

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "id": [], "score": []})]
        rows = rows.sort_values("id")
        left, right = rows[~rows["asked"]], rows[rows["asked"]]
        if len(left) and len(right):
            ids, own = left["id"].to_numpy(), right["id"].to_numpy()
            found = Projections(np.stack(left["v"].to_numpy()), projections)
            # Counts of one batch of queries are held at a time, the first a small one.
            for at in [0, *range(16, len(right), 128)]:
                part = slice(at, at + 128 if at else 16)
                results = found.search(np.stack(right["v"].to_numpy()[part]), own[part], ids, k)
                for q, (places, scores) in zip(own[part], results, strict=True):
                    out.append(pd.DataFrame({"query_id": q, "id": ids[places], "score": scores}))
        return pd.concat(out)

    both = index.withColumn("asked", F.lit(False)).unionByName(asked.withColumn("asked", F.lit(True)))
    local = both.groupBy("dim", "b", "g").applyInPandas(
        meet, "query_id long, id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        local.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_column), "score")
    )
