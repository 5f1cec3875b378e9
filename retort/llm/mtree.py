"""Exact top-k by inner product: best-first search in paged M-trees.

Vectors get one more component that makes all as long as the longest, so the largest inner product
is the smallest distance, and the triangle inequality holds. Rows are dealt to pivots (a bounded
sample), each pivot's rows to trees of bounded size. A tree has pages of routing objects with covering
radii, and leaf pages; every entry keeps the distance to its page's routing object, so that most
entries are ruled out without computing their own distance. Queries first search their nearest
pivot, and then only the pivots whose radius can hold something as good as their k-th so far.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retort.llm.text import saved

MAX_PIVOTS = 1024
ROWS_PER_PIVOT = 4096
ROWS_PER_TREE = 8192
QUERIES_PER_BLOCK = 2048
PAGE = 256
#: Relative allowance for rounding in the distances; scores themselves are exact.
SLACK = 1e-9


def scaled(embedding: Column) -> Column:
    """floor(256 * x) of each component; null for vectors with a null or non-finite component."""
    good = embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(good, F.transform(embedding, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long")))


class Tree:
    """An M-tree over distinct integer vectors, loaded in bulk."""

    def __init__(self, vectors: np.ndarray, longest: float, seed: int = 1):
        self.rng = np.random.default_rng(seed)
        points = vectors.astype(np.float64)
        extra = np.sqrt(np.maximum(longest - (points**2).sum(1), 0.0))
        self.points = np.concatenate([points, extra[:, None]], 1)
        self.order = np.arange(len(points))
        #: per page: routing object, covering radius, distance to the page above, first and last child
        self.center, self.radius, self.above, self.first, self.last, self.leaf = [], [], [], [], [], []
        self.entry_above = np.zeros(len(points))
        self._page(int(self.rng.integers(len(points))), 0.0)
        todo = [(0, np.arange(len(points)))]
        parts = []
        placed = 0
        while todo:
            page, rows = todo.pop()
            own = np.linalg.norm(self.points[rows] - self.points[self.center[page]], axis=1)
            self.radius[page] = float(own.max())
            if len(rows) <= PAGE or self.radius[page] == 0.0:
                self.leaf[page], self.first[page], self.last[page] = True, placed, placed + len(rows)
                self.entry_above[rows] = own
                parts.append(rows)
                placed += len(rows)
                continue
            seeds = self.rng.choice(rows, min(PAGE, -(-len(rows) // PAGE) + 1), replace=False)
            near = self.points[rows] @ self.points[seeds].T - (self.points[seeds] ** 2).sum(1) / 2
            side = near.argmax(1)
            self.first[page] = len(self.center)
            for s in range(len(seeds)):
                inside = rows[side == s]
                if len(inside):
                    todo.append((len(self.center), inside))
                    self._page(int(seeds[s]), float(np.linalg.norm(self.points[seeds[s]] - self.points[self.center[page]])))
            self.last[page] = len(self.center)
            if self.last[page] - self.first[page] == 1:  # all on one side: nothing parts them
                todo.pop()
                for column in (self.center, self.radius, self.above, self.first, self.last, self.leaf):
                    column.pop()
                self.leaf[page], self.first[page], self.last[page] = True, placed, placed + len(rows)
                self.entry_above[rows] = own
                parts.append(rows)
                placed += len(rows)
        self.order = np.concatenate(parts)
        for name, kind in (("center", np.int64), ("radius", float), ("above", float), ("first", np.int64), ("last", np.int64), ("leaf", bool)):
            setattr(self, name, np.array(getattr(self, name), kind))

    def _page(self, center: int, above: float) -> None:
        for column, value in zip((self.center, self.radius, self.above, self.first, self.last, self.leaf), (center, 0.0, above, 0, 0, False), strict=True):
            column.append(value)

    def search(self, query: np.ndarray, reach, offer) -> int:
        """Offer row numbers to ``offer``, nearest pages first, while they can be within ``reach()``.

        Returns the number of distances computed.
        """
        q = np.append(query.astype(np.float64), 0.0)
        slack = SLACK * (1.0 + float(np.abs(q).max()) + float(self.points[0] @ self.points[0]) ** 0.5)
        start = float(np.linalg.norm(self.points[self.center[0]] - q))
        queue, computed = [(max(0.0, start - self.radius[0]), 0, start)], 1
        while queue:
            low, page, distance = heapq.heappop(queue)
            limit = reach() + slack
            if low > limit:
                break
            a, b = self.first[page], self.last[page]
            if self.leaf[page]:
                rows = self.order[a:b]
                rows = rows[np.abs(distance - self.entry_above[rows]) <= limit]
                if len(rows):
                    computed += len(rows)
                    offer(rows)
                continue
            pages = np.arange(a, b)
            pages = pages[np.abs(distance - self.above[pages]) - self.radius[pages] <= limit]
            own = np.linalg.norm(self.points[self.center[pages]] - q, axis=1)
            computed += len(pages)
            for p, d in zip(pages.tolist(), own.tolist(), strict=True):
                if (bound := max(0.0, d - self.radius[p])) <= limit:
                    heapq.heappush(queue, (bound, p, d))
        return computed


class _Best:
    """The k best of one query: highest score first, then smallest identifier."""

    def __init__(self, query: np.ndarray, own: int, k: int, longest: float, known: float | None):
        self.query, self.own, self.k = query, own, k
        self.base = float((query.astype(np.float64) ** 2).sum()) + longest
        self.known = -np.inf if known is None or np.isnan(known) else float(known)
        self.found: list[tuple[int, int]] = []

    def least(self) -> float:
        return max(self.known, -float(self.found[self.k - 1][0])) if len(self.found) >= self.k else self.known

    def reach(self) -> float:
        least = self.least()
        return np.inf if least == -np.inf else float(np.sqrt(max(0.0, self.base - 2 * least)))

    def offer(self, scores: np.ndarray, rows: np.ndarray, ids: list) -> None:
        """Take the rows that are good enough; ``ids``: the identifiers of each row of the tree."""
        good = np.flatnonzero(scores >= self.least())
        if len(good):
            for at in good:
                self.found.extend((-int(scores[at]), i) for i in ids[rows[at]] if i != self.own)
            self.found.sort()
            del self.found[self.k :]


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id, score: the k rows of highest inner product for every query row.

    ``vector_col`` has arrays of integers. A query's own identifier is left out; ties go to the
    smaller identifier. Rows with a null vector, an empty one, or a null identifier take no part, and
    vectors are compared with those of their own length. Repeated rows of a query give its answer
    once. Fewer candidates give fewer ranks, an empty table none; other columns are not read.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), is_query.alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0))
    rows = saved(rows.withColumn("dim", F.size("vector")), "mtree-rows")
    # of equal vectors the k + 1 smallest identifiers are all that any answer can need
    nth = F.row_number().over(Window.partitionBy("dim", "vector").orderBy("id"))
    few = rows.select("dim", "vector", "id").distinct().withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    points = saved(few.groupBy("dim", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), "mtree-points")
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    stats = points.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("longest")).collect()  # one row per length
    parts = []
    for stat in stats:
        dim, longest = stat["dim"], float(stat["longest"])
        own = points.filter(F.col("dim") == dim)
        asked = rows.filter(F.col("asks") & (F.col("dim") == dim)).select("id", "vector").distinct()
        parts.append(_search(spark, own, asked, stat["n"], longest, k))
    if not parts:
        return spark.createDataFrame([], f"query_id {rows.schema['id'].dataType.simpleString()}, rank int, id {rows.schema['id'].dataType.simpleString()}, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.distinct().withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _search(spark, points: DataFrame, asked: DataFrame, n: int, longest: float, k: int) -> DataFrame:
    count = int(min(MAX_PIVOTS, max(1, n // ROWS_PER_PIVOT)))
    sample = points.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(count).toPandas()  # MAX_PIVOTS rows at most
    pivots = np.array(sample["vector"].tolist(), np.float64)
    lifted = np.concatenate([pivots, np.sqrt(np.maximum(longest - (pivots**2).sum(1), 0))[:, None]], 1)
    half = (lifted**2).sum(1) / 2

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            x = np.array(frame["vector"].tolist(), np.float64).reshape(len(frame), -1)
            x = np.concatenate([x, np.sqrt(np.maximum(longest - (x**2).sum(1), 0))[:, None]], 1)
            pivot = (x @ lifted.T - half).argmax(1) if len(x) else np.zeros(0, int)
            distance = np.linalg.norm(x - lifted[pivot], axis=1)
            yield frame.assign(pivot=pivot.astype(np.int32), distance=distance)

    id_type = points.schema["ids"].dataType.elementType.simpleString()
    schema = f"vector array<bigint>, ids array<{id_type}>, pivot int, distance double"
    dealt = saved(points.select("vector", "ids").mapInPandas(nearest, schema), "mtree-dealt")
    sizes = dealt.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).toPandas()
    radius = np.full(count, -1.0)
    radius[sizes["pivot"]] = sizes["radius"]
    trees = np.ones(count, np.int64)
    trees[sizes["pivot"]] = -(-sizes["n"] // ROWS_PER_TREE)

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        vectors = np.array(frame["vector"].tolist(), np.int64)
        order = np.lexsort(vectors.T[::-1])  # the same tree whatever order the rows come in
        vectors, ids = vectors[order], [frame["ids"].iloc[i] for i in order]
        t = Tree(vectors, longest)
        ends = np.cumsum([len(i) for i in ids])
        tree = _pack(
            vectors=vectors, ids=np.concatenate(ids), ends=ends, order=t.order, center=t.center, radius=t.radius,
            above=t.above, first=t.first, last=t.last, leaf=t.leaf, entry_above=t.entry_above, points=t.points,
        )
        return pd.DataFrame({"pivot": [frame["pivot"].iloc[0]], "tree": [tree]})

    per_pivot = F.element_at(F.array(*[F.lit(int(t)) for t in trees]), F.col("pivot") + 1)
    part = F.pmod(F.xxhash64("vector"), per_pivot)
    index = saved(dealt.withColumn("part", part).groupBy("pivot", "part").applyInPandas(build, "pivot int, tree binary"), "mtree-index")
    blocks = -(-asked.count() // QUERIES_PER_BLOCK)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, blocks))))

    def routes(rest: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                q = np.array(frame["vector"].tolist(), np.float64).reshape(len(frame), -1)
                squared = (q**2).sum(1)
                distance = np.sqrt(np.maximum(squared[:, None] + longest - 2 * q @ pivots.T, 0)) if len(q) else np.zeros((0, count))
                filled = radius >= 0
                first = np.where(filled, distance, np.inf).argmin(1) if len(q) else np.zeros(0, int)
                if rest:
                    least = frame["least"].to_numpy(float)
                    reach = np.where(np.isnan(least), np.inf, np.sqrt(np.maximum(squared + longest - 2 * np.nan_to_num(least), 0)))
                    want = filled & (distance - radius <= reach[:, None] * (1 + 1e-9) + 1e-3)
                    want[np.arange(len(q)), first] = False
                else:
                    want = np.zeros(distance.shape, bool)
                    want[np.arange(len(q)), first] = True
                row, pivot = np.nonzero(want)
                yield frame.iloc[row].assign(pivot=pivot.astype(np.int32))

        return run

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for tree, queries in zip(frame["tree"], frame["queries"], strict=True):
                t = Tree.__new__(Tree)
                data = np.load(io.BytesIO(tree))
                for name in ("order", "center", "radius", "above", "first", "last", "leaf", "entry_above", "points"):
                    setattr(t, name, data[name])
                vectors, ids = data["vectors"], [i.tolist() for i in np.split(data["ids"], data["ends"][:-1])]
                # exact in floating point as long as no sum can pass 2**53
                top = float(np.abs(vectors).max())
                out = []
                for query in queries:
                    q = np.array(query["vector"], np.int64)
                    exact = top * float(np.abs(q).max()) * len(q) < 2**53
                    best = _Best(q, query["id"], k, longest, query["least"])
                    left, right = (t.points[:, :-1], q.astype(np.float64)) if exact else (vectors, q)
                    t.search(q, best.reach, lambda r, b=best, x=left, y=right: b.offer((x[r] @ y).astype(np.int64), r, ids))
                    out.extend((query["id"], i, -s) for s, i in best.found)
                yield pd.DataFrame(out, columns=["query_id", "id", "score"])

    def searched(queries: DataFrame, rest: bool) -> DataFrame:
        fields = f"id {id_type}, vector array<bigint>, block bigint, least double"
        sent = queries.select("id", "vector", "block", "least").mapInPandas(routes(rest), f"{fields}, pivot int")
        sent = sent.groupBy("pivot", "block").agg(F.collect_list(F.struct("id", "vector", "least")).alias("queries"))
        tasks = sent.join(index, "pivot").select("tree", "queries")
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return tasks.repartition(width).mapInPandas(look, f"query_id {id_type}, id {id_type}, score long")

    near = saved(searched(asked.withColumn("least", F.lit(None).cast("double")), False), "mtree-near")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    kth = near.distinct().withColumn("place", place).filter(F.col("place") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("least"))
    return near.union(searched(asked.join(kth, "id", "left"), True))
