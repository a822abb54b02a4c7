"""Exact top-k search by a Voronoi join: queries and data are grouped by their nearest pivots, bounds come from group
summaries, only data that can still reach a query group's k-th score are copied to it, and each piece is solved locally.

Scores are inner products of whole numbers, floor(scale * component). With q = p + a, p the pivot of the query's group and
|a| <= R: q.x <= p.x + R |x|. A first join of each group with its own data, and with a few rows of others where it has too few,
gives every query a k-th score; the lowest of a group is what any other data must be able to reach. Whole data groups are ruled out by their summary, a ball around their pivot
(x = c + b, |b| <= D: q.x <= p.c + |p| D + R (|c| + D)); rows of the others one by one. There are as many pivots as the square
root of the number of vectors, up to MOST_PIVOTS; they come from a bounded sample (SAMPLE vectors, the first by a hash of their
id) and only affect how much is copied, never the result.

Query groups that lie near each other are bundled up to BUNDLE queries, and a row is copied once to a bundle, however many of
its groups it matters to; the bounds are checked again for each group inside. So a row is copied once for each BUNDLE queries
at most, where vectors have no structure that bounds could use, and to the few bundles around it where they have. Bundles are
cut into pieces of about CHUNK rows and BUNDLE queries by row number, so a hot group, or one vector or id that a third of the
rows have, is spread out.

Defined cases: vectors without an id, and those that are null or hold a null or non-finite component take no part; missing components of shorter
vectors count as 0; ties go to the smaller id; rows of equal ids are queries and candidates each, and none answers another;
fewer than k candidates give fewer rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, collected, numbers, tidy

K, SAMPLE, MOST_PIVOTS, CHUNK, BUNDLE, SCALE = 10, 4096, 512, 4096, 2048, 1024
#: Rows, in multiples of k, that are taken from other groups where one can't give k scores.
FILL = 2


def _whole(dim: int, scale: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy(zero_copy_only=False))
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            for i, key in enumerate(numbers(batch, "vec_id")):
                x = flat[at[i] : at[i + 1]]
                if np.isfinite(x).all():
                    ids.append(int(key))
                    rows.append(np.pad(np.floor(scale * x), (0, dim - len(x))).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], ["vec_id", "v"])

    return run


def _matrix(column) -> np.ndarray:
    rows = [np.frombuffer(x, "<i8") for x in column]
    return np.stack(rows) if rows else np.zeros((0, 0), np.int64)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products; by floating point where no sum can lose a digit."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    return (q.astype(float) @ x.T.astype(float)).astype(np.int64) if top < 2**52 else q @ x.T


def pivots(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """n centres of the sample: far-apart first choices, then a few rounds of means."""
    x = sample.astype(float)
    if len(x) <= n:
        return x
    chosen = [0]
    far = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < n:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    c = x[chosen]
    for _ in range(rounds):
        own = nearest(x, c)[0]
        for g in range(n):
            if (own == g).any():
                c[g] = x[own == g].mean(0)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
    g = d.argmin(1)
    return g, np.sqrt(((x - c[g]) ** 2).sum(1))


def _grouped(c: np.ndarray):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                g, dist = nearest(_matrix(batch.column(1).to_pylist()).astype(float), c)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(g.astype(np.int32)), pa.array(dist)], ["vec_id", "v", "g", "dist"])

    return run


def chain(c: np.ndarray, some: list[int]) -> list[int]:
    """The pivots `some` in an order in which each follows the nearest one before it."""
    left, out = np.array(some), []
    at = 0
    while len(left):
        out.append(int(left[at]))
        left = np.delete(left, at)
        if len(left):
            at = int(((c[left] - c[out[-1]]) ** 2).sum(1).argmin())
    return out


def bundles(order: list[int], n_queries: dict[int, int], most: int) -> dict[int, int]:
    """The bundle of each group: neighbours in the order together, up to `most` queries."""
    out, bundle, held = {}, 0, 0
    for g in order:
        if held and held + n_queries[g] > most:
            bundle, held = bundle + 1, 0
        out[g], held = bundle, held + n_queries[g]
    return out


def _ahead(c: np.ndarray, g: int, n_rows: dict[int, int], least: int) -> list[int]:
    """Other groups that hold `least` rows together, those with the highest products of pivots first."""
    out, held = [], 0
    for h in np.argsort(-(c @ c[g]), kind="stable").tolist():
        if held >= least:
            break
        if h != g and n_rows.get(h):
            out.append(h)
            held += n_rows[h]
    return out


class Bounds:
    """What a row must be able to reach for each query group, and which data groups hold any that can."""

    def __init__(self, c: np.ndarray, radius: np.ndarray, floor: np.ndarray, spread: np.ndarray):
        """radius, floor: of each group's queries (floor infinite without any); spread: of each group's data, negative without."""
        self.c, self.radius, self.floor = c, radius, floor
        length = np.sqrt((c * c).sum(1))
        reach = c @ c.T + length * spread[:, None] + (length[:, None] + spread[:, None]) * radius
        self.possible = (reach + 1 + 1e-9 * np.abs(reach) >= floor) & (spread[:, None] >= 0) & (floor < np.inf)

    def need(self, x: np.ndarray, groups: np.ndarray | list[int]) -> np.ndarray:
        """For rows x and query groups whether the row can matter to the group."""
        reach = x @ self.c[groups].T + np.sqrt((x * x).sum(1))[:, None] * self.radius[groups]
        return reach + 1 + 1e-9 * np.abs(reach) >= self.floor[groups]


def _copies(bounds, bundle_of: np.ndarray):
    """The rows, once for each bundle with a query group other than their own that they can matter to."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bounds.value
        for batch in batches:
            x, own = _matrix(batch.column(1).to_pylist()).astype(float), batch.column(2).to_numpy()
            for g in np.unique(own).tolist():
                groups = np.flatnonzero(b.possible[g])
                groups = groups[groups != g]
                if not len(groups):
                    continue
                rows = np.flatnonzero(own == g)
                row, group = np.nonzero(b.need(x[rows], groups))
                if len(row):
                    pair = np.unique((rows[row] << 32) | bundle_of[groups[group]])
                    part = batch.take(pa.array(pair >> 32))
                    yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array((pair & 0xFFFFFFFF).astype(np.int32))], ["vec_id", "v", "g", "row", "bundle"])

    return run


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    some = np.flatnonzero(scores >= np.partition(scores, -k)[-k]) if len(scores) > k else np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def _solve(k: int, bounds=None):
    """The k best of each query within a piece of data; with bounds, of rows from other groups that can matter to its own."""

    def run(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(data):
            ids, x, groups = data["vec_id"].to_numpy(), _matrix(data["v"]), data["g"].to_numpy()
            for g, some in queries.groupby("g"):
                own_ids, own_x = ids, x
                if bounds is not None:
                    rows = np.flatnonzero(bounds.value.need(x.astype(float), [g])[:, 0] & (groups != g))
                    own_ids, own_x = ids[rows], x[rows]
                if not len(own_ids):
                    continue
                for lo in range(0, len(some), 256):
                    part = some.iloc[lo : lo + 256]
                    scores = products(_matrix(part["v"]), own_x)
                    for row, q, low, line in zip(part["row"].tolist(), part["vec_id"].tolist(), part["low"].tolist(), scores, strict=True):
                        at = np.flatnonzero((line >= low) & (own_ids != q))
                        best = at[_best(own_ids[at], line[at], k)]
                        out += [(row, q, int(own_ids[i]), int(line[i])) for i in best.tolist()]
        return pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score"]).astype("int64")

    return run


_FOUND = "row bigint, query_id bigint, vec_id bigint, score bigint"


def top_k_with_copies(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, n_pivots: int | None = None, bundle: int = BUNDLE) -> tuple[DataFrame, int, int]:
    """The result of `top_k`, the number of vectors that take part, and how often they were copied to other groups."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "voronoi")
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    vectors = vectors.filter("vec_id is not null and embedding is not null and not exists(embedding, x -> x is null)")
    dim = vectors.agg(F.max(F.size("embedding")).alias("n")).first().n or 1
    whole = scratch.keep(vectors.mapInArrow(_whole(dim, scale), "vec_id bigint, v binary"))
    n = whole.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint"), 0, 0
    sample = collected(whole.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE))
    c = pivots(_matrix(sample["v"]), n_pivots or max(1, min(MOST_PIVOTS, round(n**0.5))))
    data = whole.mapInArrow(_grouped(c), "vec_id bigint, v binary, g int, dist double")
    data = scratch.keep(data.withColumn("row", F.monotonically_increasing_id()))
    queries = data.filter(is_query)
    # At most a row for each pivot.
    by_data = {r.g: r for r in data.groupBy("g").agg(F.count("*").alias("n"), F.max("dist").alias("far")).collect()}
    by_query = {r.g: r for r in queries.groupBy("g").agg(F.count("*").alias("n"), F.max("dist").alias("far")).collect()}

    def lookup(values: dict[int, int], key: str):
        """A number for each group or bundle, 0 for those without."""
        return F.coalesce(F.get(F.array(*(F.lit(int(values.get(i, 0))) for i in range(max(values, default=0) + 1))), F.col(key)), F.lit(0))

    def joined(queries: DataFrame, rows: DataFrame, key: str, n_queries: dict[int, int], n_rows: dict[int, int], solve) -> DataFrame:
        """Best k of each query within each piece of what its group or bundle (key) meets."""
        blocks = lookup({i: -(-x // bundle) for i, x in n_queries.items()}, key)
        chunks = lookup({i: -(-n_rows.get(i, 0) // CHUNK) for i in n_queries}, key)
        place = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "row"), F.greatest(n, F.lit(1)))
        left = queries.filter(chunks > 0).select("row", "vec_id", "v", "g", "low", key if key != "g" else F.col("g").alias("unit"), place(1, blocks).alias("block"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
        right = rows.filter(blocks > 0).select("vec_id", "v", "g", key if key != "g" else F.col("g").alias("unit"), place(2, chunks).alias("chunk"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
        by = ["unit" if key == "g" else key, F.col("block").cast("long"), F.col("chunk").cast("long")]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(solve, _FOUND)

    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")

    def best(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def counts(by: dict) -> dict[int, int]:
        return {g: r.n for g, r in by.items()}

    none = F.lit(float("-inf"))
    own = scratch.keep(best(joined(queries.withColumn("low", none), data, "g", counts(by_query), counts(by_data), _solve(k))).drop("rank"))

    def with_low(queries: DataFrame, found: DataFrame) -> DataFrame:
        kth = found.groupBy("row").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("low"))
        return queries.drop("low").join(kth, "row", "left").withColumn("low", F.when(F.col("n") == k, F.col("low")).otherwise(none)).drop("n")

    queries = with_low(queries, own)
    # Where a query's own group is too small to give k scores, a few rows of the groups ahead of its pivot give a k-th one, which no
    # group without k rows could. At most a row for each pivot comes here.
    short = [r.g for r in queries.filter(F.col("low") == none).select("g").distinct().collect()]
    if short:
        fills = [(g, h) for g in short for h in _ahead(c, g, {h: r.n for h, r in by_data.items()}, FILL * k)]
        some = data.filter(F.col("g").isin(sorted({h for _, h in fills}))).withColumn("__i", F.row_number().over(Window.partitionBy("g").orderBy("row")))
        some = scratch.keep(some.filter(F.col("__i") <= FILL * k).drop("__i"))
        asked = queries.filter(F.col("low") == none).join(F.broadcast(spark.createDataFrame(fills or [(-1, -1)], "g int, h int")), "g").withColumn("g", F.col("h")).drop("h")
        n_asked = {r.g: r.n for r in asked.groupBy("g").agg(F.count("*").alias("n")).collect()}
        more = joined(asked, some, "g", n_asked, {h: min(r.n, FILL * k) for h, r in by_data.items()}, _solve(k))
        queries = with_low(queries, scratch.keep(best(own.unionByName(more)).drop("rank")))
    floors = {r.g: r.low for r in queries.groupBy("g").agg(F.min("low").alias("low")).collect()}
    by_group = lambda values, absent: np.array([values.get(g, absent) for g in range(len(c))], float)
    bounds = spark.sparkContext.broadcast(Bounds(c, by_group({g: r.far for g, r in by_query.items()}, 0.0), by_group(floors, np.inf), by_group({g: r.far for g, r in by_data.items()}, -1.0)))
    bundle_of = bundles(chain(c, sorted(by_query)), counts(by_query), bundle)
    copies = data.select("vec_id", "v", "g", "row").mapInArrow(_copies(bounds, by_group(bundle_of, 0).astype(np.int64)), "vec_id bigint, v binary, g int, row bigint, bundle int")
    copies = scratch.keep(copies)
    n_copies = {r.bundle: r.n for r in copies.groupBy("bundle").agg(F.count("*").alias("n")).collect()}
    n_queries: dict[int, int] = {}
    for g, b in bundle_of.items():
        n_queries[b] = n_queries.get(b, 0) + by_query[g].n
    queries = queries.withColumn("bundle", lookup(bundle_of, "g"))
    found = best(own.unionByName(joined(queries, copies, "bundle", n_queries, n_copies, _solve(k, bounds))))
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score"), n, sum(n_copies.values())


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, n_pivots: int | None = None, bundle: int = BUNDLE) -> DataFrame:
    """query_id, rank, vec_id, score of vectors (vec_id, embedding). is_query: a condition on vec_id."""
    return top_k_with_copies(vectors, is_query, k, scale, n_pivots, bundle)[0]
