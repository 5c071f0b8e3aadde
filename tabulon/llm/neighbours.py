"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing, exact distances for the candidates."""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, sqrt
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import staged

# Tables, hashes of each, and the width of a cell; projections of the scaled vectors have a spread of one.
TABLES, HASHES, CELL = 2, 8, 3.0
# Cells are cut at ± EDGE, so that a table has at most (2 · EDGE / CELL + 1) ^ HASHES buckets.
EDGE = 4.0
# The sample on which probing is fitted, its queries, and the share of their neighbours that probing has to find.
SAMPLE, SAMPLE_QUERIES, SHARE = 8192, 384, 0.96
# Vectors of a bucket that stay together; vectors and queries that meet in one task.
PART, SHARD, BLOCK = 4096, 16384, 8192
LEAST_SHARDS = 16

_phi = np.vectorize(lambda x: 0.5 * (1 + erf(x / sqrt(2))))


class Probing(NamedTuple):
    """Fitted on the sample: projections, offsets, the largest norm, the spread of neighbours, and how far to probe."""

    lines: np.ndarray  # tables × hashes × (dimension + 1)
    offsets: np.ndarray  # tables × hashes
    norm: float
    spread: float
    depth: float

    def projected(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """n × tables × hashes. Stored vectors get one more component that gives all of them length one; then the
        largest inner product with a query is the smallest distance."""
        lengths = np.linalg.norm(vectors, axis=1)
        scale = lengths if query else np.full(len(vectors), self.norm)
        last = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(0.0, 1 - (lengths / self.norm) ** 2))
        full = np.concatenate((vectors / scale[:, None], last[:, None]), 1)
        return np.einsum("nd,thd->nth", full, self.lines) + self.offsets

    def cells(self, projected: np.ndarray) -> np.ndarray:
        return np.floor(np.clip(projected, -EDGE, EDGE) / CELL).astype(np.int64) + int(EDGE / CELL) + 1

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """n × tables: the cells of a table as one number."""
        width = int(2 * EDGE / CELL) + 3
        return self.cells(self.projected(vectors, False)) @ (width ** np.arange(HASHES))

    def shares(self, queries: np.ndarray, table: int, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order in which each query visits the buckets, and the share of success gathered before each visit.

        A neighbour's projection is the query's plus a normal error of the fitted spread; a bucket's chance is the
        product over its cells, relative to that of all buckets that hold anything.
        """
        width = int(2 * EDGE / CELL) + 3
        z = self.projected(queries, True)[:, table]
        low = (np.arange(width) - int(EDGE / CELL) - 1) * CELL
        bounds = np.append(low, low[-1] + CELL)
        below = _phi((bounds[None, None, :] - z[:, :, None]) / self.spread)
        chance = np.log(np.maximum(np.diff(below, axis=2), 1e-30))  # queries × hashes × cells
        logs = np.zeros((len(queries), len(buckets)))
        for h in range(HASHES):
            logs += chance[:, h, buckets // width**h % width]
        order = np.argsort(-logs, axis=1, kind="stable")
        p = np.exp(np.take_along_axis(logs, order, 1) - logs.max(1, keepdims=True))
        upto = np.cumsum(p, axis=1)
        return order, (upto - p) / upto[:, -1:]


def fit(sample: np.ndarray, norm: float, k: int, seed: int = 5) -> Probing:
    """Directions from the seed; spread and depth from the sample's own neighbours, found by brute force."""
    rng = np.random.default_rng(seed)
    lines, offsets = rng.standard_normal((TABLES, HASHES, sample.shape[1] + 1)), rng.uniform(0, CELL, (TABLES, HASHES)) - CELL / 2
    probing = Probing(lines, offsets, norm, 1.0, 1.0)
    queries = sample[:SAMPLE_QUERIES]
    scores = queries @ sample.T
    np.fill_diagonal(scores, -np.inf)
    near = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    if not near.size:
        return probing
    stored, asked = probing.projected(sample, False), probing.projected(queries, True)
    gaps = stored[near] - asked[:, None]
    probing = probing._replace(spread=max(float(np.sqrt((gaps**2).mean())), 1e-3))
    found = np.full(near.shape, np.inf)
    own = probing.buckets(sample)
    for t in range(TABLES):
        buckets, where = np.unique(own[:, t], return_inverse=True)
        order, before = probing.shares(queries, t, buckets)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
        found = np.minimum(found, np.take_along_axis(before, np.take_along_axis(place, where[near], 1), 1))
    return probing._replace(depth=float(np.quantile(found, SHARE)))


def _clean(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """`id`, `vec` of the rows that take part, staged; one vector for each id."""
    v = F.col("vec")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists(v, lambda x: x != 0.0))
    rows = staged(rows.select("id", F.transform(v, lambda x: x + 0.0).alias("vec")), "near-rows")  # −0 is 0
    twice = rows.groupBy("id").count().where("count > 1").select("id")
    if twice.isEmpty():
        return rows
    twice = staged(twice, "near-twice")
    one = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.min("vec").alias("vec"))
    return staged(rows.join(twice, "id", "left_anti").unionByName(one), "near-rows")


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64) if len(column) else np.zeros((0, 0))


def nearest(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 20, queries: Column | None = None, seed: int = 5) -> DataFrame:
    """`query_id`, `rank` (from 1), `vec_id`, `score`: the k nearest rows found for each query row, by inner product.

    Queries are the rows for which `queries` holds (of `id`; by default ids divisible by 20), candidates all rows with
    another id. Ties go to the smaller id; scores are inner products of the given vectors in double precision. Rows
    without id or vector, with a zero vector, with a null or non-finite component take no part. An id stands for one
    vector: rows that repeat it count once, and of different vectors the first in order asks and is found. Vectors of
    different lengths have no inner product: each length is searched by itself. Fewer candidates than k give fewer rows;
    an empty table gives none. Other columns are ignored.

    Equal vectors are one class, of which the k + 1 smallest ids are kept, so no group of copies meets in a task. All
    classes are hashed into TABLES tables of buckets. A query visits buckets in the order of their estimated success
    until it has met k + 1 classes and gathered the share that finds SHARE of the neighbours in a sample of SAMPLE classes (their own
    neighbours are farther apart than those in all the data, so the share found in all the data is larger). Buckets are
    cut into parts, parts dealt to shards of bounded size, queries to blocks; a task scores the candidates of a block
    in a shard exactly and hands on k + 1 classes for each query. The list of buckets has at most
    (2 · EDGE / CELL + 3) ^ HASHES entries a table, whatever the data.
    """
    rows = _clean(vectors, id_column, vector_column)
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in rows.select(F.size("vec").alias("n")).distinct().orderBy("n").collect():  # a row per length
        found = found.unionByName(_nearest(rows.where(F.size("vec") == r["n"]), k, queries, seed))
    return found


def _nearest(rows: DataFrame, k: int, queries: Column | None, seed: int) -> DataFrame:
    """The same for staged `id`, `vec` of one length."""
    spark = rows.sparkSession
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = staged(first.groupBy("vec").agg(F.min("id").alias("cls"), F.sort_array(F.collect_list("id")).alias("ids")), "near-classes")
    asked = (F.col("id") % 20 == 0) if queries is None else queries
    wanted = staged(rows.where(asked).join(classes.select("vec", "cls"), "vec").select("id", "cls"), "near-queries")
    ask = wanted.select("cls").distinct().join(classes.select("cls", "vec"), "cls")

    total, norm = classes.agg(F.count("*"), F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)))).first()
    # Rows of the lowest hashes; the first condition leaves about two samples, so that tasks send no more to the driver.
    low = classes.where(F.pmod(F.xxhash64("cls"), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, 2 * SAMPLE / max(total, 1))))
    low = low.orderBy(F.pmod(F.xxhash64("cls"), F.lit(1 << 30)), "cls").select("vec").limit(SAMPLE)
    sample = _stacked(pd.Series([r["vec"] for r in low.collect()], dtype=object))
    probing = fit(sample, float(norm) * (1 + 1e-12), k + 1, seed)

    def hashed(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pdfs:
            if len(p):
                b = probing.buckets(_stacked(p["vec"]))
                for t in range(TABLES):
                    yield pd.DataFrame({"cls": p["cls"], "vec": p["vec"], "table": t, "bucket": b[:, t]})

    placed = staged(classes.select("cls", "vec").mapInPandas(hashed, "cls long, vec array<double>, table int, bucket long"), "near-placed")
    # Bounded by the number of cells of a table.
    listed = placed.groupBy("table", "bucket").count().orderBy("table", "bucket").collect()
    shards = max(LEAST_SHARDS, -(-int(total) * TABLES // SHARD))
    tables = []
    for t in range(TABLES):
        own = [(r["bucket"], r["count"]) for r in listed if r["table"] == t]
        tables.append((np.array([b for b, _ in own]), np.array([-(-c // PART) for _, c in own]), np.array([c for _, c in own])))
    sent = spark.sparkContext.broadcast((probing, tables))
    blocks = -(-ask.count() // BLOCK)

    def shard_of(table: np.ndarray, bucket: np.ndarray, part: np.ndarray) -> np.ndarray:
        x = (bucket.astype(np.uint64) * np.uint64(TABLES) + table.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % shards

    def dealt(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, where = sent.value
        for p in pdfs:
            t, b, c = (p[x].to_numpy() for x in ("table", "bucket", "cls"))
            parts = np.ones(len(p), np.int64)
            for k_, (buckets, n, _) in enumerate(where):
                parts[t == k_] = n[np.searchsorted(buckets, b[t == k_])]
            part = ((c.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(32)).astype(np.int64) % parts
            shard = shard_of(t, b, part)
            for block in range(blocks):
                yield pd.DataFrame({"shard": shard, "block": block, "cls": c, "vec": p["vec"], "slot": b * TABLES + t})

    def probed(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        probing, where = sent.value
        for whole in pdfs:
            for at in range(0, len(whole), 64):
                p = whole.iloc[at:at + 64].reset_index(drop=True)
                vec = _stacked(p["vec"])
                query, slot, shard = [], [], []
                for t, (buckets, parts, counts) in enumerate(where):
                    order, before = probing.shares(vec, t, buckets)
                    q, place = np.nonzero((before <= probing.depth) | (np.cumsum(counts[order], axis=1) - counts[order] <= k))
                    hit = order[q, place]
                    n = parts[hit]
                    part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    q, hit = np.repeat(q, n), np.repeat(hit, n)
                    query.append(q)
                    slot.append(buckets[hit] * TABLES + t)
                    shard.append(shard_of(np.full(len(hit), t), buckets[hit], part))
                visits = pd.DataFrame({"q": np.concatenate(query), "slot": np.concatenate(slot), "shard": np.concatenate(shard)})
                visits = visits.drop_duplicates().groupby(["q", "shard"])["slot"].agg(list).reset_index()
                cls = p["cls"].to_numpy()[visits["q"]]
                yield pd.DataFrame({"shard": visits["shard"], "block": ((cls.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(33)).astype(np.int64) % blocks,
                                    "cls": cls, "vec": pd.Series([p["vec"][i] for i in visits["q"]], dtype=object), "slots": visits["slot"].astype(object)})

    def scored(key: tuple, stored: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "classes": [], "scores": []}
        if len(stored) and len(asking):
            stored = stored.sort_values("cls", ignore_index=True)
            cls, mat = stored["cls"].to_numpy(), _stacked(stored["vec"])
            slots, where = np.unique(stored["slot"].to_numpy(), return_inverse=True)
            for at in range(0, len(asking), 256):
                part = asking.iloc[at:at + 256]
                visits = np.zeros((len(part), len(slots) + 1), bool)
                for i, s in enumerate(part["slots"]):
                    place = np.searchsorted(slots, s)
                    ok = slots[np.minimum(place, len(slots) - 1)] == s
                    visits[i, place[ok]] = True
                score = _stacked(part["vec"]) @ mat.T
                score[~visits[:, where]] = -np.inf
                m = min(TABLES * (k + 1), len(cls))
                least = -np.partition(-score, m - 1, axis=1)[:, m - 1]
                for i, q in enumerate(part["cls"].to_numpy()):
                    b = np.flatnonzero((score[i] >= least[i]) & np.isfinite(score[i]))
                    if len(b):
                        b = b[np.argsort(-score[i, b], kind="stable")]
                        b = b[np.sort(np.unique(cls[b], return_index=True)[1])][: k + 1]  # a class is there once for each table
                        exact = (mat[b] * part["vec"].iloc[i]).sum(1)
                        out["query"].append(q), out["classes"].append(cls[b]), out["scores"].append(exact)
        # Lists stay objects, also where there are none.
        return pd.DataFrame({"query": pd.Series(out["query"], dtype="int64"), "classes": pd.Series(out["classes"], dtype=object), "scores": pd.Series(out["scores"], dtype=object)})

    stored = placed.mapInPandas(dealt, "shard long, block long, cls long, vec array<double>, slot long")
    spread = ask.repartition(spark.sparkContext.defaultParallelism * 2, "cls")
    asking = spread.mapInPandas(probed, "shard long, block long, cls long, vec array<double>, slots array<long>")
    tops = stored.groupBy("shard", "block").cogroup(asking.groupBy("shard", "block")).applyInPandas(scored, "query long, classes array<long>, scores array<double>")
    tops = tops.select("query", F.explode(F.arrays_zip("classes", "scores")).alias("x")).select("query", F.col("x.classes").alias("cls"), F.col("x.scores").alias("score")).distinct()
    order = Window.partitionBy("query").orderBy(F.desc("score"), "cls")
    tops = tops.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    # Classes become rows; a query needs k rows besides its own.
    each = tops.join(classes.select("cls", "ids"), "cls").select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    each = each.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    lists = staged(each, "near-lists")
    out = wanted.withColumnRenamed("id", "query_id").join(lists.withColumnRenamed("query", "cls"), "cls").where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
