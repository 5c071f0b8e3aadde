"""Document chunking, vectors, nearest-neighbour search and collection upkeep.

A collection is a DataFrame (id, content, metadata, embedding). Every operator returns a new frame; storing it is the
caller's write.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import IDF, CountVectorizerModel, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import col, require
from ..functions.sizes import spread
from ..session import staged

SEPARATORS = ("\n\n", "\n", " ", "")
# Characters of text whose chunks a task hands on at a time.
PART_CHARS = 1 << 20
# Query vectors that travel to every task; more than these take the block join.
QUERY_BLOCK = 2_000
# Numbers in a block of documents or queries (32 MB); queries and documents of a block that meet in one product.
BLOCK_NUMBERS, STRIP, SLICE = 1 << 22, 256, 4_096
# Cells into which documents are sorted by their nearest pivot, and documents of a cell on average at least; pivots whose
# distances each cell knows the least and the largest of.
CELLS, CELL_ROWS, MARKS = 1024, 2_048, 16
# Below so many pairs of a block of documents and a block of queries nothing is gained by skipping some.
FEW_BLOCKS = 16
# Largest share of the documents that queries may have to visit for cells to be worth their shuffles.
CELL_SHARE = 0.1
METRICS = ("l2sq", "cosine")


# --- chunks ---------------------------------------------------------------------------------------------------------

def _pieces(text: str, separator: str) -> list[str]:
    """Cut in front of every separator, so that each piece but the first starts with it."""
    if not separator:
        return list(text)
    head, *tail = text.split(separator)
    return [p for p in (head, *(separator + t for t in tail)) if p]


def _pack(pieces: Sequence[str], size: int, overlap: int, out: list[str]) -> None:
    """Join consecutive pieces into chunks of at most `size`; a chunk opens with the last pieces, `overlap` long at most."""
    first, length = 0, 0
    for i, piece in enumerate(pieces):
        if length + len(piece) > size and first < i:
            _emit("".join(pieces[first:i]), out)
            while first < i and (length > overlap or length + len(piece) > size):
                length -= len(pieces[first])
                first += 1
        length += len(piece)
    _emit("".join(pieces[first:]), out)


def _emit(chunk: str, out: list[str]) -> None:
    chunk = chunk.strip()
    if chunk:
        out.append(chunk)


def split_text(text: str, size: int = 1000, overlap: int = 200, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of one text: the coarsest separator that occurs cuts it; pieces still too long are cut by finer ones."""
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    out: list[str] = []
    run: list[str] = []
    for piece in _pieces(text, separators[at]):
        if len(piece) < size or at + 1 == len(separators):
            run.append(piece)
            continue
        _pack(run, size, overlap, out)
        run = []
        out.extend(split_text(piece, size, overlap, separators[at + 1:]))
    _pack(run, size, overlap, out)
    return out


def chunk_documents(docs: DataFrame, id_col: str = "id", text: str = "content", size: int = 1000, overlap: int = 200, *,
                    by_separator: bool = True, metadata: dict[str, str] | None = None) -> DataFrame:
    """RAG-01: (chunk_id, id, chunk_index, content, chunk_size, metadata), one row per chunk.

    `by_separator=False` cuts fixed windows of `size` characters every `size - overlap`, without leaving the JVM.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    held = spread(docs.select(id_col, text))
    if by_separator:
        schema = T.StructType([held.schema[id_col], T.StructField("chunk_index", T.IntegerType()), T.StructField("content", T.StringType())])
        cut = held.select(col(id_col), col(text).cast("string")).mapInArrow(_chunk_rows(size, overlap, schema), schema)
    else:
        n, step = F.length(col(text)), size - overlap
        starts = F.sequence(F.lit(1), F.greatest(n - overlap, F.lit(1)), F.lit(step))
        chunks = F.when(n > 0, F.transform(starts, lambda s: F.substr(col(text), s, F.lit(size))))
        cut = held.select(col(id_col), F.posexplode(chunks).alias("chunk_index", "content"))
    extra = F.create_map(*[F.lit(x) for kv in (metadata or {}).items() for x in kv]) if metadata else F.create_map().cast("map<string,string>")
    return cut.select(F.concat_ws("_", F.lit("chunk"), col(id_col).cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"),
                      col(id_col), "chunk_index", "content", F.length("content").alias("chunk_size"), extra.alias("metadata"))


def _chunk_rows(size: int, overlap: int, schema: T.StructType):
    """A row per chunk, handed on by PART_CHARS; texts leave Arrow one at a time, so that a task holds few of a batch."""
    arrow = to_arrow_schema(schema)

    def rows(batches):
        for b in batches:
            owner, index, content, held = [], [], [], 0

            def part() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), pa.array(index, pa.int32()), pa.array(content, arrow.field(2).type)], names=arrow.names)

            for i in range(b.num_rows):
                t = b.column(1)[i].as_py()
                chunks = split_text(t, size, overlap) if t else []
                owner += [i] * len(chunks)
                index += range(len(chunks))
                content += chunks
                held += len(t or "")
                if held >= PART_CHARS:
                    yield part()
                    owner, index, content, held = [], [], [], 0
            if content:
                yield part()

    return rows


# --- vectors --------------------------------------------------------------------------------------------------------

def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def text_vectors(df: DataFrame, text: str, dims: int = 256, out: str = "embedding", bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """RAG-03: unit vectors of TF-IDF weights over hashed words; an empty text has the zero vector.

    `bucket` maps a word to its place 0…dims-1 and replaces the built-in hash. A text is cut into words and counted
    once; the counts are staged, and the document frequencies, `dims` numbers, and the weights come from them. No shuffle.
    """
    if bucket is None:
        held = spread(df).withColumn("_w", words(F.coalesce(col(text), F.lit(""))))
        counted = HashingTF(numFeatures=dims, inputCol="_w", outputCol="_tf").transform(held)
    else:
        held = spread(df).withColumn("_w", F.transform(words(F.coalesce(col(text), F.lit(""))), lambda w: bucket(w).cast("string")))
        places = CountVectorizerModel.from_vocabulary([str(i) for i in range(dims)], inputCol="_w", outputCol="_tf")
        counted = places.transform(held)
    counted = staged(counted.drop("_w"), "word-counts")
    weighted = IDF(inputCol="_tf", outputCol="_ti").fit(counted.select("_tf")).transform(counted)
    unit = Normalizer(p=2.0, inputCol="_ti", outputCol="_u").transform(weighted)
    return unit.withColumn(out, vector_to_array("_u")).drop("_tf", "_ti", "_u")


# --- nearest neighbours ---------------------------------------------------------------------------------------------

def _distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """(rows, queries) distances, rounded so that equal vectors tie exactly."""
    dot = x @ q.T
    if metric == "l2sq":
        d = (x * x).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2.0 * dot
        d = np.maximum(d, 0.0)
    else:
        norm = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((q * q).sum(1))[None, :]
        d = 1.0 - np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0)
    return np.round(d, 12)


def _matrix(vectors: Sequence, ids: Sequence, dims: int) -> np.ndarray:
    """Vectors as rows; one of another length than the first query's is an error that names its id."""
    for i, v in zip(ids, vectors):
        if len(v) != dims:
            raise ValueError(f"the vector of {i!r} has {len(v)} numbers, not {dims}")
    return np.array(vectors, dtype=np.float64).reshape(-1, dims)


def _best(ids: np.ndarray, d: np.ndarray, k: int) -> list[tuple]:
    """The k smallest (distance, id) of one column of distances."""
    if len(d) > k:
        edge = np.partition(d, k - 1)[k - 1]
        near = np.flatnonzero(d <= edge)
    else:
        near = np.arange(len(d))
    order = np.lexsort((np.unique(ids[near], return_inverse=True)[1], d[near]))[:k]
    return [(float(d[j]), ids[j]) for j in near[order]]


def nearest(docs: DataFrame, queries: DataFrame, k: int = 5, *, metric: str = "l2sq", id_col: str = "id", vector: str = "embedding",
            query_id: str = "query_id", query_vector: str = "query_vector", keep: Sequence[str] = (), filters: Mapping[str, object] | None = None,
            metadata: str = "metadata") -> DataFrame:
    """RAG-04: (query_id, rank, id, distance, score, keep…), the k nearest documents of every query, ties by id.

    Exact. A task holds a block of query vectors and k rows per query, whatever the number of documents; it hands on
    those rows only, never the pairs. `filters` keeps documents whose metadata (a map or struct column, or plain
    columns where there is no such column) has these values; it is applied to the scan.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if k < 1:
        raise ValueError("k must be positive")
    require(docs, [id_col, vector, *keep])
    for name, value in (filters or {}).items():
        held = col(metadata)[name] if metadata in docs.columns else col(name)
        docs = docs.filter(held == F.lit(value))
    side = docs.select(col(id_col).alias("id"), col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
    asked = queries.select(col(query_id).alias("query_id"), col(query_vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
    schema = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("id", side.schema["id"].dataType),
                           T.StructField("distance", T.DoubleType())])
    rows = asked.limit(QUERY_BLOCK + 1).collect()
    if not rows:
        found = docs.sparkSession.createDataFrame([], schema)
    elif len(rows) <= QUERY_BLOCK:
        found = _scan(side, rows, k, metric, schema)
    else:
        found = _many_queries(side, asked, k, metric, schema, rows)
    order = W.partitionBy("query_id").orderBy("distance", "id")
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    top = top.withColumn("score", 1.0 - F.col("distance"))
    if keep:
        extra = docs.select(col(id_col).alias("id"), *[col(c) for c in keep])
        small = len(rows) * k <= QUERY_BLOCK * 10 and len(rows) <= QUERY_BLOCK  # queries x k rows, counted above
        top = extra.join(F.broadcast(top) if small else top, "id")
    return top.select(F.col("query_id").alias(query_id), "rank", F.col("id").alias(id_col), "distance", "score", *[col(c) for c in keep])


def _scan(side: DataFrame, rows: list, k: int, metric: str, schema: T.StructType) -> DataFrame:
    q_ids = [r["query_id"] for r in rows]
    q = _matrix([r["v"] for r in rows], q_ids, len(rows[0]["v"]))
    arrow = to_arrow_schema(schema)

    def top(batches):
        best: list[list[tuple]] = [[] for _ in q_ids]
        for b in batches:
            if not b.num_rows:
                continue
            ids = np.array(b.column(0).to_pylist(), dtype=object)
            lengths = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            if (lengths != q.shape[1]).any():
                at = int(np.flatnonzero(lengths != q.shape[1])[0])
                raise ValueError(f"the vector of {ids[at]!r} has {lengths[at]} numbers, not {q.shape[1]}")
            d = _distances(np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, q.shape[1]), q, metric)
            for j in range(len(q_ids)):
                best[j] = sorted(best[j] + _best(ids, d[:, j], k))[:k]
        flat = [(q_ids[j], i, d) for j, hits in enumerate(best) for d, i in hits]
        columns = zip(*flat) if flat else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return spread(side).mapInArrow(top, schema)


def _block_counts(n_doc: int, n_ask: int, dims: int, cores: int) -> tuple[int, int]:
    """Blocks of documents and of queries: as few as a task can hold, since a row is sent once for each block of the other
    side, but several pairs of them for each core."""
    rows = max(1, BLOCK_NUMBERS // max(dims, 1))
    parts, chunks = max(1, -(-n_doc // rows)), max(1, -(-n_ask // rows))
    while parts * chunks < 4 * cores and max(n_doc / parts, n_ask / chunks) > QUERY_BLOCK:
        parts, chunks = (parts + 1, chunks) if n_doc / parts > n_ask / chunks else (parts, chunks + 1)
    return parts, chunks


def _many_queries(side: DataFrame, asked: DataFrame, k: int, metric: str, schema: T.StructType, some: list) -> DataFrame:
    """More queries than every task can hold: blocks against blocks, all of them if they are few or few could be skipped."""
    dims, n_doc, n_ask = len(some[0]["v"]), side.count(), asked.count()
    rows = max(1, BLOCK_NUMBERS // max(dims, 1))
    if -(-n_doc // rows) * -(-n_ask // rows) > FEW_BLOCKS:
        sorted_cells = _cells_of(side, metric, dims, min(CELLS, max(1, n_doc // CELL_ROWS)))
        if _visited_share(sorted_cells, some[:STRIP], k, metric, schema, dims) <= CELL_SHARE:
            return search_cells(side, asked, k, metric, schema, dims, 0, sorted_cells)
    parts, chunks = _block_counts(n_doc, n_ask, dims, side.sparkSession.sparkContext.defaultParallelism)
    left = side.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "id", "v")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int").alias("chunk"), "query_id", "v")
    by = ["part", "chunk"]
    # A number of partitions of our own, which small rows don't merge into a few long tasks.
    left, right = (d.repartition(parts * chunks, *by).groupBy(*by) for d in (left, right))
    return left.cogroup(right).applyInPandas(_compared(k, metric, dims), schema)


def _compared(k: int, metric: str, dims: int):
    """The k nearest of a block of documents for each of a block of queries."""
    def block(docs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if docs.empty or qs.empty:
            return pd.DataFrame({"query_id": [], "id": [], "distance": []})
        ids = docs["id"].to_numpy(dtype=object)
        x, q = _matrix(docs["v"].tolist(), ids, dims), _matrix(qs["v"].tolist(), qs["query_id"], dims)
        asks, found, d = _nearest_pairs(x, q, pd.factorize(ids, sort=True)[0], k, metric)
        return pd.DataFrame({"query_id": qs["query_id"].to_numpy(dtype=object)[asks], "id": ids[found], "distance": d})

    return block


def _nearest_pairs(x: np.ndarray, q: np.ndarray, place: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document, distance), the k nearest documents of each query, ties by `place`; `_distances`, but for few pairs.

    Strips of queries meet slices of documents in one product, for the cosine in single precision. Only what comes within
    the rounding error of the k-th largest product so far is measured in double precision, so the answer is exact. Vectors
    that aren't finite are near nothing.
    """
    order, copies = [], {}
    for i in np.argsort(place, kind="stable"):
        if np.isfinite(x[i]).all():
            n = copies[key] = copies.get(key := x[i].tobytes(), 0) + 1
            if n <= k:  # of equal vectors the first k are enough
                order.append(i)
    order, whole = np.array(order, np.int64), np.flatnonzero(np.isfinite(q).all(1))
    x, q, dims = x[order], q[whole], x.shape[1]
    nx, nq = (x * x).sum(1), (q * q).sum(1)
    if metric == "l2sq":
        xs, qs = np.hstack((2.0 * x, -nx[:, None])), np.hstack((q, np.ones((len(q), 1))))
        slack = 4e-12 + 8.0 * (dims + 4) * np.finfo(float).eps * (nq + nx.max(initial=0.0))
    else:
        xs, qs = (_points(v, metric)[0].astype(np.float32) for v in (x, q))
        slack = np.full(len(q), 4e-12 + 2.0 * (dims + 4) * 2.0 ** -24)

    def measured(row: np.ndarray, at: np.ndarray) -> np.ndarray:
        d = np.empty(len(row))
        for i in range(0, len(row), 1 << 14):
            r, a = row[i:i + (1 << 14)], at[i:i + (1 << 14)]
            dot = np.einsum("ij,ij->i", x[a], q[r])
            if metric == "l2sq":
                d[i:i + (1 << 14)] = np.maximum(nx[a] + nq[r] - 2.0 * dot, 0.0)
            else:
                norm = np.sqrt(nx[a]) * np.sqrt(nq[r])
                d[i:i + (1 << 14)] = 1.0 - np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0)
        return np.round(d, 12)

    def first_k(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs are the k nearest of their query, in order, and all distances."""
        d = measured(row, at)
        by = np.lexsort((at, d, row))
        return by[_rank(row[by]) < k], d

    out = []
    for begin in range(0, len(q), STRIP):
        strip, tolerance = qs[begin:begin + STRIP], slack[begin:begin + STRIP]
        row, at, near = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, xs.dtype)
        edge = np.full(len(strip), -np.inf)
        for since in range(0, len(x), SLICE):
            s = strip @ xs[since:since + SLICE].T
            if not since and s.shape[1] > k:
                edge = np.partition(s, -k, axis=1)[:, -k].astype(float)
            r, a = np.nonzero(s >= (edge - tolerance).astype(s.dtype)[:, None])
            row, at, near = np.concatenate((row, r)), np.concatenate((at, a + since)), np.concatenate((near, s[r, a]))
            if len(row) > 16 * (k + 1) * len(strip):  # many near ties: settle them
                kept = first_k(row + begin, at)[0]
                row, at, near = row[kept], at[kept], near[kept]
            by = np.lexsort((-near, row))
            last = by[_rank(row[by]) == k - 1]
            edge[row[last]] = np.maximum(edge[row[last]], near[last])
            kept = near >= (edge - tolerance).astype(near.dtype)[row]
            row, at, near = row[kept], at[kept], near[kept]
        row = row + begin
        kept, d = first_k(row, at)
        out.append((whole[row[kept]], order[at[kept]], d[kept]))
    empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return tuple(np.concatenate(c) for c in zip(empty, *out))


def _rank(row: np.ndarray) -> np.ndarray:
    """Of sorted numbers, how many equal ones come before each."""
    return np.arange(len(row)) - np.searchsorted(row, row, side="left")


def _points(vectors: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as points of a metric space, and which have no place there (of no length, with the cosine).

    Unit vectors at an angle lie √(2 · (1 − cos)) apart, so the triangle inequality serves either measure.
    """
    if metric == "l2sq":
        return vectors, np.zeros(len(vectors), bool)
    norm = np.sqrt((vectors * vectors).sum(1))
    return vectors / np.where(norm > 0, norm, 1.0)[:, None], norm == 0


def _apart(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2.0 * (x @ pivots.T), 0.0))


class Cells:
    """What is known of the cells: pivots, and of each cell the number of documents and the range of their distances to
    its own pivot (the last column) and to the first MARKS ones. The cell after the last holds vectors of no length."""

    def __init__(self, pivots: np.ndarray, metric: str, counts: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.pivots, self.metric, self.counts, self.low, self.high = pivots, metric, counts, low, high

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """For each vector and cell a distance, in the measure, that no document of the cell falls below."""
        x, lost = _points(vectors, self.metric)
        d, n = _apart(x, self.pivots), len(self.pivots)
        least = np.maximum(np.maximum(d - self.high[None, :n, -1], self.low[None, :n, -1] - d), 0.0)
        for j in range(min(MARKS, n)):
            least = np.maximum(least, np.maximum(d[:, j:j + 1] - self.high[None, :n, j], self.low[None, :n, j] - d[:, j:j + 1]))
        least = least * least if self.metric == "l2sq" else least * least / 2.0
        least = np.hstack((least, np.ones((len(x), 1))))
        least[lost] = 1.0
        return np.where(self.counts[None, :] > 0, least, np.inf)

    def first(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """The cells that a query visits first: in order of their bounds, until they hold k documents."""
        order = np.argsort(bounds, axis=1, kind="stable")
        upto = np.cumsum(self.counts[order], axis=1) - self.counts[order]
        out = np.zeros(bounds.shape, bool)
        np.put_along_axis(out, order, upto < k, axis=1)
        return out & np.isfinite(bounds)


def _sorted_into_cells(side: DataFrame, pivots: np.ndarray, metric: str, dims: int) -> DataFrame:
    """`cell`, `id`, `v`, staged: each document goes to the cell of its nearest pivot."""
    def assign(batches):
        for b in batches:
            x, lost = _points(_matrix(b.column(1).to_pylist(), b.column(0).to_pylist(), dims), metric)
            cell = np.where(lost, len(pivots), _apart(x, pivots).argmin(1)).astype(np.int32) if b.num_rows else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), b.column(0), b.column(1)], ["cell", "id", "v"])

    return staged(spread(side).mapInArrow(assign, T.StructType([T.StructField("cell", T.IntegerType()), *side.schema.fields])), "cells")


def _described_cells(held: DataFrame, pivots: np.ndarray, metric: str, dims: int) -> Cells:
    """Counts and ranges of all cells, combined per batch; at most CELLS rows reach the driver."""
    n_marks = min(MARKS, len(pivots))

    def describe(batches):
        for b in batches:
            cell = b.column(0).to_numpy()
            order = np.argsort(cell, kind="stable")
            x, _ = _points(_matrix(b.column(1).to_pylist(), [None] * b.num_rows, dims), metric)
            d = _apart(x, pivots)
            d = np.hstack((d[:, :n_marks], d[np.arange(len(x)), np.minimum(cell, len(pivots) - 1)][:, None]))[order]
            at = np.flatnonzero(np.diff(cell[order], prepend=-1))
            if len(at):
                low, high = np.minimum.reduceat(d, at), np.maximum.reduceat(d, at)
                yield pa.RecordBatch.from_arrays([pa.array(cell[order][at]), pa.array(np.diff(np.append(at, len(cell))))] + [pa.array(c) for m in (low, high) for c in m.T], names)

    names = ["cell", "n", *[f"{s}{j}" for s in ("low", "high") for j in range(n_marks + 1)]]
    rows = held.select("cell", "v").mapInArrow(describe, ", ".join(f"{n} {'int' if n == 'cell' else 'long' if n == 'n' else 'double'}" for n in names))
    found = rows.groupBy("cell").agg(F.sum("n"), *[F.min(c) for c in names if c.startswith("low")], *[F.max(c) for c in names if c.startswith("high")]).collect()
    counts = np.zeros(len(pivots) + 1, np.int64)
    low, high = np.zeros((len(pivots) + 1, n_marks + 1)), np.zeros((len(pivots) + 1, n_marks + 1))
    for cell, n, *ranges in found:
        counts[cell], low[cell], high[cell] = n, ranges[:n_marks + 1], ranges[n_marks + 1:]
    return Cells(pivots, metric, counts, low, high)


def _visits(asked: DataFrame, cells: Cells, k: int, dims: int) -> DataFrame:
    """`query_id`, `v`, `cell`: what each query visits. `edge` is the distance of its k-th document so far: null on the
    first visit, then all cells that may hold a nearer one and weren't visited; infinite if there are fewer than k."""
    def visit(batches):
        for b in batches:
            for at in range(0, b.num_rows, QUERY_BLOCK):
                part = b.slice(at, QUERY_BLOCK)
                bounds = cells.bounds(_matrix(part.column(1).to_pylist(), part.column(0).to_pylist(), dims))
                first = cells.first(bounds, k)
                edge = part.column(2).to_numpy(zero_copy_only=False).astype(float)[:, None]
                # A hair more than the edge, for what rounding may have taken from the bounds.
                go = np.where(np.isnan(edge), first, ~first & np.isfinite(bounds) & (bounds <= edge * (1 + 1e-9) + 1e-9))
                row, cell = np.nonzero(go)
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(taken), part.column(1).take(taken), pa.array(cell.astype(np.int32))], ["query_id", "v", "cell"])

    return asked.mapInArrow(visit, T.StructType([*asked.schema.fields[:2], T.StructField("cell", T.IntegerType())]))


def _sides(held: DataFrame, visits: DataFrame, cells: Cells, dims: int) -> tuple[DataFrame, DataFrame]:
    """The rows that meet, by `cell`, `part`, `chunk`: a group has one part of a cell and one chunk of its visitors."""
    rows = max(1, BLOCK_NUMBERS // max(dims, 1))
    asks = visits.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(QUERY_BLOCK)).cast("int").alias("chunks"))
    parts = held.sparkSession.createDataFrame([(c, -(-int(n) // rows)) for c, n in enumerate(cells.counts.tolist()) if n], "cell int, parts int")
    plan = F.broadcast(staged(asks.join(parts, "cell"), "cell-plan"))  # a row per cell
    left = held.join(plan, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id", "v")
    right = visits.join(plan, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int").alias("chunk"), "query_id", "v")
    return left, right


def _cells_of(side: DataFrame, metric: str, dims: int, n_cells: int) -> tuple[DataFrame, Cells]:
    """Documents sorted into cells, and what is known of the cells."""
    drawn = side.select("v").where(F.size("v") == dims).orderBy(F.xxhash64("id"), "id").limit(n_cells).collect()
    pivots, lost = _points(_matrix([r["v"] for r in drawn], [None] * len(drawn), dims), metric)
    pivots = np.unique(pivots[~lost], axis=0) if not lost.all() else np.zeros((1, dims))
    held = _sorted_into_cells(side, pivots, metric, dims)
    return held, _described_cells(held, pivots, metric, dims)


def _visited_share(sorted_cells: tuple[DataFrame, Cells], some: list, k: int, metric: str, schema: T.StructType, dims: int) -> float:
    """Share of the documents that some queries have to visit; it chooses the plan, not the answer."""
    held, cells = sorted_cells
    edge = dict.fromkeys((r["query_id"] for r in some), np.inf)
    order = W.partitionBy("query_id").orderBy("distance")
    hits = _scan(held.select("id", "v"), some, k, metric, schema).withColumn("_r", F.row_number().over(order))
    edge.update({r["query_id"]: r["distance"] for r in hits.where(F.col("_r") == k).collect()})
    bounds = cells.bounds(_matrix([r["v"] for r in some], [r["query_id"] for r in some], dims))
    go = bounds <= np.array([edge[r["query_id"]] for r in some])[:, None]
    return float((go * cells.counts).sum() / max(1, len(some) * cells.counts.sum()))


def search_cells(side: DataFrame, asked: DataFrame, k: int, metric: str, schema: T.StructType, dims: int, n_cells: int,
                 sorted_cells: tuple[DataFrame, Cells] | None = None) -> DataFrame:
    """Exact search that skips: (query_id, id, distance) with each query's k nearest among what it visited.

    Documents are sorted into cells by their nearest pivot, once. Of each cell the least and largest distances to some
    pivots are kept, a table of fixed size; the triangle inequality turns it into a bound for each query and cell. A query
    first visits the cells with the smallest bounds that hold k documents, which gives it an edge, and then only those
    whose bound is within the edge. So a document is sent once for each chunk of queries that visits its cell, not for
    each chunk of all queries; where vectors have no clusters, few cells are skipped.
    """
    held, cells = sorted_cells or _cells_of(side, metric, dims, n_cells)
    unknown = asked.select("query_id", "v", F.lit(None).cast("double").alias("edge"))

    def compared(visits: DataFrame) -> DataFrame:
        left, right = _sides(held, visits, cells, dims)
        by = ["cell", "part", "chunk"]
        return staged(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_compared(k, metric, dims), schema), "cell-hits")

    near = compared(staged(_visits(unknown, cells, k, dims), "cell-visits"))
    order = W.partitionBy("query_id").orderBy("distance", "id")
    edges = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == k).select(F.col("query_id").alias("_q"), F.col("distance").alias("edge"))
    again = asked.join(edges, F.col("query_id") == F.col("_q"), "left").select("query_id", "v", F.coalesce("edge", F.lit(float("inf"))).alias("edge"))
    far = compared(staged(_visits(again, cells, k, dims), "cell-visits"))
    return near.unionByName(far)


def semantic_search(docs: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.7, **kw) -> DataFrame:
    """RAG-05: of the 2k nearest, those with score >= threshold, at most k."""
    return nearest(docs, queries, 2 * k, **kw).filter((F.col("score") >= threshold) & (F.col("rank") <= k))


def similar_documents(docs: DataFrame, ids: DataFrame | Sequence, k: int = 5, *, id_col: str = "id", vector: str = "embedding", **kw) -> DataFrame:
    """RAG-06: the k nearest other documents of each given document; an unknown id is an error."""
    if not isinstance(ids, DataFrame):
        kind = docs.schema[id_col].dataType
        ids = docs.sparkSession.createDataFrame([(i,) for i in ids], T.StructType([T.StructField(id_col, kind)]))
    asked = ids.select(col(id_col).alias("_id")).distinct()
    unknown = asked.join(docs.select(col(id_col).alias("_id")), "_id", "left_anti").limit(5).collect()
    if unknown:
        raise ValueError(f"unknown documents: {[r[0] for r in unknown]}")
    queries = docs.join(asked, col(id_col) == F.col("_id"), "left_semi").select(col(id_col).alias("query_id"), col(vector).alias("query_vector"))
    hits = nearest(docs, queries, k + 1, id_col=id_col, vector=vector, **kw).filter(F.col("query_id") != col(id_col))
    again = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))  # at most k + 1 rows per query
    return hits.withColumn("rank", again).filter(F.col("rank") <= k)


def cosine_search(docs: DataFrame, queries: DataFrame, k: int = 3, above: float = 0.3, **kw) -> DataFrame:
    """RAG-07: the k documents of highest cosine similarity, if above the bound."""
    return nearest(docs, queries, k, metric="cosine", **kw).filter(F.col("score") > above)


def similar_questions(history: DataFrame, questions: DataFrame, k: int = 3, *, id_col: str = "id", text: str = "text", vector: str = "embedding") -> DataFrame:
    """RAG-12: the k earlier questions most similar to each given one, equal texts left out.

    `questions`: (query_id, text, query_vector). Copies of a question may be many, so equal texts are folded into their
    first row before the search; then at most one hit per question is its own text.
    """
    folded = history.groupBy(col(text)).agg(F.min_by(col(vector), col(id_col)).alias(vector), F.min(col(id_col)).alias(id_col))
    hits = nearest(folded, questions, k + 1, metric="cosine", id_col=id_col, vector=vector, keep=[text])
    asked = questions.select(F.col("query_id").alias("_q"), col(text).alias("_t"))
    other = hits.join(asked, (F.col("query_id") == F.col("_q")) & (col(text) != F.col("_t"))).drop("_q", "_t")
    again = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))  # at most k + 1 rows per question
    return other.withColumn("rank", again).filter(F.col("rank") <= k).withColumnRenamed("score", "similarity").drop("distance")


def keyword_search(docs: DataFrame, queries: Sequence[str], k: int = 3, *, id_col: str = "id", text: str = "content") -> DataFrame:
    """RAG-08: (query, rank, id): the first k documents, by id, that contain any word of the query."""
    low = F.lower(col(text))
    hit = {}
    for q in queries:
        any_word = F.lit(False)
        for w in dict.fromkeys(q.lower().split()):
            any_word = any_word | low.contains(w)
        hit[q] = any_word
    # not a higher-order function, so that the matching is compiled
    found = F.array_remove(F.array(*[F.when(m, F.lit(q)).otherwise(F.lit("")) for q, m in hit.items()]), "")
    order = W.partitionBy("query").orderBy(id_col)
    return spread(docs.select(id_col, text)).select(F.explode(found).alias("query"), col(id_col)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "rank", col(id_col))


# --- collection upkeep ----------------------------------------------------------------------------------------------

def add_documents(collection: DataFrame, new: DataFrame, *, id_col: str = "id", text: str = "content", least: int = 10) -> DataFrame:
    """RAG-02: append documents whose id is new and whose text has at least `least` characters between white space.

    Of new documents with one id, the one whose text comes first in order is added, then whose other columns do.
    """
    long = new.filter(F.length(F.btrim(col(text), F.lit(" \t\n\r\f\v"))) >= least)
    # Columns without an order, such as maps, come in as text.
    order = F.struct(col(text), *[F.to_json(col(f.name)) if isinstance(f.dataType, (T.MapType, T.VariantType)) else col(f.name) for f in new.schema if f.name not in (id_col, text)])
    fresh = long.groupBy(col(id_col).alias("_id")).agg(F.min_by(F.struct(*[col(c) for c in new.columns]), order).alias("_first")).select("_first.*")
    fresh = fresh.join(collection.select(col(id_col)), id_col, "left_anti")
    return collection.unionByName(fresh.select(*[col(c) for c in fresh.columns]), allowMissingColumns=True)


def collection_totals(collection: DataFrame, kind: Column, text: str = "content") -> DataFrame:
    """RAG-02 totals: documents, characters and their types; one value lists all types, see `collection_types`."""
    return _with_types(collection, kind, [F.count(F.lit(1)).alias("documents"), F.sum(F.length(col(text))).alias("characters")], [F.sum("documents"), F.sum("characters")])


def _with_types(collection: DataFrame, kind: Column, per_type: Sequence[Column], whole: Sequence[Column]) -> DataFrame:
    """One row from a row per type: the totals, and the types that are not null in order."""
    counted = collection.groupBy(kind.alias("_type")).agg(*per_type)
    names = counted.columns[1:]
    return counted.agg(*[w.alias(n) for w, n in zip(whole, names)], F.array_join(F.sort_array(F.collect_list("_type")), ",").alias("types")).withColumn(
        "documents", F.coalesce("documents", F.lit(0)))


def collection_types(collection: DataFrame, kind: Column, updated: Column) -> DataFrame:
    """RAG-11: a row per type, null included, in order: `type`, `documents`, `last_updated`. For any number of types."""
    return collection.groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("documents"), F.max(updated).alias("last_updated")).orderBy("type")


def update_documents(collection: DataFrame, updates: DataFrame, *, id_col: str = "id", text: str = "content", vector: str | None = None,
                     metadata: str | None = None) -> DataFrame:
    """RAG-09: new text, vector and, where given, metadata; unknown ids change nothing."""
    fields = [f for f in (text, vector, metadata) if f]
    side = updates.select(col(id_col).alias("_id"), F.lit(True).alias("_hit"), *[col(f).alias(f"_{f}") for f in fields])
    joined = collection.join(side, col(id_col) == F.col("_id"), "left")
    return joined.select(*[
        F.coalesce(col(f"_{c}"), col(c)).alias(c) if c == metadata
        else F.when(F.col("_hit"), col(f"_{c}")).otherwise(col(c)).alias(c) if c in fields else col(c)
        for c in collection.columns
    ])


def delete_documents(collection: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """RAG-10"""
    return collection.join(ids.select(col(id_col)), id_col, "left_anti").select(*[col(c) for c in collection.columns])


def clear(collection: DataFrame) -> DataFrame:
    """RAG-10: no rows, same schema."""
    return collection.limit(0)


def collection_info(collection: DataFrame, kind: Column, updated: Column) -> DataFrame:
    """RAG-11: one row; its `types` lists all of them in one value, see `collection_types`."""
    return _with_types(collection, kind, [F.count(F.lit(1)).alias("documents"), F.max(updated).alias("last_updated")], [F.sum("documents"), F.max("last_updated")])


# --- query log and context ------------------------------------------------------------------------------------------

def query_statistics(log: DataFrame, seconds: str = "seconds", by: Sequence[str] = ()) -> DataFrame:
    """RAG-13: number of queries, total and mean time."""
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), F.sum(col(seconds)).alias("total_seconds"), F.avg(col(seconds)).alias("mean_seconds"))


def last_queries(log: DataFrame, at: str, n: int = 10, then: Sequence[str] | None = None) -> DataFrame:
    """RAG-13: the last n rows; rows of the same time in the order of `then`, by default of all columns that have one."""
    plain = [f.name for f in log.schema if f.name != at and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return log.orderBy(F.desc(at), *[col(c) for c in (plain if then is None else then)]).limit(n)


def context_strings(results: DataFrame, n: int = 3, *, query_id: str = "query_id", text: str = "content") -> DataFrame:
    """RAG-14: the first n contents per query, joined by line breaks."""
    first = results.filter(F.col("rank") <= n)  # collect_list holds n entries
    ordered = F.array_sort(F.collect_list(F.struct(F.col("rank"), col(text).alias("t"))))
    return first.groupBy(col(query_id)).agg(F.array_join(F.transform(ordered, lambda s: s["t"]), "\n").alias("context"))


def _line() -> Column:
    return F.concat_ws(": ", "label", F.coalesce(col("value"), F.lit("N/A")))


def fact_rows(facts: DataFrame, order_by: str = "position", by: Sequence[str] = ()) -> DataFrame:
    """RAG-14: "label: value" lines, a row each, sorted by range over the cluster. For tables of any length."""
    return facts.select(*[col(c) for c in (*by, order_by)], _line().alias("line")).orderBy(*by, order_by, "line")


def fact_lines(facts: DataFrame, order_by: str = "position", by: Sequence[str] = ()) -> DataFrame:
    """RAG-14: the lines of a result table (label, value, position) joined by line breaks. A group, or without `by` the
    table, becomes one value; `fact_rows` keeps lines as rows."""
    lines = F.array_sort(F.collect_list(F.struct(col(order_by).alias("o"), _line().alias("t"))))
    return facts.groupBy(*by).agg(F.array_join(F.transform(lines, lambda s: s["t"]), "\n").alias("context"))
