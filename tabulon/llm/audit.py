"""How filters interact: each order of applying them, read from the lattice of the subsets already applied."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import staged
from .shingles import raw_texts

# Fixed values of the filters.
FEW_WORDS = 50
DISTINCT_PERCENT = 65
UPPER_PERCENT = 5
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = b"#$%&*|"
FILTERS = "ABCDE"
# k filters have 2^k states and k! orders; both are part of the result, so k has a bound.
MOST_FILTERS = 7


def lattice(k: int) -> list[tuple[int, int, int, int]]:
    """Edges (state, filter, ways in, ways out): in how many orders the filters of `state` are applied first, and in how
    many those after `filter` follow. A state is the bitmap of the filters applied; each order is a path from 0 to all.

    Both counts go along the edges: forward from the empty state, backward from the full one.
    """
    full = (1 << k) - 1
    into, out = [0] * (full + 1), [0] * (full + 1)
    into[0] = out[full] = 1
    for state in range(full + 1):
        for f in range(k):
            if not state >> f & 1:
                into[state | 1 << f] += into[state]
    for state in range(full, -1, -1):
        for f in range(k):
            if not state >> f & 1:
                out[state] += out[state | 1 << f]
    return [(s, f, into[s], out[s | 1 << f]) for s in range(full + 1) for f in range(k) if not s >> f & 1]


def interactions(counts: DataFrame, filters: Sequence[str] = FILTERS, measures: Sequence[str] = ("good", "toxic")) -> DataFrame:
    """One row per part, order of the filters and step, from `part`, `mask`, `n` and counts named in `measures`.

    Bit f of `mask` says that the documents fail filter f; rows of one part and mask are added up. Columns: `part`,
    `filter_order`, `step`, `kept`, `removed`, `redundant`, `unique_fails`, `<measure>_lost` and `shapley`, the removals
    of the step's filter added up over all orders: each edge of the lattice counts (ways in) × (ways out) times.

    The rows that move are at most 2^k a part, whatever the number of documents.
    """
    if not 0 < len(filters) <= MOST_FILTERS or len(set(filters)) < len(filters):
        raise ValueError(f"1 to {MOST_FILTERS} different filters are expected")
    counts = counts.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", *measures)])
    edges = [F.struct(F.lit(s).alias("state"), F.lit(f).alias("f"), F.lit(a * b).cast("long").alias("paths")) for s, f, a, b in lattice(len(filters))]
    rows = counts.withColumn("_e", F.explode(F.array(*edges))).select("*", "_e.*").drop("_e")
    bit = F.expr("shiftleft(1, f)")
    fails, reached = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(F.col("state")) == 0
    total = lambda c, what: F.sum(F.when(c, F.col(what)).otherwise(0)).cast("long")
    rows = rows.groupBy("part", "state", "f", "paths").agg(
        total(reached & ~fails, "n").alias("kept"), total(reached & fails, "n").alias("removed"), total(fails & ~reached, "n").alias("redundant"),
        total(F.col("mask") == bit, "n").alias("unique_fails"), *[total(reached & fails, m).alias(f"{m}_lost") for m in measures],
    )
    rows = staged(rows, "audit-edges")
    value = rows.groupBy("part", "f").agg(F.sum(F.col("paths") * F.col("removed")).cast("long").alias("shapley"))
    steps = []
    for order in permutations(range(len(filters))):
        state = 0
        for k, f in enumerate(order):
            steps.append(("".join(filters[i] for i in order), k + 1, state, f))
            state |= 1 << f
    steps = counts.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, f int")
    out = rows.join(value, ["part", "f"]).join(F.broadcast(steps), ["state", "f"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[f"{m}_lost" for m in measures], "shapley")


def _tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(2)
        masks, digests = [], []
        for raw, points in zip(raw_texts(text), pc.fill_null(pc.utf8_length(text), 0).to_pylist(), strict=True):
            words = raw.split()
            few = len(words) < FEW_WORDS
            same = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
            upper = 100 * (len(raw) - len(raw.translate(None, UPPER))) > UPPER_PERCENT * points
            signs = len(raw.translate(None, SIGNS)) < len(raw)
            masks.append(few | same << 1 | upper << 2 | signs << 3)
            digests.append(hashlib.sha256(raw).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["id", "part", "mask", "digest"])


def failed_filters(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """One row per document: `id`, `part` (null: empty), `mask`, bit 0 to 4 for the filters A to E it fails.

    A: few words. B: few distinct words. C: many capitals. D: signs of markup. E: the text is also that of a smaller id.
    Null is an empty text. Rows of one id don't repeat each other, a null id is neither smaller nor larger than any.

    Texts are read once and never move; equal ones meet as digests, and only digests of several rows are joined.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = staged(rows.mapInArrow(_tested, f"id {kind}, part string, mask int, digest binary"), "audit-rows")
    first = rows.groupBy("digest").agg(F.min("id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    rows = rows.join(first, "digest", "left")
    again = F.coalesce(F.col("id") > F.col("_first"), F.lit(False))
    return rows.select("id", "part", F.col("mask").bitwiseOR(F.when(again, 16).otherwise(0)).alias("mask"))


def audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """The interactions of the five filters on `docs`, per part, with what they cost of the labelled documents.

    A document is good (toxic) if any row of `labels` with its id has quality (toxic) 1; repeated label rows count once.
    Repeated documents count each. No documents, no rows.
    """
    marks = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_label")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("long"), F.lit(0))).alias("_good"), F.max(F.coalesce((F.col("toxic") == 1).cast("long"), F.lit(0))).alias("_toxic"))
    rows = failed_filters(docs, id_column, text_column, part_column)
    rows = rows.join(marks, rows["id"] == marks["_label"], "left")
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("_good"), F.lit(0)).alias("good"), F.coalesce(F.sum("_toxic"), F.lit(0)).alias("toxic"))
    return interactions(counts)
