"""Passages that occur more than once, found by anchors at the places of a difference cover."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import staged
from .common import WHITE, key_filter, with_filter, word_count
from .shingles import hash_words, pieces, places, runs

WINDOW = 35
# For any two numbers of words i and j there is a d below the period with (i+d) and (j+d) modulo the period both in the
# cover. So two equal runs of `window` words share an anchor of window − period + 1 words at the same offset.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
# Bytes of text whose equal hashes are combined before they are shuffled.
TOGETHER = 1 << 24


def _combine(hashes: list[np.ndarray], keys: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """One row for each different hash of a piece: the hash, how often it occurs, one key, the other keys if any."""
    order = np.lexsort((keys, *hashes[::-1]))
    hashes, keys = [h[order] for h in hashes], keys[order]
    new = np.concatenate(([True], np.any([h[1:] != h[:-1] for h in hashes], axis=0))) if len(order) else np.empty(0, bool)
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(order)))
    other = ~new
    if len(order):
        other[1:] &= keys[1:] != keys[:-1]  # a key once for each hash
    offsets = np.append(0, np.cumsum(np.add.reduceat(other, at))) if len(at) else np.zeros(1, np.int64)
    mask = np.append(np.diff(offsets) == 0, False)
    more = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=mask), pa.array(keys[other], pa.int64()))
    columns = [*(pa.array(h[at].view(np.int64)) for h in hashes), pa.array(counts, pa.int64()), pa.array(keys[at], pa.int64()), more]
    return pa.RecordBatch.from_arrays(columns, names=[*names, "n", "key", "more"])


def _cover_places(offsets: np.ndarray, window: int, period: int, cover: tuple[int, ...]) -> np.ndarray:
    """Where anchors begin: cover places, counted within each text, of texts that hold a window."""
    anchor = window - period + 1
    at, n = places(offsets, anchor)
    long = np.diff(offsets) >= window
    keep = np.zeros(period, bool)
    keep[list(cover)] = True
    within = at - np.repeat(offsets[:-1], n)
    return at[np.repeat(long, n) & keep[within % period]]


def _owner(at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, at, "right") - 1


def _anchor_rows(window: int, period: int, cover: tuple[int, ...]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "_text", TOGETHER):
            words, offsets = hash_words(texts)
            at = _cover_places(offsets, window, period, cover)
            keys = batch.column(batch.schema.get_field_index("_key")).to_numpy()
            yield _combine([runs(words, at, window - period + 1)], keys[_owner(at, offsets)], ["h"])

    return rows


def _listed(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.unique(batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)).view(np.uint64)


def _window_rows(window: int, period: int, cover: tuple[int, ...]):
    anchor = window - period + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "_text", TOGETHER):
            words, offsets = hash_words(texts)
            at = _cover_places(offsets, window, period, cover)
            at = at[np.isin(runs(words, at, anchor), _listed(batch, "hs"))]
            # Extend: every window that holds a repeated anchor is a candidate.
            starts, _ = places(offsets, window)
            held = np.zeros(len(words) + 1, np.int64)
            np.add.at(held, np.maximum(at - (window - anchor), 0), 1)
            np.add.at(held, np.minimum(at + 1, len(words)), -1)
            starts = starts[np.cumsum(held)[starts] > 0] if len(starts) else starts
            keys = batch.column(batch.schema.get_field_index("_key")).to_numpy()
            yield _combine([runs(words, starts, window), runs(words, starts, window, salt=1)], keys[_owner(starts, offsets)], ["h", "h2"])

    return rows


def _kept_rows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "_text"):
            words, offsets = hash_words(texts)
            starts, _ = places(offsets, window)
            starts = starts[np.isin(runs(words, starts, window), _listed(batch, "hs"))]
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + window, -1)
            gone = np.cumsum(gone)[:-1] > 0
            kept = [b" ".join(w for w, g in zip(t.split(), gone[a:b].tolist()) if not g).decode() for t, a, b in zip(texts, offsets, offsets[1:])]
            removed = [int(gone[a:b].sum()) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                             names=["_id", "n_words", "n_removed", "kept"])

    return rows


def _repeated(combined: DataFrame, by: list[str], label: str) -> DataFrame:
    """`_key`, `hs`: for each document the hashes that occur more than once in all."""
    total = F.sum("n").over(Window.partitionBy(*by))
    rows = combined.withColumn("n", total).where("n > 1").select("h", F.explode(F.concat(F.array("key"), F.coalesce("more", F.array().cast("array<bigint>")))).alias("_key"))
    return staged(rows.groupBy("_key").agg(F.collect_set("h").alias("hs")), label)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """One row per document: id, `n_words`, `n_removed` and `kept`, the words that stay, joined by one space.

    Words are runs of anything but ASCII white space. A word goes if it is in a run of `window` words that also begins
    anywhere else in the table, in the same document too. Null and empty texts have no words; rows that repeat a
    document repeat its runs; ids need not be unique or non-null; other columns are ignored.

    Anchors of window − period + 1 words are hashed at cover places only, a quarter of all. Anchors that occur once need
    no more work. Documents with others come back, and each window around such an anchor is judged by 128 bits. Hashes
    that meet in one task are combined first, so a passage that fills the table adds a row per 16 MB of text.
    """
    if window < period:
        raise ValueError("the window must be as long as the period at least")
    if {(i - j) % period for i in cover for j in cover} != set(range(period)):
        raise ValueError("the cover must hold every difference modulo the period")
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("_id"), text.alias("_text")).withColumn("_key", F.xxhash64("_id", "_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    anchors = rows.select("_key", "_text").mapInArrow(_anchor_rows(window, period, cover), "h long, n long, key long, more array<long>")
    at_anchor = _repeated(anchors, ["h"], "repeat-anchors")
    near = with_filter(rows, F.col("_key"), key_filter(at_anchor, F.col("_key")), "_near").where("_near").drop("_near")
    windows = near.join(at_anchor, "_key").select("_key", "_text", "hs").mapInArrow(_window_rows(window, period, cover), "h long, h2 long, n long, key long, more array<long>")
    found = _repeated(windows, ["h", "h2"], "repeat-windows")

    rows = with_filter(rows, F.col("_key"), key_filter(found, F.col("_key")), "_near")

    def untouched(df: DataFrame) -> DataFrame:
        return df.select("_id", word_count(F.col("_text")).alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.trim(F.regexp_replace("_text", WHITE, " ")).alias("kept"))

    touched = rows.where("_near").join(found, "_key", "left")
    cut = touched.where("hs IS NOT NULL").select("_id", "_text", "hs").mapInArrow(_kept_rows(window), f"_id {kind}, n_words long, n_removed long, kept string")
    out = untouched(rows.where("NOT _near")).unionByName(untouched(touched.where("hs IS NULL"))).unionByName(cut)
    return out.withColumnRenamed("_id", id_column)
