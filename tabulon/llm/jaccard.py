"""Similarity join on word shingles: MinHash candidates, pruned by posterior probability, the rest verified exactly."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import few_parts, staged
from .common import key_filter, tidy, with_filter
from .components import components
from .shingles import hash_words, mixed, pieces, runs

WORDS, THRESHOLD = 5, 0.8
# 32 bands of 4 values: a pair at similarity 0.8 shares no band with a probability of 5e-8.
BANDS, BAND_ROWS = 32, 4
HASHES = BANDS * BAND_ROWS
# Values compared at a time; a pair is dropped when its chance of reaching the threshold falls below the tolerance.
STEP, TOLERANCE = 16, 1e-7
# Documents of a bucket, and of a component, that one task compares with as many others.
BUCKET_BLOCK, BLOCK = 512, 128
# Rows, but whole groups, and pairs that a task holds at a time.
ROWS, PAIRS = 1024, 1 << 16
_RNG = np.random.default_rng(777)
_TIMES = (_RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1))
_PLUS = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each text, sorted, one text after another, and where each text's begin.

    A text of fewer than `n` words has one shingle, all its words; one without words has none.
    """
    words, offsets = hash_words(texts)
    sets = []
    for a, b in zip(offsets, offsets[1:]):
        w = words[a:b]
        if len(w) >= n:
            sets.append(np.unique(runs(w, np.arange(len(w) - n + 1), n)))
        else:
            sets.append(runs(w, np.zeros(1, np.int64), len(w)) if len(w) else w)
    return (np.concatenate(sets) if sets else words), np.cumsum([0, *map(len, sets)])


def signatures(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """HASHES minima per set; sets must not be empty."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offsets) - 1, HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(low * _TIMES[k] + _PLUS[k], offsets[:-1])
    return out


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """For n = STEP, 2·STEP, …: the fewest equal values of n with which a pair stays.

    With a uniform prior, m equal values of n make P(similarity ≥ t) = P(Binomial(n + 1, t) ≤ m).
    """
    need = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        need.append(m)
    return need


def surviving_pairs(sig: np.ndarray, i: np.ndarray, j: np.ndarray, need: list[int], band: np.ndarray | None = None) -> np.ndarray:
    """Which of the pairs (i, j) of rows stay; a pair that shares a band before its `band` is left to that one."""
    left, m = np.arange(len(i)), np.zeros(len(i), np.int64)
    for step, least in enumerate(need):
        part = slice(step * STEP, (step + 1) * STEP)
        m = m + (sig[i[left], part] == sig[j[left], part]).sum(1)
        stay = m >= least
        left, m = left[stay], m[stay]
    for k in range(int(band.max()) if band is not None and len(band) else 0):
        part = slice(k * BAND_ROWS, (k + 1) * BAND_ROWS)
        left = left[(band[left] <= k) | ~(sig[i[left], part] == sig[j[left], part]).all(1)]
    return left


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest place that each of n places is connected with."""
    label = np.arange(n)
    while len(i):
        old = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == old).all():
            break
    return label


def _described(n: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "_text"):
            shingles, offsets = shingle_sets(texts, n)
            sizes = np.diff(offsets)
            full = np.flatnonzero(sizes)
            sig = np.zeros((len(texts), HASHES), np.uint32)
            digest = np.zeros((2, len(texts)), np.uint64)
            if len(full):
                starts = offsets[:-1][full]
                sig[full] = signatures(shingles, np.append(starts, offsets[-1]))
                digest[0, full] = np.add.reduceat(mixed(shingles), starts)
                digest[1, full] = np.add.reduceat(mixed(shingles ^ np.uint64(0x5BF03635)), starts)
            bands = np.zeros((len(texts), BANDS), np.uint64)
            for k in range(BAND_ROWS):
                bands = mixed(bands + sig.reshape(-1, BANDS, BAND_ROWS)[:, :, k] + np.uint64(k << 32))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(batch.num_columns) if batch.schema.names[k] != "_text"), pa.array(sizes, pa.int64()),
                 pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), pa.array([s.tobytes() for s in sig], pa.binary()), listed],
                names=[x for x in batch.schema.names if x != "_text"] + ["_n", "_d1", "_d2", "_sig", "_bands"])

    return tidy(rows)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, HASHES)


def _whole_groups(pdfs: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted rows, cut only between groups, and where groups begin. A group has two blocks at most, so little waits."""
    rest = None
    for p in pdfs:
        p = p if rest is None else pd.concat([rest, p], ignore_index=True)
        if len(p):
            new = np.ones(len(p), bool)
            new[1:] = np.any([p[k].to_numpy()[1:] != p[k].to_numpy()[:-1] for k in keys], axis=0)
            starts = np.flatnonzero(new)
            at = 0
            while at < len(starts) - 1:  # the last group may go on in the next batch
                end = max(at + 1, int(np.searchsorted(starts[:-1], starts[at] + ROWS, "right")) - 1)
                yield p.iloc[starts[at]:starts[end]].reset_index(drop=True), starts[at:end] - starts[at]
                at = end
            rest = p.iloc[starts[-1]:]
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True), np.zeros(1, np.int64)


def _pairs(p: pd.DataFrame, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs to compare: within a block, or between the group's two blocks (the first comes first)."""
    first = np.repeat(starts, np.diff(np.append(starts, len(p))))
    here = p["block"].to_numpy() == p["i"].to_numpy()
    ahead = np.repeat(np.add.reduceat(here.astype(np.int64), starts), np.diff(np.append(starts, len(p))))
    same = p["i"].to_numpy() == p["j"].to_numpy()
    n = np.where(same, np.arange(len(p)) - first, np.where(here, 0, ahead))
    upto = np.cumsum(n)
    at = 0
    while at < len(p):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        c = n[at:end]
        a = np.repeat(np.arange(at, end), c)
        yield a, np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c) + first[a]
        at = end


def _trees(rep: np.ndarray, label: np.ndarray) -> pd.DataFrame:
    """Each document and the smallest one that it is connected with here."""
    low = np.full(len(rep), np.iinfo(np.int64).max)
    np.minimum.at(low, label, rep)
    return pd.DataFrame({"a": rep, "b": low[label]})


def _compare_buckets(need: list[int]):
    def compare(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p, starts in _whole_groups(pdfs, ["band", "value", "i", "j"]):
            sig, band, rep = _matrix(p["sig"]), p["band"].to_numpy(), p["rep"].to_numpy()
            found = []
            for i, j in _pairs(p, starts):
                stay = surviving_pairs(sig, i, j, need, band[i])
                found.append((i[stay], j[stay]))
            trees = _trees(rep, forest(len(p), *map(np.concatenate, zip(*found))))
            yield trees[trees["a"] != trees["b"]]

    return tidy(compare)


def _in_common(shingles: np.ndarray, offsets: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Shingles that the pairs of one group's documents have in common."""
    low, high = int(min(i.min(), j.min())), int(max(i.max(), j.max())) + 1
    _, place = np.unique(shingles[offsets[low]:offsets[high]], return_inverse=True)
    own = offsets[low:high + 1] - offsets[low]
    has, out = np.zeros(int(place.max()) + 1, np.int64), np.empty(len(i), np.int64)
    bounds = np.flatnonzero(np.diff(i, prepend=-1))
    for s, e in zip(bounds, np.append(bounds[1:], len(i))):
        mine = place[own[i[s] - low]:own[i[s] - low + 1]]
        has[mine] = 1
        out[s:e] = np.add.reduceat(has[place], own[:-1])[j[s:e] - low]
        has[mine] = 0
    return out


def _verify_blocks(n: int, threshold: float, need: list[int]):
    def verify(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p, starts in _whole_groups(pdfs, ["label", "i", "j"]):
            shingles, offsets = shingle_sets([t.encode() for t in p["text"]], n)
            sig, sizes, rep, m = signatures(shingles, offsets), np.diff(offsets), p["rep"].to_numpy(), p["m"].to_numpy()
            links, found = np.zeros(len(p), np.int64), [(np.zeros(0, np.int64),) * 2]
            for i, j in _pairs(p, starts):
                stay = surviving_pairs(sig, i, j, need)
                i, j = i[stay], j[stay]
                group = np.searchsorted(starts, i, "right")
                cuts = np.flatnonzero(np.diff(group, prepend=-1))
                for s, e in zip(cuts, np.append(cuts[1:], len(i))):
                    a, b = i[s:e], j[s:e]
                    common = _in_common(shingles, offsets, a, b)
                    near = common / (sizes[a] + sizes[b] - common) >= threshold
                    found.append((a[near], b[near]))
            i, j = map(np.concatenate, zip(*found))
            np.add.at(links, i, m[j])
            np.add.at(links, j, m[i])
            yield _trees(rep, forest(len(p), i, j)).assign(links=links)

    return tidy(verify)


def _block_pairs(df: DataFrame, size: Column, limit: int) -> DataFrame:
    """Each row once for each pair of blocks that its block is in; `block` is its own, `i` ≤ `j` the pair."""
    df = df.withColumn("_blocks", F.ceil(size / F.lit(float(limit))).cast("int"))
    df = df.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int"))
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return df.withColumn("i", F.least("block", "_other")).withColumn("j", F.greatest("block", "_other")).drop("_other", "_blocks")


def similar_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: id, `class_id`, `class_size`, `n_links`, `kept`.

    Two documents are linked when the Jaccard similarity of their sets of `words`-word shingles reaches the threshold.
    `n_links` counts a document's links, copies included; a class is a set of documents connected by links, its id the
    smallest document id (null ids last). One document of each class has `kept`: the one with that id, the first in file
    order among several. Words are runs of anything but ASCII white space; fewer than `words` words make one shingle;
    a document without words (null, empty) has no links and a class of its own.

    Documents with the same set are one representative. Representatives that share a band of MinHash values are compared
    16 values at a time and dropped when the posterior probability of reaching the threshold falls below `tolerance`;
    what is left joins documents into components, inside which survivors are verified on whole sets. Buckets and
    components are cut into blocks, and a task compares two blocks; it hands on sums and a spanning forest, never pairs.
    """
    return _described_and_classed(docs, id_column, text_column, words, threshold, tolerance)[1].drop("_row")


def drop_similar(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of `docs`, all columns, with one document of each class of similar ones."""
    options = {"words": WORDS, "threshold": THRESHOLD, "tolerance": TOLERANCE} | options
    said, classed = _described_and_classed(docs, id_column, text_column, **options, carry=F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    gone = staged(classed.where("NOT kept").select("_row"), "similar-gone", per_core=1)
    rows = with_filter(said.select("_row", "_carried"), F.xxhash64("_row"), key_filter(gone, F.xxhash64("_row")), "_hit")
    stay = rows.where("NOT _hit").unionByName(few_parts(rows.where("_hit").join(gone, "_row", "left_anti").select(*rows.columns), 4))
    return stay.select("_carried.*")


def _described_and_classed(docs: DataFrame, id_column: str, text_column: str, words: int, threshold: float, tolerance: float, carry: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The staged row, hashes and MinHash values of each document; and the result rows with `_row`."""
    need = least_matches(threshold, tolerance)
    text = F.coalesce(F.col(text_column), F.lit(""))
    extra = [carry.alias("_carried")] if carry is not None else []
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_column).alias("_id"), F.xxhash64(F.col(id_column), text).alias("_key"), *extra, text.alias("_text"))
    schema = T.StructType(rows.drop("_text").schema.fields + [T.StructField(x, T.LongType()) for x in ("_n", "_d1", "_d2")]
                          + [T.StructField("_sig", T.BinaryType()), T.StructField("_bands", T.ArrayType(T.LongType()))])
    said = staged(rows.mapInArrow(_described(words), schema), "similar-documents")

    first = F.min(F.struct(F.isnull("_id").alias("no"), F.col("_id").alias("id"), F.col("_row").alias("row"), F.col("_key").alias("key")))
    same = said.where("_n > 0").groupBy("_d1", "_d2").agg(first.alias("_first"), F.count("*").alias("m"), F.first("_sig").alias("sig"), F.first("_bands").alias("_bands"))
    reps = staged(same.select(F.col("_first.row").alias("rep"), "_first", "_d1", "_d2", "m", "sig", "_bands"), "similar-reps", per_core=1)

    bands = reps.select("rep", "sig", F.posexplode("_bands").alias("band", "value"))
    buckets = staged(bands.groupBy("band", "value").agg(F.count("*").alias("_c")).where("_c > 1"), "similar-buckets", per_core=1)
    value = F.xxhash64("band", "value")
    near = with_filter(bands, value, key_filter(buckets, value), "_hit").where("_hit").drop("_hit").join(buckets, ["band", "value"])
    near = _block_pairs(near, F.col("_c"), BUCKET_BLOCK).select("band", "value", "i", "j", "block", "rep", "sig")
    near = near.repartition("band", "value", "i", "j").sortWithinPartitions("band", "value", "i", "j", "block", "rep")
    likely = components(near.mapInPandas(_compare_buckets(need), "a long, b long"))

    sizes = likely.groupBy("label").agg(F.count("*").alias("_c"))
    found = likely.join(sizes, "label").withColumnRenamed("node", "rep").join(reps.select("rep", F.col("_first.key").alias("_key"), "m"), "rep")
    found = staged(found, "similar-found", per_core=1)
    texts = with_filter(rows.drop("_row"), F.col("_key"), key_filter(found, F.col("_key")), "_hit").where("_hit").select("_key", "_text")
    texts = texts.join(found, "_key").dropDuplicates(["rep"]).select("label", "_c", "rep", "m", F.col("_text").alias("text"))
    blocks = _block_pairs(texts, F.col("_c"), BLOCK).select("label", "i", "j", "block", "rep", "m", "text")
    blocks = blocks.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "block", "rep")
    links = staged(blocks.mapInPandas(_verify_blocks(words, threshold, need), "a long, b long, links long"), "similar-links", per_core=4)

    classes = components(links.select("a", "b"))
    counts = links.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("_links"))
    reps = reps.select("rep", "_first", "_d1", "_d2", "m").join(classes.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left")
    reps = staged(reps.withColumn("label", F.coalesce("label", "rep")), "similar-labelled", per_core=1)
    heads = reps.groupBy("label").agg(F.min("_first").alias("_head"), F.sum("m").alias("_size"))
    named = reps.join(heads, "label").select("_d1", "_d2", F.col("_head.id").alias("_class"), F.col("_head.row").alias("_kept"), "_size", (F.coalesce("_links", F.lit(0)) + F.col("m") - 1).alias("_links"))
    named = staged(named, "similar-named", per_core=1)

    out = said.where("_n > 0").select("_row", "_id", "_d1", "_d2").join(named, ["_d1", "_d2"]).select(
        "_row", F.col("_id").alias(id_column), F.col("_class").alias("class_id"), F.col("_size").cast("long").alias("class_size"),
        F.col("_links").cast("long").alias("n_links"), (F.col("_row") == F.col("_kept")).alias("kept"))
    bare = said.where("_n = 0").select("_row", F.col("_id").alias(id_column), F.col("_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"),
                                       F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return said, out.unionByName(bare)
