"""Scoring texts with an n-gram model whose counts lie in a log-frequency Bloom filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.sizes import broadcast_if_small
from ..session import staged
from .common import tidy
from .shingles import hash_words, mixed, pieces

ORDER = 2
# The filter takes about ten bits an entry, at most 2^28 bits (32 MB) in all and at least five an entry.
BITS_PER_ENTRY, MOST_BITS, LEAST_BITS_PER_ENTRY = 10, 1 << 28, 5
MOST_HASHES = 6
# Counts of a word or n-gram are kept by their interval between powers of this base.
BASE = 2.0
# Weight of the shorter context in words.
MASS = 64.0
# Words whose exact counts each task holds; the others are joined.
FREQUENT_WORDS = 1 << 17
# N-grams that a task gathers before it hands on their counts, and that meet in one shard, at most about.
GATHERED, PER_SHARD = 1 << 21, 1 << 22
# Bytes of the texts that ask together for the counts which the filter has no room for, about.
ASK_TOGETHER = 1 << 23
LEAST_SHARD_BITS, MOST_SHARD_BITS = 10, 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_START, _END = np.uint64(0x5D1E0C6B9A3F2471), np.uint64(0xB37A94D2E81F605C)
_JOIN = np.uint64(0xC2B2AE3D27D4EB4F)


def levels_of(base: float = BASE, most: float = 1e18) -> np.ndarray:
    """The least count of each level: the different whole powers of `base`, rounded up."""
    powers = np.ceil(base ** np.arange(int(np.log(most) / np.log(base)) + 1) - 1e-9)
    return np.unique(powers).astype(np.int64)


def _level_counts(least: np.ndarray) -> np.ndarray:
    """What a count of each level stands for: the middle of its interval; 0 for no level."""
    return np.concatenate(([0.0], (least[:-1] + least[1:] - 1) / 2.0, [float(least[-1])]))


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of start, words (A-Z in lower case) and end of each text, one text after another, and where each begins."""
    words, at = hash_words([t.translate(_LOWER) for t in texts])
    begin = at + 2 * np.arange(len(at))
    out = np.empty(int(begin[-1]), np.uint64)
    inner = np.ones(len(out), bool)
    inner[begin[:-1]] = inner[begin[1:] - 1] = False
    out[inner], out[begin[:-1]], out[begin[1:] - 1] = words, _START, _END
    return out, begin


def _longer(keys: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """From the keys of runs that end at each place, the keys of runs longer by the next token, for places from 1."""
    return mixed(keys[:-1] * _JOIN + tokens[1:])


def _grams(tokens: np.ndarray, begin: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length: key of the run that ends at each place, and whether that run lies in one text."""
    since = np.arange(len(tokens)) - np.repeat(begin[:-1], np.diff(begin))
    out = [(tokens, np.ones(len(tokens), bool))]
    for o in range(2, order + 1):
        keys = np.zeros(len(tokens), np.uint64)
        keys[1:] = _longer(out[-1][0], tokens)
        out.append((keys, since >= o - 1))
    return out


def _cut(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of the values between the edges, a binary value per part, without copying them."""
    offsets = (edges * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _sharded(keys: np.ndarray, counts: np.ndarray, order: int, bits: int) -> pa.RecordBatch:
    """Sorted keys and their counts, a row per shard."""
    shard = (keys >> np.uint64(64 - bits)).astype(np.int32)
    first = np.flatnonzero(np.diff(shard, prepend=-1))
    edges = np.append(first, len(keys))
    columns = [pa.array(shard[first]), pa.array(np.full(len(first), order, np.int32)), _cut(keys, edges), _cut(counts.astype(np.uint32), edges)]
    return pa.RecordBatch.from_arrays(columns, ["shard", "length", "keys", "counts"])


def _counted(order: int, bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(order)]
        size = 0

        def flush():
            for o, parts in enumerate(held):
                if parts:
                    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                    parts.clear()
                    yield _sharded(keys, counts, o + 1, bits)

        for _, texts in pieces(batches, "text"):
            tokens, begin = _tokens(texts)
            for o, (keys, whole) in enumerate(_grams(tokens, begin, order)):
                held[o].append(keys[whole])
                size += len(held[o][-1])
            if size >= GATHERED:
                yield from flush()
                size = 0
        yield from flush()
    return tidy(count)


def _merged(least: np.ndarray):
    """Of one shard: the exact counts of each length, and how many n-grams have each level."""
    def merge(table: pa.Table) -> pa.Table:
        lengths, shard = np.asarray(table["length"]), table["shard"][0].as_py()
        rows = []
        for o in sorted(set(lengths.tolist())):
            own = table.filter(pa.array(lengths == o))
            keys = np.concatenate([np.frombuffer(x, np.uint64) for x in own["keys"].to_pylist()])
            counts = np.concatenate([np.frombuffer(x, np.uint32) for x in own["counts"].to_pylist()]).astype(np.int64)
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            keys, counts = keys[first], np.add.reduceat(counts, first)
            told = counts[keys != _START] if o == 1 else counts
            levels = np.bincount(np.searchsorted(least, counts, "right"), minlength=len(least) + 1)
            rows.append((shard, o, keys.tobytes(), counts.tobytes(), int(told.sum()), len(told), levels.tolist()))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        names = ("shard", "length", "keys", "counts", "total", "distinct", "levels")
        return pa.table({n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*rows, strict=True), strict=True)})
    return merge


def gram_counts(texts: DataFrame, order: int = ORDER, base: float = BASE) -> tuple[DataFrame, int]:
    """Exact counts of all n-grams up to `order` of the column `text`, sorted by hash in 2^bits shards, and bits.

    A task adds up what it reads; what is shuffled is one sorted array per task and shard, so no word is a hot key. The
    number of shards follows the size of the texts, so that a shard stays one task's work. The staged rows are `shard`,
    `length`, `keys`, `counts`, with `total` and `distinct` (the start of texts isn't a token) and the histogram `levels`.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A word and its space take two bytes at least, and some six on average.
    bits = min(MOST_SHARD_BITS, max(LEAST_SHARD_BITS, int(np.ceil(np.log2(max(1.0, size * order / 4 / PER_SHARD))))))
    rows = texts.select("text").mapInArrow(_counted(order, bits), "shard int, length int, keys binary, counts binary")
    schema = "shard int, length int, keys binary, counts binary, total long, distinct long, levels array<long>"
    return staged(rows.groupBy("shard").applyInArrow(_merged(levels_of(base)), schema), "grams"), bits


def _positions(keys: np.ndarray, level: np.ndarray | int, hashes: int, shard_bits: int, block: int) -> Iterator[np.ndarray]:
    """Places in the filter of the entries (n-gram, level): all lie in the block of the n-gram's shard."""
    start = (keys >> np.uint64(64 - shard_bits)) * np.uint64(block) if shard_bits else np.uint64(0)
    h = mixed(keys + np.asarray(level).astype(np.uint64) * _JOIN)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for j in range(hashes):
        yield start + ((h + np.uint64(j) * step) & np.uint64(block - 1))


class LogFrequencyFilter:
    """An n-gram whose count has level q is held as q entries (n-gram, 1) … (n-gram, q). Reading a count probes level
    after level until one is missing, so errors only go up, and rarely by much: each further level has to be hit anew."""

    def __init__(self, marks: np.ndarray, shard_bits: int, block: int, hashes: int, cutoff: int, base: float):
        self.marks, self.shard_bits, self.block, self.hashes, self.cutoff, self.base = marks, shard_bits, block, hashes, cutoff, base

    def level(self, keys: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
        """The level of each key, no more than `most`; levels up to the cutoff are one entry."""
        out, active, q = np.zeros(len(keys), np.int16), np.arange(len(keys)), self.cutoff
        while len(active):
            if most is not None:
                active = active[most[active] >= q]
            for at in _positions(keys[active], q, 1, self.shard_bits, self.block):
                active = active[self._hit(at)]
            if self.hashes > 1 and len(active):
                hit = np.ones(len(active), bool)
                for at in _positions(keys[active], q, self.hashes, self.shard_bits, self.block):
                    hit &= self._hit(at)
                active = active[hit]
            out[active] = q
            q += 1
        return out

    def _hit(self, at: np.ndarray) -> np.ndarray:
        return (self.marks[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _block_of(entries: int, shard_bits: int) -> tuple[int, int]:
    """Bits of a shard's block (a power of two) and the number of hashes for so many entries in all."""
    bits = 1 << max(12, int(np.ceil(np.log2(max(1, entries) * BITS_PER_ENTRY / (1 << shard_bits)))))
    bits = min(bits, max(64, MOST_BITS >> shard_bits))
    return bits, int(min(MOST_HASHES, max(1, round(np.log(2) * (bits << shard_bits) / max(1, entries)))))


def _cutoff(levels: list[int], shard_bits: int) -> tuple[int, int]:
    """The lowest level that is held, and the entries from there on. It is 1 unless the entries exceed the largest filter."""
    from_level = np.cumsum(np.asarray(levels[1:], np.int64)[::-1])[::-1]
    for q in range(1, len(levels)):
        entries = int(from_level[q - 1:].sum())
        if entries * LEAST_BITS_PER_ENTRY <= max(64 << shard_bits, MOST_BITS):
            return q, entries
    raise ValueError("no level fits the filter")


def _marked(least: np.ndarray, cutoff: int, hashes: int, shard_bits: int, block: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, bitmaps = [], []
            for shard, keys, counts in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("shard", "keys", "counts")), strict=True):
                bits = np.zeros(block, bool)
                for k, c in zip(keys, counts, strict=True):
                    k, level = np.frombuffer(k, np.uint64), np.searchsorted(least, np.frombuffer(c, np.int64), "right")
                    q = cutoff
                    while len(k := k[level >= q]):
                        level = level[level >= q]
                        for at in _positions(k, q, hashes, shard_bits, block):
                            bits[(at & np.uint64(block - 1)).astype(np.int64)] = True
                        q += 1
                shards.append(shard)
                bitmaps.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(bitmaps, pa.binary())], ["shard", "bitmap"])
    return tidy(mark)


def build_filter(grams: DataFrame, shard_bits: int, base: float = BASE) -> LogFrequencyFilter:
    """The filter of all counted n-grams; 32 MB at most, whatever the corpus.

    Where the entries of the lowest levels would leave fewer than five bits to each, the filter begins at the first level
    with room, which follows from the histogram of all counts. What it leaves out is looked up in the counts themselves,
    see `_looked_up`.
    """
    least = levels_of(base)
    sums = [F.sum(F.element_at("levels", q + 1)).alias(f"q{q}") for q in range(len(least) + 1)]
    levels = [x or 0 for x in grams.agg(*sums).first()]
    cutoff, entries = _cutoff(levels, shard_bits)
    block, hashes = _block_of(entries, shard_bits)
    rows = grams.groupBy("shard").agg(F.collect_list("keys").alias("keys"), F.collect_list("counts").alias("counts"))
    marks = np.zeros((block << shard_bits) // 8, np.uint8)
    found = rows.mapInArrow(_marked(least, cutoff, hashes, shard_bits, block), "shard int, bitmap binary").collect()
    while found:
        r = found.pop()
        marks[r["shard"] * (block // 8):(r["shard"] + 1) * (block // 8)] = np.frombuffer(r["bitmap"], np.uint8)
    return LogFrequencyFilter(marks, shard_bits, block, hashes, cutoff, base)


ONLY_FIRST = np.empty(0, np.uint64), np.uint8(1)


def _read(filt: LogFrequencyFilter, tokens: np.ndarray, begin: np.ndarray, order: int, rest: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each length: keys of the runs, whether they lie in one text, and levels; `rest` tells those that the filter lacks, or
    without keys the level that they all have.

    A run is asked for only if both runs it is made of were seen, and counts no more than either.
    """
    context = None
    for o, (keys, whole) in enumerate(_grams(tokens, begin, order)):
        most = np.full(len(tokens), np.iinfo(np.int16).max, np.int16) if o == 0 else np.where(whole, np.minimum(np.concatenate(([0], context[:-1])), context), 0)
        ask = np.flatnonzero(most >= filt.cutoff)
        unique, first, back = np.unique(keys[ask], return_index=True, return_inverse=True)
        level = np.zeros(len(tokens), np.int16)
        level[ask] = (filt.level(unique) if o == 0 else filt.level(unique, most[ask][first]))[back]
        if rest is not None:
            low = np.flatnonzero(whole & (most > 0) & (level == 0))
            level[low] = rest[1][np.searchsorted(rest[0], keys[low])] if len(rest[0]) else rest[1]
        yield keys, whole, level
        context = level


def _left_out(filt: LogFrequencyFilter, tokens: np.ndarray, begin: np.ndarray, order: int) -> np.ndarray:
    """The different runs, of all lengths, that the filter doesn't hold."""
    return np.unique(np.concatenate([keys[whole & (level == 0)] for keys, whole, level in _read(filt, tokens, begin, order)]))


def log_probabilities(filt: LogFrequencyFilter, tokens: np.ndarray, begin: np.ndarray, order: int, total: int, distinct: int, mass: float = MASS, rest: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """log₁₀ probability of each token given those before it in its text; 0 at starts.

    A word alone has (count + 1) / (total + distinct + 1); with a context, (count of both + mass × the probability with
    the shorter context) / (count of the context + mass). Counts are what the filter tells, or else `rest`: sorted keys
    and levels of the runs that it doesn't hold.
    """
    value = _level_counts(levels_of(filt.base))
    out, context = np.zeros(len(tokens)), None
    for o, (_, whole, level) in enumerate(_read(filt, tokens, begin, order, rest)):
        if o == 0:
            probability = (value[level] + 1.0) / (total + distinct + 1.0)
        else:
            seen = np.where(whole, value[np.concatenate(([0], context[:-1]))], 0.0)
            # Two counts are told by intervals; together they are no more than the context's.
            probability = (np.minimum(value[level], seen) + mass * probability) / (seen + mass)
        context = level
    np.log10(probability, out=out)
    out[begin[:-1]] = 0.0
    return out


def _lacking(grams: DataFrame, least: np.ndarray, cutoff: int) -> DataFrame:
    """`shard`, `keys`, `levels` (a byte each) of the n-grams below the level at which the filter begins."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, level = np.frombuffer(keys, np.uint64), np.searchsorted(least, np.frombuffer(counts, np.int64), "right").astype(np.uint8)
                own = level < cutoff
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([keys[own].tobytes()], pa.binary()), pa.array([level[own].tobytes()], pa.binary())], ["shard", "keys", "levels"])
    return grams.select("shard", "keys", "counts").mapInArrow(rows, "shard int, keys binary, levels binary")


def _answered(held: pa.Table, asked: pa.Table) -> pa.Table:
    """Of one shard: the levels of the n-grams that each block asked for, in the same order; 0 for the unseen."""
    keys = np.concatenate([np.empty(0, np.uint64), *[np.frombuffer(x, np.uint64) for x in held["keys"].to_pylist()]])
    levels = np.concatenate([np.empty(0, np.uint8), *[np.frombuffer(x, np.uint8) for x in held["levels"].to_pylist()]])
    order = np.argsort(keys)
    keys, levels, found = keys[order], levels[order], []
    for raw in asked["keys"].to_pylist():
        wanted = np.frombuffer(raw, np.uint64)
        at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
        found.append(np.where(keys[at] == wanted, levels[at], np.uint8(0)).tobytes() if len(keys) else bytes(len(wanted)))
    return pa.table({"block": asked["block"].cast(pa.int64()), "shard": asked["shard"].cast(pa.int32()), "levels": pa.array(found, pa.binary())})


def _looked_up(rows: DataFrame, lacking: DataFrame, shared, order: int, bits: int, mass: float, fields: list[str], schema: str) -> DataFrame:
    """What `_scored` gives, for a filter that has no room for the rarest n-grams: their levels come from a join.

    Texts of some megabytes are a block, which asks each shard of `lacking` once for the different n-grams that the
    filter doesn't hold, and gets a byte for each. A block's texts are then scored with both.
    """
    rows = staged(rows, "lm-asking")  # row numbers stay
    blocks = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ASK_TOGETHER))
    texts = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))

    def left_out(own: pa.Table) -> np.ndarray:
        found = [_left_out(shared.value[0], *_tokens(t), order) for _, t in pieces(own.to_batches(), "text")]
        return np.unique(np.concatenate(found))

    def ask(own: pa.Table) -> pa.Table:
        keys = left_out(own)
        shard = (keys >> np.uint64(64 - bits)).astype(np.int32)
        first = np.flatnonzero(np.diff(shard, prepend=-1))
        block = pa.array(np.full(len(first), own["block"][0].as_py(), np.int64))
        return pa.table({"block": block, "shard": pa.array(shard[first]), "keys": _cut(keys, np.append(first, len(keys)))})

    def score(own: pa.Table, told: pa.Table) -> pa.Table:
        # Shards are the first bits of the keys, so the answers of all shards are in the order of the keys.
        rest = left_out(own), np.frombuffer(b"".join(told.sort_by("shard")["levels"].to_pylist()), np.uint8)
        return pa.Table.from_batches(list(_scored(order, shared, mass, fields, rest)(own.to_batches())))

    asks = texts.groupBy("block").applyInArrow(ask, "block long, shard int, keys binary")
    answers = lacking.groupBy("shard").cogroup(asks.groupBy("shard")).applyInArrow(_answered, "block long, shard int, levels binary")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)


def _scored(order: int, shared, mass: float, fields: list[str], low: tuple[np.ndarray, np.ndarray] | None = None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt, words, counts, total, distinct = shared.value
        weight = np.log10(counts + 1.0)
        for batch, texts in pieces(batches, "text"):
            tokens, begin = _tokens(texts)
            logs = log_probabilities(filt, tokens, begin, order, total, distinct, mass, low)
            scores = np.add.reduceat(logs, begin[:-1])
            inner = np.ones(len(tokens), bool)
            inner[begin[:-1]] = False
            text = np.repeat(np.arange(len(texts)), np.diff(begin))[inner]
            keys = tokens[inner]
            at = np.minimum(np.searchsorted(words, keys), max(0, len(words) - 1))
            found = words[at] == keys if len(words) else np.zeros(len(keys), bool)
            known = np.bincount(text[found], minlength=len(texts))
            base = np.bincount(text[found], weight[at[found]] if len(words) else None, minlength=len(texts)).astype(float)
            rest, own = keys[~found], text[~found]
            order_ = np.lexsort((rest, own))
            rest, own = rest[order_], own[order_]
            first = np.flatnonzero(np.concatenate(([True], (rest[1:] != rest[:-1]) | (own[1:] != own[:-1])))) if len(rest) else np.empty(0, np.int64)
            times = np.diff(np.concatenate((first, [len(rest)])))
            rows = np.concatenate((np.arange(len(texts)), own[first]))
            n = len(texts)
            pad = lambda x, kind: pa.array(np.concatenate((x, np.zeros(len(first), x.dtype))), kind, mask=np.arange(n + len(first)) >= n)  # noqa: B023, E731
            ask = lambda x: pa.array(np.concatenate((np.zeros(n, x.dtype), x)), pa.int64(), mask=np.arange(n + len(first)) < n)  # noqa: B023, E731
            kept = [batch.column(batch.schema.get_field_index(f)).take(pa.array(rows)) for f in fields]
            yield pa.RecordBatch.from_arrays(
                [*kept, pad(np.diff(begin) - 1, pa.int64()), pad(known, pa.int64()), pad(base, pa.float64()), pad(scores, pa.float64()), ask(rest[first].view(np.int64)), ask(times)],
                [*fields, "n_tokens", "known", "base", "score", "word", "times"])
    return tidy(score)


def _rare(grams: DataFrame, least: int) -> DataFrame:
    """`word`, `c` of the words counted fewer than `least` times."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, counts = np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)
                own = (counts < least) & (keys.view(np.uint64) != _START)
                yield pa.RecordBatch.from_arrays([pa.array(keys[own]), pa.array(counts[own])], ["word", "c"])
    return grams.where("length = 1").select("keys", "counts").mapInArrow(rows, "word long, c long")


def _frequent(grams: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the words counted at least `least` times."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, counts = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)
                own = (counts >= least) & (keys != _START)
                yield pa.RecordBatch.from_arrays([pa.array([keys[own].tobytes()], pa.binary()), pa.array([counts[own].tobytes()], pa.binary())], ["keys", "counts"])
    found = grams.where("length = 1").select("keys", "counts").mapInArrow(rows, "keys binary, counts binary").collect()
    keys = np.concatenate([np.empty(0, np.uint64), *[np.frombuffer(r["keys"], np.uint64) for r in found]])
    counts = np.concatenate([np.empty(0, np.int64), *[np.frombuffer(r["counts"], np.int64) for r in found]])
    order = np.argsort(keys)
    return keys[order], counts[order]


def held_out(id_column: str = "doc_id", parts: int = 7, part: int = 2) -> Column:
    """Whether crc32 of the id as text is `part` modulo `parts`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def score_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", learn: Column | None = None, order: int = ORDER, base: float = BASE, mass: float = MASS) -> DataFrame:
    """One row per document: id, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score`.

    The model learns from the rows where `learn` holds (default: all but those of `held_out`). Tokens are the words between
    ASCII white space with A-Z in lower case, and one end per text; null and empty texts are an end alone. `score` is the
    log₁₀ probability that the filter's smoothed n-gram model gives the text; a filter without room for the rarest n-grams
    leaves their counts to a join. `base_score` adds one to each exact word
    count, log₁₀((c + 1) / (N + V + 1)) per token, and needs no filter: frequent words are looked up in the tasks, the
    others meet their counts in a join. `n_known` counts tokens that occur in what was learnt from. Words are told apart
    by 64-bit hashes. Nothing learnt leaves every token at probability one word of none, log₁₀ 1 = 0; an empty table
    gives no rows; repeated rows are scored each; other columns are ignored.
    """
    learn = ~held_out(id_column) if learn is None else F.coalesce(learn, F.lit(False))
    rows = docs.select(F.col(id_column).alias("id"), learn.alias("learn"), F.col(text_column).alias("text"))
    grams, bits = gram_counts(rows.where("learn"), order, base)
    least = levels_of(base)
    told = [F.sum(F.when(F.col("length") == 1, F.col(c))).alias(c) for c in ("total", "distinct")]
    words = [F.sum(F.when(F.col("length") == 1, F.element_at("levels", q + 1))).alias(f"q{q}") for q in range(len(least) + 1)]
    known = grams.agg(*told, *words).first()
    total, distinct = known["total"] or 0, known["distinct"] or 0
    from_level = np.cumsum(np.asarray([x or 0 for x in known[3:]], np.int64)[::-1])[::-1]
    # The first level from which on the words are few enough; the start of texts is one more, so at most this many.
    often = int(least[int(np.argmax(from_level <= FREQUENT_WORDS))])
    keys, counts = _frequent(grams, often)
    filt = build_filter(grams, bits, base)
    shared = docs.sparkSession.sparkContext.broadcast((filt, keys, counts, total, distinct))

    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "learn", "text")
    kind = rows.schema["id"].dataType.simpleString()
    fields, schema = ["row", "id", "learn"], f"row long, id {kind}, learn boolean, n_tokens long, known long, base double, score double, word long, times long"
    within = lambda r, rest=None: r.mapInArrow(_scored(order, shared, mass, fields, rest), schema)
    beyond = lambda r: _looked_up(r, _lacking(grams, least, filt.cutoff), shared, order, bits, mass, fields, schema)
    if filt.cutoff == 1:
        scored = within(rows)
    elif filt.cutoff == 2:
        # What was learnt from has no unseen run: those that the filter lacks are of the first level.
        others = rows.where("NOT learn").withColumn("row", -1 - F.col("row"))  # another scan, so other numbers
        scored = within(rows.where("learn"), ONLY_FIRST).unionByName(beyond(others))
    else:
        scored = beyond(rows)
    scored = staged(scored, "lm-scored")
    asked = scored.where("word IS NOT NULL").select("row", "word", "times")
    more = asked.join(_rare(grams, often), "word").groupBy("row").agg(F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("_base"))
    out = scored.where("word IS NULL").join(more, "row", "left")
    level = F.lit(float(np.log10(total + distinct + 1.0)))
    return out.select(
        F.col("id").alias(id_column), (~F.col("learn")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0)) - F.col("n_tokens") * level).alias("base_score"), "score")
