"""Hashes of words and of runs of words, computed for many texts at once inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are hashed together; a longer text is hashed in parts of about this size.
PIECE = 1 << 20
_SEEDS = np.random.default_rng(20240917)
_BYTE = _SEEDS.integers(1, 1 << 63, 256, dtype=np.uint64)
_FACTORS = _SEEDS.integers(1, 1 << 63, 4, dtype=np.uint64) | np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection), so that sums and comparisons of them behave like random ones."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int, factor: np.uint64) -> np.ndarray:
    p = np.full(n, factor, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def _hash_piece(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a piece."""
    b = np.frombuffer(raw, np.uint8)
    space = _IS_SPACE[b]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    lengths = ends - starts
    letters = np.flatnonzero(~space)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    within = np.arange(len(letters)) - np.repeat(first, lengths)
    sums = np.add.reduceat(_BYTE[b[letters]] * _powers(int(lengths.max()), _FACTORS[0])[within], first)
    return mixed(sums + lengths.astype(np.uint64) * _FACTORS[1]), starts


def _parts(raw: bytes) -> Iterator[bytes]:
    at = 0
    while len(raw) - at > PIECE:
        end = at + PIECE
        while end < len(raw) and not _IS_SPACE[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and for each text where its words begin (one entry more)."""
    hashes, counts = [], []
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) < PIECE:
            size += len(texts[end]) + 1
            end += 1
        if size <= PIECE:
            h, starts = _hash_piece(b" ".join(texts[at:end]))
            hashes.append(h)
            counts.append(np.diff(np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts[at:end]]))))
        else:
            own = [_hash_piece(x)[0] for x in _parts(texts[at])]
            hashes += own
            counts.append([sum(map(len, own))])
        at = end
    if not texts:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(hashes), np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.int64)


def runs(words: np.ndarray, at: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hash of the `length` words that begin at each place of `at`."""
    total, p = np.zeros(len(at), np.uint64), _powers(length, _FACTORS[2 + salt])
    for j in range(length):
        total += words[at + j] * p[j]
    return mixed(total + np.uint64(length))


def places(offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of `length` words begin, for all texts, and the number of runs per text."""
    n = np.maximum(np.diff(offsets) - length + 1, 0)
    first = np.cumsum(n) - n
    return np.arange(int(n.sum())) - np.repeat(first, n) + np.repeat(offsets[:-1], n), n


def raw_texts(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: str | None, limit: int = PIECE, field: int | None = None) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batches cut so that each holds about `limit` bytes of text, or one row. The text is a column, or a field of
    the first column, which is a struct. Texts leave Arrow a cut at a time."""
    for batch in batches:
        held = batch.column(batch.schema.get_field_index(column)) if column else batch.column(0).flatten()[field]
        sizes = pc.fill_null(pc.binary_length(held.cast(pa.binary())), 0).to_pylist()
        at = size = 0
        for i, n in enumerate(sizes):
            if i > at and size + n > limit:
                yield batch.slice(at, i - at), raw_texts(held.slice(at, i - at))
                at, size = i, 0
            size += n + 1
        if at < len(sizes):
            yield batch.slice(at), raw_texts(held.slice(at))
