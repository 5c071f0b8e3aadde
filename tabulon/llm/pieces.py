"""SentencePiece encoding with seeded merge-dropout, and decoding back to the same text."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import tidy
from .shingles import mixed, pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
DROPOUT, SEED = 0.1, 1
# A place in a text draws one of so many keys; within a batch, equal chunks with one key are merged once.
KEYS = 16
# Characters of a batch.
TOGETHER = 1 << 18
# Entries of the table in which the keyed hash looks up whether a merge is skipped; also the rank of no merge.
TABLE = 1 << 20
# Chunks of more characters keep their agenda in a heap, one by one; the others go in step.
SHORT = 48
_SPACE, _SIGN = 0x20, ord(SPACE)


class Pieces:
    """The merges of a SentencePiece BPE model with byte fallback and a dummy prefix, read from the bytes of its file."""

    def __init__(self, model: bytes, dropout: float, seed: int):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.keys = KEYS if dropout > 0 else 1
        self.skip = np.random.default_rng(seed).random(TABLE) < dropout
        self.id, score, self.byte, self.plain = {}, {}, [0] * 256, []
        for k in range(own.get_piece_size()):
            piece = own.id_to_piece(k)
            if own.is_byte(k):
                value = int(piece[3:5], 16)
                self.byte[value] = k
                self.plain.append(bytes([value]))
            elif own.is_control(k) or own.is_unknown(k) or own.is_unused(k):
                self.plain.append(b"")
            else:
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {k} crosses the border of a chunk")
                self.id[piece] = k
                score[piece] = own.get_score(k)
                self.plain.append(piece.replace(SPACE, " ").encode())
        self.rank = {p: r for r, p in enumerate(sorted(score, key=lambda p: (-score[p], self.id[p])))}
        # For many chunks at once: letters and merges by number; the last number stands for any letter that is no piece.
        self.base = len(self.plain) + 1
        self.letter = np.full(0x20001, self.base - 1, np.int32)
        for p, k in self.id.items():
            if len(p) == 1 and ord(p) < 0x20000:
                self.letter[ord(p)] = k
        self.letter[_SPACE], self.letter[_SIGN] = self.id[SPACE], self.base - 1
        self.made = np.zeros(len(self.rank), np.int32)
        ways = {}
        for p, r in self.rank.items():
            self.made[r] = self.id[p]
            for k in range(1, len(p)):
                if p[:k] in self.id and p[k:] in self.id:
                    ways[self.id[p[:k]] * self.base + self.id[p[k:]]] = r
        # Ranks of pairs in a table with open addressing.
        self.slots = 1 << max(4, (8 * len(ways)).bit_length())
        self.pair, self.pair_rank = np.full(self.slots, -1, np.int64), np.full(self.slots, TABLE, np.int32)
        left = np.fromiter(ways, np.int64, len(ways))
        ranks, at = np.fromiter(ways.values(), np.int32, len(ways)), self._slot(left)
        while len(left):
            free = self.pair[at] < 0
            self.pair[at[free]], self.pair_rank[at[free]] = left[free], ranks[free]  # of several, the last one gets it
            out = self.pair[at] != left
            left, ranks, at = left[out], ranks[out], (at[out] + 1) & (self.slots - 1)

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (self.slots - 1)

    def _offer(self, both: str, place: int, key: int) -> int:
        """Rank of the merge to `both` at a place; none (the largest) if there is no such piece or the keyed hash skips it."""
        r = self.rank.get(both, -1)
        if r < 0 or self.skip[(r * 0x9E3779B1 + place * 0x85EBCA77 + key * 0xC2B2AE3D >> 5) & (TABLE - 1)]:
            return TABLE
        return r

    def merge(self, chunk: str, key: int) -> list[int]:
        """Pieces of a chunk: the best merge of the agenda comes first, leftmost first; a keyed hash skips some."""
        out: list[int] = []
        for p in self._merge_long(chunk, key):
            out += [self.id[p]] if p in self.id else [self.byte[x] for x in p.encode()]
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Rank of the merge of each two neighbours; none (TABLE) if there is no such piece or the keyed hash skips it."""
        pair = left.astype(np.int64) * self.base + right
        at = self._slot(pair)
        held = self.pair[at]
        rank = np.where(held == pair, self.pair_rank[at], np.int32(TABLE))
        more = np.flatnonzero((held != pair) & (held >= 0))
        while len(more):
            at[more] = (at[more] + 1) & (self.slots - 1)
            held = self.pair[at[more]]
            same = held == pair[more]
            rank[more[same]] = self.pair_rank[at[more[same]]]
            more = more[~same & (held >= 0)]
        hit = np.flatnonzero(rank < TABLE)
        x = rank[hit].astype(np.uint64) * np.uint64(0x9E3779B1) + place[hit].astype(np.uint64) * np.uint64(0x85EBCA77) + key[hit].astype(np.uint64) * np.uint64(0xC2B2AE3D)
        rank[hit[self.skip[(x >> np.uint64(5)) & np.uint64(TABLE - 1)]]] = TABLE
        return rank

    def merge_many(self, points: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`merge` of chunks that lie one after another in `points`: all ids, and where each chunk's begin.

        In each round every chunk's agenda yields its next merge; chunks without one leave.
        """
        chunk = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        place = (np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        sym = self.letter[np.minimum(points, len(self.letter) - 1)]
        start = np.arange(len(points), dtype=np.int32)
        rank = np.full(len(sym), TABLE, np.int32)
        at = np.flatnonzero(chunk[1:] == chunk[:-1])
        rank[at] = self._ranks(sym[at], sym[at + 1], place[at], keys[chunk[at]])
        done = [(start[:0], sym[:0], chunk[:0])]
        while len(sym):
            firsts = np.flatnonzero(np.diff(chunk, prepend=np.int32(-1)))
            best = np.minimum.reduceat(rank, firsts)
            sizes = np.diff(np.append(firsts, len(chunk)))
            alive = best < TABLE
            if not alive.all():
                stay = np.repeat(alive, sizes)
                over = ~stay
                done.append((start[over], sym[over], chunk[over]))
                chunk, sym, place, rank, start = chunk[stay], sym[stay], place[stay], rank[stay], start[stay]
                sizes, best = sizes[alive], best[alive]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            hit = hit[np.diff(chunk[hit], prepend=np.int32(-1)) != 0]
            sym[hit] = self.made[best]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            chunk, sym, place, rank, start = chunk[stay], sym[stay], place[stay], rank[stay], start[stay]
            hit -= np.arange(len(hit))
            rank[hit] = TABLE
            for at in (hit[(hit + 1 < len(sym))], hit[hit > 0] - 1):
                at = at[chunk[at + 1] == chunk[at]]
                rank[at] = self._ranks(sym[at], sym[at + 1], place[at], keys[chunk[at]])
        start, sym, chunk = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(start)
        sym, start, chunk = sym[order], start[order], chunk[order]
        # A character that is no piece is spelled by its bytes.
        unknown = np.flatnonzero(sym == self.base - 1)
        size = np.ones(len(sym), np.int64)
        spelled, which = np.unique(points[start[unknown]], return_inverse=True)
        bytes_of = [[self.byte[x] for x in chr(c).encode("utf-8", "surrogatepass")] for c in spelled.tolist()]
        size[unknown] = np.array([len(x) for x in bytes_of], np.int64)[which] if len(unknown) else 0
        ends = np.cumsum(size)
        out = np.repeat(sym, size).astype(np.int32)
        for n, ids in enumerate(bytes_of):
            for k, x in enumerate(ids):
                out[ends[unknown[which == n]] - len(ids) + k] = x
        return out, np.concatenate(([0], ends))[np.searchsorted(chunk, np.arange(len(lengths) + 1))]

    def _merge_long(self, chunk: str, key: int) -> list[str]:
        part: list[str | None] = list(chunk)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        agenda: list[tuple[int, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(part):
                both = part[a] + part[b]
                r = self._offer(both, a, key)
                if r < TABLE:
                    heapq.heappush(agenda, (r, a, b, both))

        for k in range(len(part) - 1):
            offer(k, k + 1)
        while agenda:
            _, a, b, both = heapq.heappop(agenda)
            if part[a] is None or part[b] is None or after[a] != b or part[a] + part[b] != both:
                continue
            part[a], part[b] = both, None
            after[a] = after[b]
            if after[a] < len(part):
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in part if p is not None]

    def encode(self, texts: list[str], names: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin. A name is the document's hash.

        A chunk is a run of spaces with the other characters that follow; no merge crosses its border. The space sign
        itself, where a text has it, is a chunk of its own and is spelled by its bytes.
        """
        return self._encode([" " + t if t else "" for t in texts], names, 0)[:2]

    def encode_long(self, text: str, name: int) -> np.ndarray:
        """The same for one text, in parts of about TOGETHER characters that end where chunks do."""
        text, parts, at, chunks = " " + text if text else "", [np.zeros(0, np.int32)], 0, 0
        while at < len(text):
            end = at + TOGETHER
            while end < len(text) and not (text[end] == " " and text[end - 1] != " "):
                end += 1
            ids, _, n = self._encode([text[at:end]], [name], chunks)
            parts.append(ids)
            at, chunks = end, chunks + n
        return np.concatenate(parts)

    def _encode(self, texts: list[str], names: list[int], before: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids, where each text's begin, and how many chunks there are; `before` counts those of earlier parts."""
        lengths = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), 0
        ends = np.cumsum(lengths)
        space, sign = points == _SPACE, points == _SIGN
        new = sign.copy()
        new[1:] |= sign[:-1] | (space[1:] & ~space[:-1])
        new[(ends - lengths)[lengths > 0]] = True
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(points)))
        first = np.searchsorted(begin, ends - lengths)  # of each text
        owner = np.repeat(np.arange(len(texts)), np.diff(np.append(first, len(begin))))
        key = (mixed((np.arange(len(begin)) - first[owner] + before).astype(np.uint64) + np.array(names, np.int64).view(np.uint64)[owner]) % np.uint64(self.keys)).astype(np.int64)
        same, salt = None, 0
        while same is None:
            same, salt = self._equal_chunks(points, begin, size, key, salt), salt + 1
        rep, inverse = same
        ids, at = self._merged(points, begin[rep], size[rep], key[rep])
        count = np.diff(at)[inverse]
        upto = np.cumsum(count)
        out = ids[np.arange(upto[-1]) + np.repeat(at[:-1][inverse] - (upto - count), count)]
        return out, np.concatenate(([0], upto))[np.append(first, len(begin))], len(begin)

    def _equal_chunks(self, points: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray] | None:
        """One chunk for each different chunk and key, and which one each is; None if two that differ share a hash."""
        place = np.arange(len(points)) - np.repeat(begin, size)
        power = np.full(int(size.max()), 0xD6E8FEB86659FD93 + 2 * salt, np.uint64)
        power[0] = 1
        h = np.add.reduceat(mixed(points.astype(np.uint64) + np.uint64(salt << 40)) * np.cumprod(power, dtype=np.uint64)[place], begin)
        h = mixed(h + key.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + size.astype(np.uint64))
        _, rep, inverse = np.unique(h, return_index=True, return_inverse=True)
        if (size[rep][inverse] != size).any() or (key[rep][inverse] != key).any() or (points[np.repeat(begin[rep][inverse], size) + place] != points).any():
            return None
        return rep, inverse

    def _merged(self, points: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        short = np.flatnonzero(size <= SHORT)
        n = size[short]
        where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[short], n)
        ids, at = self.merge_many(points[where], n, key[short])
        if len(short) == len(size):
            return ids, at
        parts = dict(zip(short.tolist(), (ids[a:b] for a, b in zip(at, at[1:]))))
        for k in np.flatnonzero(size > SHORT).tolist():
            text = points[begin[k]:begin[k] + size[k]].tobytes().decode("utf-32-le", "surrogatepass")
            parts[k] = np.array(self.merge(text.replace(" ", SPACE), int(key[k])), np.int32)
        return np.concatenate([parts[k] for k in range(len(size))]), np.cumsum([0] + [len(parts[k]) for k in range(len(size))])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.plain.__getitem__, ids)).decode(errors="replace")[1:]


_READY: dict[tuple, Pieces] = {}


def _ready(model: bytes, dropout: float, seed: int) -> Pieces:
    key = (hash(model), dropout, seed)
    if key not in _READY:
        _READY.clear()
        _READY[key] = Pieces(model, dropout, seed)
    return _READY[key]


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _kept(batch: pa.RecordBatch, without: str) -> tuple[list[pa.Array], list[str]]:
    names = [x for x in batch.schema.names if x != without]
    return [batch.column(batch.schema.get_field_index(x)) for x in names], names


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED,
           kept: list[Column] | None = None) -> DataFrame:
    """`_kept` (a struct of the `kept` columns, by default all) and `ids` (array of int), one row per document.

    Candidate merges wait in an agenda ordered by rank, then place; each is skipped with probability `dropout`, decided
    by a hash of the seed, one of KEYS keys, the place in a chunk and the piece. The key is drawn from the document's id and the
    place in the text. So reruns agree, a word is cut in up to KEYS ways, and dropout 0 gives the model's own encoding.
    Null and empty texts have no ids. Characters that the model lacks, and the model's own space sign, are spelled in
    bytes, so `decode` gives the text back, whatever it is. Rows with the same id and text get the same ids; a null id
    is one more id. The model's file is read by the driver and sent along: it is fixed and below 1 MB. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_model_bytes(model))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _ready(sent.value, dropout, seed)
        for batch, raw in pieces(batches, None if at_text is not None else "_text", TOGETHER, at_text):
            texts, names = [t.decode() for t in raw], batch.column(1).to_pylist()
            if batch.num_rows == 1 and len(texts[0]) > TOGETHER:
                ids = own.encode_long(texts[0], names[0])
                offsets = np.array([0, len(ids)])
            else:
                ids, offsets = own.encode(texts, names)
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), listed], names=["_kept", "ids"])

    # The text travels once: inside the struct if that holds all columns.
    name, at_text = F.xxhash64(F.col(id_column)), None if kept else docs.columns.index(text_column)
    packed = docs.select(F.struct(*(kept or [F.col(f"`{c}`") for c in docs.columns])).alias("_kept"), name.alias("_name"), *([F.col(text_column).alias("_text")] if kept else []))
    return packed.mapInArrow(tidy(rows), T.StructType([packed.schema["_kept"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, ids_column: str = "ids", model: str = MODEL) -> DataFrame:
    """The other columns and `text`. Null or no ids give an empty text; ids that spell no UTF-8 give replacement signs."""
    sent = encoded.sparkSession.sparkContext.broadcast(_model_bytes(model))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _ready(sent.value, 0.0, 0)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                column = batch.column(batch.schema.get_field_index(ids_column))
                columns, labels = _kept(batch, ids_column)
                yield pa.RecordBatch.from_arrays([*columns, pa.array([own.decode(x.values.tolist()) if x.is_valid else "" for x in column], pa.string())], names=[*labels, "text"])

    stay = [f for f in encoded.schema.fields if f.name != ids_column]
    return encoded.mapInArrow(tidy(rows), T.StructType([*stay, T.StructField("text", T.StringType())]))
