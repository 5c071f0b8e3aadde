"""Language of a text by cross-parsing: how few phrases of labelled text it takes to spell it."""

from __future__ import annotations

import functools
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import tidy
from .shingles import pieces

# Bounds of the labelled sample: documents per language, and characters from the beginning of each.
SAMPLE_DOCS, SAMPLE_CHARS = 96, 400
# Languages that are learnt; of more labels, those with the most different texts.
LABELS = 256
# Each letter of the samples has a class; the most frequent ones are columns of a table, the others are looked up by key.
# Class 0 is anything but a letter, 1 a letter of no sample.
LETTERS = 62
# A text is parsed in stretches of this many characters, all of them side by side; each starts a new phrase.
STRETCH = 256
# Bits for the length of a phrase, and for a character that the labelled text lacks (a code point).
LENGTH_BITS, LITERAL_BITS = 3, 21
LOW = (1 << 32) - 1
# Characters of text that one step of a task parses.
TOGETHER = 1 << 18


@functools.lru_cache(1)
def _spells() -> np.ndarray:
    """Whether a code point is a letter or a mark on one, such as a vowel sign."""
    return np.fromiter((chr(c).isalpha() or unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)), bool, 0x110000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Model:
    """A table of next states per language, made from suffix automata of its labelled text.

    An entry holds the next state's row and two bits, whether a phrase ends before this character and whether the labelled
    text lacks the character: where the automaton has no way on, the parse goes to the state that the character leads to
    from the beginning; a character that is lacking stands for itself, after which nothing is open.
    """

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        spells = _spells()
        counts = Counter(c for t in samples.values() for c in t.lower() if spells[ord(c)])
        letters = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
        self.classes = spells.astype(np.int32)
        for k, c in reversed(list(enumerate(letters, 2))):
            for form in (c.upper(), c.title(), c):
                if len(form) == 1:
                    self.classes[ord(form)] = k
        self.n_classes = len(letters) + 2
        self.width = min(len(letters), LETTERS) + 2
        tables, self.roots, rows = [], [], 0
        keys, values, self.starts = [], [], np.full((len(self.languages), max(self.n_classes - self.width, 0)), -1, np.int64)
        for lang in self.languages:
            codes = self.codes(samples[lang])
            steps = suffix_automaton(codes.tolist())
            table = np.full((len(steps), self.width), -1, np.int64)
            for s, ways in enumerate(steps):
                for c, to in ways.items():
                    if c < self.width:
                        table[s, c] = to
                    else:
                        keys.append((rows + s) * self.width * self.n_classes + c)
                        values.append((rows + to) * self.width)
                        if s == 0:
                            self.starts[len(self.roots), c - self.width] = values[-1]
            lacks = table[0] < 0
            root = np.where(lacks, 0, table[0])
            done = (table < 0) * (1 + 2 * lacks)
            done[0] = 2 * lacks  # nothing is open there
            table = np.where(table < 0, root, table)
            tables.append(((table + rows) * self.width << 2 | done).astype(np.int32 if (rows + len(steps)) * self.width < 1 << 29 else np.int64))
            self.roots.append(rows * self.width)
            rows += len(steps)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
        # Bits that a phrase costs: its place in the labelled text, and its length.
        self.bits = np.array([math.log2(len(self.codes(samples[x])) + 2) + LENGTH_BITS for x in self.languages])

    def codes(self, text: str) -> np.ndarray:
        """Classes of the characters; a run of other characters than letters is one."""
        c = self.classes[_points(text)]
        return c[(c > 0) | (np.concatenate(([1], c[:-1])) > 0)]

    def step(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Entries for a state per language and text and the next class of each text."""
        if not len(self.keys):
            return self.table[state + codes]
        keyed = np.flatnonzero(codes >= self.width)
        if not len(keyed):
            return self.table[state + codes]
        v = self.table[state + np.minimum(codes, self.width - 1)].astype(np.int64)
        at, c, roots = state[:, keyed], codes[keyed], np.array(self.roots)[:, None]
        key = at * self.n_classes + c
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        start = self.starts[:, c - self.width]
        other = np.where(start < 0, roots << 2 | 2 | (at != roots), start << 2 | 1)
        v[:, keyed] = np.where(self.keys[k] == key, self.values[k] << 2, other)
        return v

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases per language and text; a character that is lacking counts as one."""
        found = self.parse(texts)
        return (found & LOW) + (found >> 32)

    def cost(self, texts: list[np.ndarray]) -> np.ndarray:
        """Bits per language and text."""
        found = self.parse(texts)
        return (found & LOW) * self.bits[:, None] + (found >> 32) * LITERAL_BITS

    def parse(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that occur, plus 2 ** 32 for each character that is lacking, per language and text."""
        out = np.zeros((len(self.languages), len(texts)), np.int64)
        lengths = np.array([len(t) for t in texts])
        pieces = -(-lengths // STRETCH)
        if not pieces.sum():
            return out
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = (np.cumsum(lengths) - lengths)[owner] + nth * STRETCH
        size = np.minimum(lengths[owner] - nth * STRETCH, STRETCH)
        order = np.argsort(-size, kind="stable")
        owner, begin, size = owner[order], begin[order], size[order]
        active = np.searchsorted(-size, -np.arange(STRETCH), "left")
        codes = np.concatenate(texts).astype(np.int64)
        state = np.repeat(np.array(self.roots, np.int64)[:, None], len(owner), 1)
        count = np.zeros(state.shape, np.int64)
        for t in range(int(size[0])):
            k = active[t]
            v = self.step(state[:, :k], codes[begin[:k] + t])
            count[:, :k] += (v & 1) + ((v & 2).astype(np.int64) << 31)
            state[:, :k] = v >> 2
        count += state != np.array(self.roots)[:, None]  # the phrase that is open at the end
        np.add.at(out.T, owner, count.T)
        return out

    def predict(self, texts: list[str | None], letters: list[bool] | None = None) -> tuple[list[str], list[float]]:
        letters = [any(map(str.isalpha, t or "")) for t in texts] if letters is None else letters
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return langs, scores
        cost = self.cost([self.codes(t or "") for t in texts])
        for k in np.flatnonzero(letters).tolist():
            best = int(np.argmin(cost[:, k]))
            rest = np.delete(cost[:, k], best)
            langs[k], scores[k] = self.languages[best], float(1 - cost[best, k] / rest.min()) if len(rest) else 1.0
        return langs, scores


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts exactly the substrings; state 0 is the beginning."""
    ways, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(ways)
        ways.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in ways[p]:
            ways[p][c] = new
            p = link[p]
        if p >= 0:
            q = ways[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(ways)
                ways.append(dict(ways[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and ways[p].get(c) == q:
                    ways[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return ways


_MODELS: dict[tuple, Model] = {}


def _model(samples: tuple[tuple[str, str], ...]) -> Model:
    """One model per Python worker, made when it is first needed."""
    if samples not in _MODELS:
        _MODELS.clear()
        _MODELS[samples] = Model(dict(samples))
    return _MODELS[samples]


def labelled_sample(docs: DataFrame, text_column: str, lang_column: str, docs_per_language: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, labels: int = LABELS) -> dict[str, str]:
    """Beginnings of at most `docs_per_language` different texts of each language, those with the smallest hashes.

    Copies count once, however many there are. A column may hold any number of labels, mistyped ones too: the `labels`
    languages with the most different beginnings are learnt, ties by name. Only (language, hash) pairs are shuffled; the
    sample itself, at most labels × docs_per_language × chars characters, is what reaches the driver.
    """
    start = F.substring(F.col(text_column), 1, chars)
    rows = docs.select(F.col(lang_column).alias("lang"), start.alias("start")).where("lang IS NOT NULL AND start <> ''").withColumn("h", F.xxhash64("start"))
    pairs = rows.select("lang", "h").distinct()
    usual = pairs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(labels).select("lang")
    chosen = pairs.join(F.broadcast(usual), "lang")
    for parts in (["lang", F.pmod("h", F.lit(64))], ["lang"]):  # a frequent language in parts first
        chosen = chosen.withColumn("n", F.row_number().over(Window.partitionBy(*parts).orderBy("h"))).where(F.col("n") <= docs_per_language).drop("n")
    found = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("start").alias("start")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["h"])):
        samples.setdefault(r["lang"], []).append(r["start"])
    return {lang: " ".join(texts) for lang, texts in samples.items()}


def predict_language(docs: DataFrame, samples: dict[str, str], text_column: str = "text", kept: list[Column] | None = None) -> DataFrame:
    """`_kept` columns (by default all of `docs`), `_lang_pred`, `_score` and `_letters` (whether there is a letter) of each row.

    The text is cut greedily into the longest phrases that occur in the labelled text of a language, for each language.
    A phrase costs its place (log2 of that text's length) and its length (LENGTH_BITS), a character that the labelled text
    lacks costs LITERAL_BITS: much text means long phrases, little text short ones that cost more than they save. The
    language with the smallest cost wins, ties go to the first name. The score is 1 − best / second best cost (1 if there
    is one language). `und` with score 0: null, no letter, or no labelled text. Case and anything but letters don't count.
    Nothing but the text is looked at; each row is on its own; no shuffle.
    """
    # The text travels once: inside the struct if that holds all columns.
    at_text = [c.lower() for c in docs.columns].index(text_column.lower())
    column = "_text" if kept else None
    fixed = docs.sparkSession.sparkContext.broadcast(tuple(sorted(samples.items())))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch, raw in pieces(batches, column, TOGETHER, at_text):
            model = model or _model(fixed.value)
            texts = [t.decode() for t in raw]
            letters = [any(map(str.isalpha, t)) for t in texts]
            langs, scores = model.predict(texts, letters)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(letters, pa.bool_())], names=["_kept", "_lang_pred", "_score", "_letters"])

    packed = docs.select(F.struct(*(kept or [F.col(f"`{c}`") for c in docs.columns])).alias("_kept"), *([F.col(text_column).alias("_text")] if kept else []))
    schema = T.StructType([packed.schema["_kept"], T.StructField("_lang_pred", T.StringType()), T.StructField("_score", T.DoubleType()), T.StructField("_letters", T.BooleanType())])
    return packed.mapInArrow(tidy(rows), schema)


def held_out(id_column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is 2 modulo 4; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """One row per document: id, `held_out`, `lang_pred`, `score`; learnt from the documents that are not held out."""
    samples = labelled_sample(docs.where(~held_out(id_column)), text_column, lang_column)
    out = predict_language(docs, samples, text_column, [F.col(id_column).alias("id"), held_out(id_column).alias("held_out")])
    return out.select(F.col("_kept.id").alias(id_column), F.col("_kept.held_out").alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


def drop_unidentified(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The rows of `docs`, all columns, whose text has a letter and so a language, whether or not there is labelled text."""
    samples = labelled_sample(docs.where(~held_out(id_column)), text_column, lang_column)
    return predict_language(docs, samples, text_column).where("_letters").select("_kept.*")
