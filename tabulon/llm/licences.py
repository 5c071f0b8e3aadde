"""Licence texts and notices, found by the digest of their canonical form."""

from __future__ import annotations

import functools
import json
import operator
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import staged
from .licence_texts import LICENCES

# Signs for copyright, and spellings that count as one. Each is a single word, so wrapped lines don't matter.
SIGNS = (("(c)", "copyright"), ("©", "copyright"))
SPELLINGS = (
    ("licence", "license"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("merchantibility", "merchantability"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("analyse", "analyze"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labour", "labor"), ("recognise", "recognize"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("noncommercial", "non commercial"),
    ("percent", "per cent"), ("sublicense", "sub license"), ("holder", "owner"), ("https", "http"),
)

# Fixed value: what all raw forms of a word that spellings make have in common.
STEMS = {"license": "licen"}


def canonical(text: Column) -> Column:
    """Lower case, a space for anything but letters, digits and +, one spelling, line by line; copyright lines are gone."""
    t = F.replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    for a, b in SIGNS:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, r"[^\p{L}\p{N}+\n]+", " ")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, r"(?m)^ | $", "")
    return F.regexp_replace(t, r"(?m)^copyright (copyright )?([0-9]|by )[^\n]*(\n|\z)", "")


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\n+", " "))


def _units(text: Column) -> Column:
    """unit, unit_no and words of the whole text, of its paragraphs if several, and of the lines of paragraphs that have several."""
    filled = F.filter(F.split(text, r"\n\n+"), lambda p: F.length(_flat(p)) > 0)
    lines = F.filter(F.flatten(F.transform(F.filter(filled, lambda p: F.trim(p, F.lit("\n")).contains("\n")), lambda p: F.split(p, "\n"))), lambda x: F.length(x) > 0)
    unit = lambda name: lambda x, k: F.struct(F.lit(name).alias("unit"), (k + 1).cast("long").alias("unit_no"), x.alias("words"))
    none = F.array().cast("array<struct<unit:string,unit_no:bigint,words:string>>")
    return F.concat(
        F.transform(F.array(_flat(text)), unit("text")),
        F.when(F.size(filled) > 1, F.transform(F.transform(filled, _flat), unit("paragraph"))).otherwise(none),
        F.transform(lines, unit("line")),
    )


def _known_units(spark: SparkSession, licences: Sequence[tuple[str, str]]) -> DataFrame:
    """`license_id`, `words`: the given texts as a whole and their paragraphs."""
    listed = F.lit(json.dumps([{"license_id": i, "text": t} for i, t in licences]))
    rows = spark.range(1).select(F.explode(F.from_json(listed, "array<struct<license_id:string,text:string>>")).alias("x"))
    return rows.select("x.license_id", F.explode(_units(canonical(F.col("x.text")))).alias("u")).where("u.unit <> 'line'").select("license_id", "u.words")


def _digests(units: DataFrame) -> DataFrame:
    rows = units.select("license_id", F.sha2(F.col("words").cast("binary"), 256).alias("digest"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"), F.countDistinct("license_id").alias("_n")).where("_n = 1").drop("_n")


def known_digests(spark: SparkSession, licences: tuple[tuple[str, str], ...] = LICENCES) -> DataFrame:
    """`digest`, `license_id`: of each given text as a whole and of its paragraphs, unless two licences share them."""
    return _digests(_known_units(spark, licences))


def telling_words(units: Sequence[str]) -> list[str]:
    """A few words of which each of the canonical texts has at least one; none if a text has only words that won't do.

    A word does if canonical form leaves it as it is and makes it from nothing else: no sign or spelling puts letters
    into it. Of the others, those of `STEMS` tell by their stem. So a text without any of these, in any case, holds no unit.
    """
    made = [b.split() for _, b in SIGNS + SPELLINGS]
    touched = lambda w: any(b[0] in w if len(b) == 1 else w.endswith(b[0]) or w.startswith(b[-1]) for b in made)
    words = [{STEMS.get(w, w) for w in u.split() if w in STEMS or w.isascii() and w.isalpha() and len(w) > 3 and not touched(w)} for u in units]
    chosen: list[str] = []
    while words and all(words):
        counts = Counter(w for own in words for w in own)
        chosen.append(max(counts, key=lambda w: (counts[w] * len(w) ** 3, w)))
        words = [own for own in words if chosen[-1] not in own]
    return [] if words else chosen


def scan_licences(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", known: DataFrame | None = None) -> DataFrame:
    """One row per match: id, `unit` (text, paragraph, line), `unit_no`, `license_id`, `digest`.

    The whole text, each paragraph and each line of a longer paragraph are brought to canonical form and their SHA-256
    is joined to the known ones; a match is a unit that is entirely a known text or notice, or a paragraph of one.
    Only the largest of equal units counts: a text of one paragraph is a text. Null and empty texts match nothing; each row stands for itself, so
    repeated rows and null ids give their own matches; other columns are ignored.

    The known digests are a fixed list of `LICENCES`, so they are broadcast; a caller's own table is joined as Spark
    sees fit. Nothing else moves. Of the fixed list, a few words are known of which each text and paragraph has one; a
    document without them can't match and is not brought to canonical form.
    """
    bounded = known is None
    if bounded:
        units = staged(_known_units(docs.sparkSession, LICENCES), "licence-units")
        words = telling_words([r["words"] for r in units.select("words").distinct().collect()])
        if words:
            # One lower-case copy, searched for each word.
            docs = docs.where(F.exists(F.array(F.lower(F.col(text_column))), lambda t: functools.reduce(operator.or_, [t.contains(w) for w in words])))
        known = _digests(units)
    known = known.select("digest", "license_id")
    units = docs.select(F.col(id_column), F.explode(_units(canonical(F.col(text_column)))).alias("_u")).where("_u.words <> ''")
    units = units.select(F.col(id_column), "_u.unit", "_u.unit_no", F.sha2(F.col("_u.words").cast("binary"), 256).alias("digest"))
    return units.join(F.broadcast(known) if bounded else known, "digest").select(id_column, "unit", "unit_no", "license_id", "digest")
