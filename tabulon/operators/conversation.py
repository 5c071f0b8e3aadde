"""Conversation analytics. Row rules are column expressions; carried state is an ordered scan per conversation that is
cut into chunks where a conversation is long (see functions.ordered)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import presets
from ..functions import ordered
from ..functions.columns import col


def _any(text: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return out


def intent(text: Column, rules: Mapping[str, Sequence[str]] = presets.INTENTS, default: str = presets.DEFAULT_INTENT) -> Column:
    """CNV-01: the first rule with a word that occurs in the text, as a substring."""
    low = F.lower(text)
    out = F.lit(default)
    for name, terms in reversed(list(rules.items())):
        out = F.when(_any(low, terms), F.lit(name)).otherwise(out)
    return out


def _found(text: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    # not a higher-order function, so that the matching is compiled and the lower-cased text is shared
    return F.array_remove(F.array(*[F.when(_any(text, terms), F.lit(name)).otherwise(F.lit("")) for name, terms in groups.items()]), "")


def _terms(text: Column, terms: Sequence[str]) -> Column:
    return _found(text, {t: [t] for t in terms})


def entities(text: Column, departments: Mapping = presets.DEPARTMENTS, metrics: Mapping = presets.METRICS, times: Sequence[str] = presets.TIME_TERMS,
             comparisons: Sequence[str] = presets.COMPARISON_TERMS, actions: Sequence[str] = presets.ACTION_TERMS,
             qualifiers: Sequence[str] = presets.QUALIFIER_TERMS) -> Column:
    """CNV-02: a struct of word lists, each in list order, and the whole numbers of the text."""
    low = F.lower(text)
    numbers = F.transform(F.regexp_extract_all(low, F.lit(r"(\d+)"), 1), lambda d: d.try_cast("bigint"))
    return F.struct(
        _found(low, departments).alias("departments"), _found(low, metrics).alias("metrics"), _terms(low, times).alias("time_periods"),
        _terms(low, comparisons).alias("comparison_terms"), numbers.alias("numbers"), _terms(low, actions).alias("actions"),
        _terms(low, qualifiers).alias("qualifiers"))


def topic(text: Column, topics: Mapping[str, str] = presets.TOPICS) -> Column:
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for word, name in reversed(list(topics.items())):
        out = F.when(low.contains(word), F.lit(name)).otherwise(out)
    return out


def topic_context(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text", topics: Mapping[str, str] = presets.TOPICS,
                  speaker: Column | None = None, chunks: int | None = None) -> DataFrame:
    """CNV-03: `topic_before`, the latest topic named earlier in the conversation. `speaker` limits who may set it."""
    named = topic(col(text), topics)
    marked = df.withColumn("topic_before", named if speaker is None else F.when(speaker, named))
    return ordered.carry_forward(marked, ["topic_before"], turn, [conversation], include_current=False, chunks=chunks)


def entity_context(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text", speaker: Column | None = None,
                   chunks: int | None = None, **words) -> DataFrame:
    """CNV-04: `entities_before`, the latest entities that named a department or a metric."""
    e = entities(col(text), **words)
    marked = df.withColumn("_e", e)
    keep = (F.size("_e.departments") > 0) | (F.size("_e.metrics") > 0)
    marked = marked.withColumn("entities_before", F.when(keep if speaker is None else keep & speaker, F.col("_e"))).drop("_e")
    return ordered.carry_forward(marked, ["entities_before"], turn, [conversation], include_current=False, chunks=chunks)


def exchanges(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A user message and the assistant message of the next turn; joined on (conversation, turn), so no key is hot."""
    ask = df.filter(col(role) == "user").select(col(conversation), col(turn), col(text).alias("user_text"))
    reply = df.filter(col(role) == "assistant").select(col(conversation), (col(turn) - 1).alias(turn), col(text).alias("assistant_text"))
    return ask.join(reply, [conversation, turn], "left")


def last_exchanges(ex: DataFrame, n: int = 10, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """CNV-05: the last n rows per conversation; the limit is applied before the shuffle."""
    order = W.partitionBy(conversation).orderBy(F.desc(turn))
    return ex.withColumn("recency", F.row_number().over(order)).filter(F.col("recency") <= n)


def message_counts(df: DataFrame, conversation: str = "conv_id", role: str = "role") -> DataFrame:
    """CNV-06"""
    return df.groupBy(col(conversation)).agg(F.count(F.lit(1)).alias("messages"), F.count_if(col(role) == "user").alias("user_messages"),
                                             F.count_if(col(role) == "assistant").alias("assistant_messages"))


def sessions(df: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """CNV-07: the distinct conversations with their first and last turn."""
    return df.groupBy(col(conversation)).agg(F.min(col(turn)).alias("first_turn"), F.max(col(turn)).alias("last_turn"))


def session_history(df: DataFrame, session, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """CNV-07: the messages of one conversation in order."""
    return df.filter(col(conversation) == session).orderBy(turn)


def concise(text: Column, lines: int = 15) -> Column:
    """CNV-08: blank lines and the first `lines` others."""
    filled = lambda x: F.btrim(x, F.lit(" \t\r\f\x0b")) != ""
    places = lambda rows: F.array_compact(F.transform(rows, lambda x, i: F.when(filled(x), i)))
    cut = lambda rows, last: F.filter(rows, lambda x, i: last.isNull() | (i <= last) | ~filled(x))
    # each transform over one element binds a value once; inside a lambda an outer expression would be redone per line
    bound = F.transform(F.array(F.split(text, "\n", -1)), lambda rows: F.transform(
        F.array(F.try_element_at(places(rows), F.lit(lines))), lambda last: F.array_join(cut(rows, last), "\n"))[0])
    return bound[0]
