"""Sources: CSV and JSON files, JSON payloads in a column, stacking, collection statistics."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions.columns import col
from ..session import staged

SOURCE, COLLECTED = "_source_file", "_collection_timestamp"


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths (globs allowed) that match something."""
    conf = spark._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        found = path.getFileSystem(conf).globStatus(path)
        if found is not None and len(found):
            out.append(p)
    return out


def with_lineage(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias(SOURCE), F.current_timestamp().alias(COLLECTED))


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """SRC-04: union by name, absent columns null, duplicates kept. A column that has different types becomes text."""
    if not frames:
        raise ValueError("nothing to stack")
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for field in f.schema:
            if not isinstance(field.dataType, T.NullType):
                kinds.setdefault(field.name, set()).add(field.dataType.simpleString())
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}

    def common(name: str) -> str | None:
        k = kinds.get(name, set())
        return None if len(k) < 2 else "double" if k <= numeric and k & {"float", "double"} else "bigint" if k <= numeric else "string"

    out = None
    for f in frames:
        cast = f.select(*[col(c).cast(common(c)).alias(c) if common(c) else col(c) for c in f.columns])
        out = cast if out is None else out.unionByName(cast, allowMissingColumns=True)
    return out


def _header_groups(spark: SparkSession, paths: Sequence[str]) -> list[list[str]]:
    """Files with equal header lines, together. The header of a file is the first line of its first block."""
    lines = spark.read.text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    heads = lines.filter(F.col("b") == 0).groupBy("f").agg(F.min_by("value", "i").alias("h"))
    groups: dict[str, list[str]] = {}
    for r in heads.collect():  # one row per file
        if r["h"] and r["h"].strip():
            groups.setdefault(r["h"], []).append(r["f"])
    return [sorted(g) for _, g in sorted(groups.items())]


def read_csv(spark: SparkSession, paths: Sequence[str], *, schema: T.StructType | str | None = None, lineage: bool = True, **options) -> DataFrame:
    """SRC-01: all CSV files as one table; missing paths and empty files are skipped.

    Files whose headers differ are read per header and stacked. With `schema` the files share it, and neither their
    headers nor their types are looked up beforehand.
    """
    found = existing(spark, paths)
    if not found:
        raise ValueError("none of the paths exists")
    reader = spark.read.options(header=True, **options)
    if schema is not None:
        df = reader.schema(schema).csv(found)
        return with_lineage(df) if lineage else df
    groups = _header_groups(spark, found)
    if not groups:
        raise ValueError("all files are empty")
    frames = [reader.option("inferSchema", True).csv(g) for g in groups]
    return stack([with_lineage(f) if lineage else f for f in frames])


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested structs to columns named `outer.inner`."""
    def leaves(path: str, name: str, kind: T.DataType):
        if isinstance(kind, T.StructType):
            for f in kind:
                yield from leaves(f"{path}.`{f.name}`", f"{name}{separator}{f.name}", f.dataType)
        else:
            yield F.col(path).alias(name)

    return df.select(*[c for f in df.schema for c in leaves(f"`{f.name}`", f.name, f.dataType)])


def _depth(text):
    """Brackets opened in a text without strings, less `]`; each `}` ends a piece and is counted there."""
    return F.length(F.translate(text, "]", "")) - F.length(F.translate(text, "[{", ""))


def json_elements(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The objects of JSON files, one a row: `f` the file, `b` its block, `k` the place in it, `value` the text.

    A file is read in pieces that end at a `}`, so that several tasks share it, line breaks or not. A piece never begins
    behind a backslash; whether it begins within a string, and how deep, follows from the quotes and brackets before it:
    sums within the block, and one row per block to carry them across the file. An object ends where the depth is back at
    that of the file's array, or at zero. Pieces of one object meet in their block; only the first and the last object of
    a block may go on in others. An object that the file breaks off, and array elements that are no objects, give no row.
    """
    raw = spark.read.option("lineSep", "}").text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
        F.col("_metadata.file_size").alias("_size"), F.monotonically_increasing_id().alias("_i"))
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    string = r'"[^"]*+("|\z)'
    rest = F.regexp_replace(plain, r'\A[^"]*+("|\z)', "")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"')))
    pieces = raw.withColumn("_q", quotes).select(
        "*", (F.octet_length("value") + 1).cast("long").alias("_bytes"),
        (_depth(F.regexp_replace(plain, string, "")) - F.when(F.col("_q") % 2 == 0, 1).otherwise(0)).alias("_out"),
        (_depth(F.regexp_replace(rest, string, "")) - F.when(F.col("_q") % 2 == 1, 1).otherwise(0)).alias("_in"))

    upto = W.partitionBy("f", "b").orderBy("_i").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy("f", "b").orderBy("_i").rowsBetween(W.unboundedPreceding, -1)
    past = F.coalesce(F.sum("_q").over(earlier), F.lit(0)) % 2
    blocks = pieces.select("f", "b", "_size", "_i", "_q", "_bytes", "_out", "_in", past.alias("_past"), F.substring(F.ltrim("value"), 1, 1).alias("_sign")).groupBy("f", "b").agg(
        F.sum("_q").alias("q"), F.sum("_bytes").alias("bytes"), F.max("_size").alias("size"), F.min_by("_sign", "_i").alias("sign"),
        F.sum(F.when(F.col("_past") == 0, F.col("_out")).otherwise(F.col("_in"))).alias("d0"),
        F.sum(F.when(F.col("_past") == 1, F.col("_out")).otherwise(F.col("_in"))).alias("d1"))
    over = W.partitionBy("f").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("_s", F.coalesce(F.sum("q").over(over), F.lit(0)) % 2)
    blocks = blocks.withColumn("_d", F.when(F.col("_s") == 0, F.col("d0")).otherwise(F.col("d1")))
    whole = W.partitionBy("f")
    entries = blocks.select(
        "f", "b", "_s", F.coalesce(F.sum("_d").over(over), F.lit(0)).alias("_d"), F.coalesce(F.sum("bytes").over(over), F.lit(0)).alias("_at"),
        F.when(F.min_by("sign", "b").over(whole) == "[", 1).otherwise(0).alias("_base"),
        # the bytes read tell whether the last piece ends at a bracket or at the end of the file
        F.when(F.sum("bytes").over(whole) == F.max("size").over(whole) + 1, F.sum("bytes").over(whole)).alias("_open"))

    placed = pieces.join(entries, ["f", "b"]).withColumn("_past", (F.col("_s") + F.coalesce(F.sum("_q").over(earlier), F.lit(0))) % 2)
    placed = placed.withColumn("_deep", F.col("_d") + F.sum(F.when(F.col("_past") == 0, F.col("_out")).otherwise(F.col("_in"))).over(upto))
    ends = ((F.col("_past") + F.col("_q")) % 2 == 0) & (F.col("_deep") <= F.col("_base")) & ~F.coalesce(F.col("_at") + F.sum("_bytes").over(upto) == F.col("_open"), F.lit(False))
    placed = placed.withColumn("_ends", ends).withColumn("k", F.coalesce(F.count_if("_ends").over(earlier), F.lit(0)))
    together = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "value"))), lambda p: F.concat(p["value"], F.lit("}"))), "")
    parts = staged(placed.groupBy("f", "b", "k").agg(together.alias("value"), F.max("_ends").alias("_ends")), "json-elements")

    edges = parts.where("k = 0 OR NOT _ends")
    run = F.coalesce(F.count_if("_ends").over(W.partitionBy("f").orderBy("b", "k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    joined = edges.withColumn("_e", run).groupBy("f", "_e").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "k", "value"))), lambda p: p["value"]), "").alias("value"),
        F.max("_ends").alias("_ends"), F.min(F.struct("b", "k")).alias("_first"))
    out = parts.where("k > 0 AND _ends").select("f", "b", "k", "value").unionByName(joined.where("_ends").select("f", "_first.b", "_first.k", "value"))
    before = r'(?s)\A[^{"]*+(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"[^{"]*+)*+'
    return out.withColumn("value", F.regexp_replace("value", before, "")).where(F.col("value").startswith("{"))


def _merged_schema(values: DataFrame, column: str) -> str:
    """The merged type of JSON texts as a struct; text where types differ or all are null."""
    merged = values.agg(F.schema_of_variant_agg(F.try_parse_json(column))).first()[0] or "VOID"
    if not merged.startswith("OBJECT<"):
        return "struct<>"
    names = merged.split("`")  # every other part is a quoted key
    for i in range(0, len(names), 2):
        kind = re.sub(r"OBJECT<", "STRUCT<", names[i])
        kind = re.sub(r"\b(VARIANT|VOID)\b(?!:)", "STRING", kind)
        names[i] = re.sub(r"\bDECIMAL\(\d+,\s*(\d+)\)", lambda m: m[0] if m[1] == "0" else "DOUBLE", kind)
    return "`".join(names)


def read_json(spark: SparkSession, paths: Sequence[str], *, schema: T.StructType | str | None = None, lineage: bool = True) -> DataFrame:
    """SRC-02: a file holds an array (a row per element), an object (one row) or objects one after another; nested
    objects are flattened. Large files are shared by tasks. Without `schema` one aggregate merges the elements' types.
    An element that is no valid JSON gives nulls; see `json_elements` for what gives no row.
    """
    found = existing(spark, paths)
    if not found:
        raise ValueError("none of the paths exists")
    elements = json_elements(spark, found)
    if schema is None:
        schema = _merged_schema(elements, "value")
    extra = [F.col("f").alias(SOURCE), F.current_timestamp().alias(COLLECTED)] if lineage else []
    return flatten(elements.select(F.from_json("value", schema).alias("_r"), *extra).select("_r.*", *[c for c in (SOURCE, COLLECTED) if lineage]))


def normalise_payloads(df: DataFrame, endpoint: str, body: str, schema: T.DataType | str | None = None, max_columns: int | None = None) -> DataFrame:
    """SRC-03: JSON payloads, list or object, to columns, with `_source_endpoint` and `_collection_timestamp`.

    With `schema` (of one element) the payloads are parsed in one pass. Without it one aggregate merges the types of all
    payloads, at any depth; a second one, only where there are text or mixed values, tells which of them all parse as
    numbers and become double. A key that is an object in some rows and a plain value in others gives columns for both.
    A payload that is no JSON gives nulls. `max_columns` is an error beyond it, if set.
    """
    text = F.trim(col(body))
    whole = F.try_parse_json(text)
    stamp = F.current_timestamp().alias(COLLECTED)
    if schema is not None:
        element = F.explode_outer(F.when(text.startswith("["), F.transform(F.from_json(text, "array<variant>"), lambda v: F.to_json(v))).otherwise(F.array(text)))
        items = df.select(col(endpoint).alias("_source_endpoint"), element.alias("_item"))
        parsed = items.select("_source_endpoint", stamp, F.from_json("_item", schema).alias("_r")).select("_r.*", "_source_endpoint", COLLECTED)
        return flatten(parsed)
    items = df.select(col(endpoint).alias("_source_endpoint"), F.explode_outer(F.when(text.startswith("["), F.try_variant_get(whole, "$", "array<variant>")).otherwise(F.array(whole))).alias("_item"))
    merged = items.agg(F.schema_of_variant_agg("_item")).first()[0] or "VOID"
    leaves = _leaves((), _variant_type(merged))
    mixed = [p for p, kind in leaves.items() if kind == "VARIANT"]
    while mixed:  # keys that hold objects in some rows: their inner keys, a round for each depth at which that happens
        found = items.agg(*[F.schema_of_variant_agg(F.when(_is_object(_at(p)), _at(p))).alias(f"s{i}") for i, p in enumerate(mixed)]).first()
        inner = {q: k for i, p in enumerate(mixed) for q, k in (_leaves(p, _variant_type(found[i] or "VOID")) if (found[i] or "").startswith("OBJECT") else {}).items()}
        mixed = [p for p, kind in inner.items() if kind == "VARIANT"]
        leaves |= inner
    names = sorted(p for p in leaves if p)
    if not names:
        raise ValueError("payloads hold no keys")
    if max_columns is not None and len(names) > max_columns:
        raise ValueError(f"payloads have more than {max_columns} keys; pass schema=")
    number = {p: leaves[p] in ("BIGINT", "DOUBLE", "FLOAT") or leaves[p].startswith("DECIMAL") for p in names}
    value = {p: F.when(~_is_object(_at(p)), F.try_variant_get(_at(p), "$", "string")) for p in names}
    ask = [p for p in names if leaves[p] in ("STRING", "VARIANT", "VOID")]
    if ask:
        checks = items.agg(*[F.bool_and(value[p].isNull() | value[p].try_cast("double").isNotNull()).alias(f"c{i}") for i, p in enumerate(ask)]).first()
        number |= {p: checks[i] is not False for i, p in enumerate(ask)}
    cols = [(F.try_variant_get(_at(p), "$", "double") if leaves[p] != "VARIANT" and leaves[p] != "STRING" else value[p].try_cast("double")) if number[p] else value[p] for p in names]
    return items.select(*[c.alias(".".join(p)) for c, p in zip(cols, names)], "_source_endpoint", stamp)


def _variant_type(text: str) -> dict | str:
    """A merged type as nested dicts of keys; scalars, arrays and mixtures stay text."""
    text = text.strip()
    if not text.startswith("OBJECT<"):
        return text
    out, at, end = {}, len("OBJECT<"), len(text) - 1
    while at < end:
        if text[at] == "`":
            key, at = "", at + 1
            while text[at] != "`" or text[at + 1] == "`":
                step = 2 if text[at] == "`" else 1
                key, at = key + text[at], at + step
            at += 1
        else:
            stop = text.index(":", at)
            key, at = text[at:stop], stop
        at += 1
        depth, quoted, stop = 0, False, at
        while stop < end and (depth or quoted or text[stop] != ","):
            quoted ^= text[stop] == "`"
            depth += 0 if quoted else (text[stop] in "<(") - (text[stop] in ">)")
            stop += 1
        out[key], at = _variant_type(text[at:stop]), stop + 1
        while at < end and text[at] == " ":
            at += 1
    return out


def _leaves(path: tuple[str, ...], kind: dict | str) -> dict[tuple[str, ...], str]:
    if isinstance(kind, str):
        return {path: kind}
    return {q: k for name, inner in kind.items() for q, k in _leaves((*path, name), inner).items()}


def _is_object(value):
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def _at(path: tuple[str, ...], column: str = "_item"):
    """The variant at a path. A key that paths can't name (both quotes, a backslash) is looked up in a map."""
    at = F.col(column)
    for p in path:
        if "\\" in p or ("'" in p and '"' in p):
            at = F.try_variant_get(at, "$", "map<string,variant>").getItem(p)
        else:
            at = F.try_variant_get(at, "$[%s]" % (f'"{p}"' if "'" in p else f"'{p}'"), "variant")
    return at


def collection_statistics(df: DataFrame, source: str = SOURCE, collected: str = COLLECTED) -> DataFrame:
    """SRC-05: per source, its records, the table's columns and the last collection time."""
    return df.groupBy(col(source)).agg(
        F.count(F.lit(1)).alias("records"), F.lit(len(df.columns)).cast("long").alias("columns"),
        *([F.max(col(collected)).alias("last_collected")] if collected in df.columns else []))


def schema_table(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema], "column string, type string")


def keep(df: DataFrame) -> DataFrame:
    """SRC-06: keep the combined table, spilling to disk."""
    from pyspark import StorageLevel

    return df.persist(StorageLevel.MEMORY_AND_DISK)


def release(*frames: DataFrame) -> int:
    """SRC-06: drop kept tables; returns how many were kept."""
    held = [f for f in frames if f.is_cached]
    for f in held:
        f.unpersist()
    return len(held)
