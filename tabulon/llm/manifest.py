"""Merkle trees over a table: subtrees are folded block by block, proofs are found by pointer jumping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.sizes import broadcast_if_small
from ..session import staged

# Levels that one task folds at once: a block has 2^9 nodes, some 30 kB.
BLOCK_LEVELS = 9
# A side of at most so many rows (of up to 32 hashes each) is broadcast.
SMALL_SIDE = 5_000
_NODES = "tree string, size long, level int, idx long, hash binary, sibling binary"


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 (hex) of the values: `-` for null, else the number of UTF-8 bytes, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _depth(size: Column) -> Column:
    """Levels from a leaf to the root of a tree of `size` leaves."""
    return F.when(size <= 1, F.lit(0)).otherwise(F.length(F.bin(size - 1))).cast("int")


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """`rows` with `pos`, from 0 along `order` (nulls first) within its `tree`, and `size`, the rows of the tree.

    A range partitioning sorts all trees at once, so a tree may hold most rows; rows that tie are told apart by where
    they were read. What is added up in order is one count per tree and partition.
    """
    by = [F.col("tree"), *[F.col(c).asc_nulls_first() for c in order], F.col("_read")]
    rows = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_read")
    rows = staged(rows.withColumn("_at", F.monotonically_increasing_id()), "manifest-rows").withColumn("_part", F.shiftright("_at", 33))
    runs = rows.groupBy("_part", "tree").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    upto = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_part", "tree", "_first", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("tree")).alias("size"))
    rows = rows.join(broadcast_if_small(staged(runs, "manifest-runs")), ["_part", "tree"])
    return rows.withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def _node_hash(nodes: Sequence[bytes]) -> bytes:
    return hashlib.sha256(b"".join(n.hex().encode() for n in nodes)).digest()


def _folded(base: int, levels: int):
    """From blocks (tree, size, depth, block, nodes): each node's sibling, and the node in which the block ends."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                nodes, at, level = [n["hash"] for n in row["nodes"]], row["block"] << levels, base
                for level in range(base, min(base + levels, row["depth"])):
                    out += [(row["tree"], row["size"], level, at + i, None, nodes[i ^ 1] if i ^ 1 < len(nodes) else b"") for i in range(len(nodes))]
                    nodes, at, level = [_node_hash(nodes[i:i + 2]) for i in range(0, len(nodes), 2)], at >> 1, level + 1
                end = min(base + levels, row["depth"])
                out.append((row["tree"], row["size"], end, at, nodes[0], None))
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["tree", "size", "level", "idx", "hash", "sibling"])
    return fold


def tree_nodes(leaves: DataFrame) -> tuple[DataFrame, int]:
    """All nodes below the roots with their `sibling` (empty if none), and the tops with `hash`; and the largest depth.

    `leaves` has `tree`, `size`, `pos` and `hash` (32 bytes). Two consecutive nodes become the hash of their hex digests,
    an odd last one the hash of its own, until one is left. A task folds blocks of 2^9 nodes, so a tree of 10^10 leaves
    takes four passes, each over a 512th of the one before.
    """
    deepest = leaves.agg(F.max(_depth(F.col("size")))).first()[0] or 0
    level, found = leaves.select("tree", "size", F.col("pos").alias("idx"), "hash"), None
    for base in range(0, max(deepest, 1), BLOCK_LEVELS):
        blocks = level.groupBy("tree", "size", F.shiftright("idx", BLOCK_LEVELS).alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("nodes"))
        blocks = blocks.select("tree", "size", _depth(F.col("size")).alias("depth"), "block", "nodes")
        nodes = staged(blocks.mapInArrow(_folded(base, BLOCK_LEVELS), _NODES), "manifest-nodes")
        found = nodes if found is None else found.unionByName(nodes)
        level = nodes.where((F.col("level") == base + BLOCK_LEVELS) & F.col("hash").isNotNull() & (F.col("level") < _depth(F.col("size")))).select("tree", "size", "idx", "hash")
    return found, deepest


def segments_to_root(nodes: DataFrame, deepest: int) -> DataFrame:
    """`tree`, `pos` and `segment` of each leaf of a tree of several: the siblings up to the root, 32 bytes each.

    At first each node holds its own sibling and points to its parent. In round k a node at a level divisible by
    2^(k+1) points 2^k levels up; a self-join with the nodes it points to joins the segments and doubles the distance,
    so ⌈log₂ depth⌉ rounds reach the root. Nodes at other levels are not asked again and go. Many leaves share an
    ancestor in late rounds, but the ancestors are few then: that side is counted and broadcast if small, and where it
    isn't, no ancestor has more than a small share of the rows.
    """
    paths = nodes.where("sibling IS NOT NULL").select("tree", _depth(F.col("size")).alias("depth"), "level", "idx", (F.col("level") + 1).alias("upto"), F.col("sibling").alias("segment"))
    k = 0
    while 1 << k < deepest:
        step = 1 << k
        left, right = paths.where(F.col("level") % (2 * step) == 0), paths.where(F.col("level") % (2 * step) == step)
        right = right.select(F.col("tree").alias("_t"), F.col("level").alias("_l"), F.col("idx").alias("_i"), F.col("upto").alias("_upto"), F.col("segment").alias("_segment"))
        right = broadcast_if_small(right, SMALL_SIDE)
        on = (F.col("tree") == F.col("_t")) & (F.col("upto") == F.col("_l")) & (F.expr("shiftright(idx, upto - level)") == F.col("_i"))
        moved = left.where("upto < depth").join(right, on).select("tree", "depth", "level", "idx", F.col("_upto").alias("upto"), F.concat("segment", "_segment").alias("segment"))
        paths = staged(left.where("upto >= depth").unionByName(moved), "manifest-paths")
        k += 1
    return paths.where("level = 0").select("tree", F.col("idx").alias("pos"), "segment")


def proofs(leaves: DataFrame) -> DataFrame:
    """`tree`, `pos`, `size`, `hash` → also `segment` (siblings up to the root of the tree) and `top`, that root."""
    nodes, deepest = tree_nodes(leaves)
    tops = nodes.where(F.col("hash").isNotNull() & (F.col("level") == _depth(F.col("size")))).select("tree", F.col("hash").alias("top"))
    out = leaves.join(segments_to_root(nodes, deepest), ["tree", "pos"], "left") if deepest else leaves.withColumn("segment", F.lit(None).cast("binary"))
    out = out.withColumn("segment", F.coalesce("segment", F.lit(b"")))
    return out.join(broadcast_if_small(tops, SMALL_SIDE), "tree")


def _climb(node: bytes, segment: bytes, pos: int, size: int) -> bytes:
    """The root that follows from a leaf and its siblings."""
    at = 0
    while size > 1:
        if pos == size - 1 and pos % 2 == 0:
            node = _node_hash((node,))
        else:
            other = segment[at:at + 32]
            node, at = _node_hash((other, node) if pos % 2 else (node, other)), at + 32
        pos, size = pos >> 1, (size + 1) >> 1
    return node


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        columns = dict(zip(names, (c.to_pylist() for c in batch.columns), strict=True))
        digest, folded = [], []
        for leaf, low, pos, size, high, place, trees in zip(*[columns[n] for n in ("checked", "segment", "pos", "size", "_high", "_place", "_trees")], strict=True):
            digest.append(hashlib.sha256((low + high).hex().encode()).hexdigest())
            folded.append(_climb(_climb(leaf, low, pos, size), high, place, trees))
        text = lambda n: pa.array([x.hex() for x in columns[n]], pa.string())
        folded_text, root = pa.array([x.hex() for x in folded], pa.string()), columns["root"]
        same = pa.array([a == b for a, b in zip(folded, root, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(names.index("id")), text("hash"), text("top"), text("root"), pa.array(digest, pa.string()), folded_text, same],
                                         ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_column: str = "doc_id", tree_column: str = "lang",
             altered: dict[str, Column] | None = None, altered_rows: Column | None = None) -> DataFrame:
    """One row per document: id, `leaf`, `subroot`, `root`, `proof_sha256`, `folded_root`, `verified`.

    A leaf is the digest of `columns`. Leaves of one `tree_column` value, by ascending id (null first; rows that share
    the id by leaf), form a tree; the roots of these trees, by value (null first, bytewise), form the upper one. The
    proof of a leaf is its siblings up to the root of all. Verification folds each row's leaf with its proof: `altered`
    replaces columns of the rows in `altered_rows` first, which is how tampering shows. Repeated rows are leaves of their
    own, null and empty texts have their own digests, other columns are ignored, an empty table gives no rows.

    Texts are read once; what moves after that is digests.
    """
    own = {c: F.col(f"`{c}`") for c in columns}
    leaf = leaf_digest(list(own.values()))
    checked = leaf
    if altered:
        checked = F.when(F.coalesce(altered_rows, F.lit(False)), leaf_digest([altered.get(c, own[c]) for c in columns])).otherwise(leaf)
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree_column}`").cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), F.col(f"`{id_column}`").alias("id"), F.unhex(leaf).alias("hash"), F.unhex(checked).alias("checked"))
    rows = staged(placed(rows, ["id", "hash"]), "manifest-leaves")
    low = staged(proofs(rows), "manifest-proofs")
    roots = low.groupBy("tree").agg(F.first("top").alias("hash"))
    roots = placed(roots.select(F.lit("").alias("tree"), F.col("tree").alias("part"), "hash"), ["part"])
    high = proofs(staged(roots, "manifest-roots")).select(F.col("part").alias("tree"), F.col("segment").alias("_high"), F.col("pos").alias("_place"), F.col("size").alias("_trees"), F.col("top").alias("root"))
    rows = low.join(broadcast_if_small(staged(high, "manifest-upper"), SMALL_SIDE), "tree")
    kind = docs.select(F.col(f"`{id_column}`").alias("id")).schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_verified, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumnRenamed("id", id_column)
