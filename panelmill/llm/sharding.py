"""Sharding: a hierarchical weighted hash tree of regions, racks and shards. DataFrame operations only.

A row descends the tree. On each level every child draws -ln(u) / weight from a hash of the row's key and the
child's path, and the smallest draw wins: child c is taken with probability weight(c) / sum of weights. A draw
depends on nothing but the key, the path and the child's own weight. So when weights change in one subtree, rows
move only into children whose weight rose or out of children whose weight fell, and the choices inside every
other subtree stay as they are.

`grown` adds a shard as a region of its own. Only that region's draw is new, so rows move into the new shard and
nowhere else. A shard added to an existing rack instead (any edit of the tree is possible) raises the weights of
its rack and region too, and rows that enter those may settle in an old shard of the same subtree.

Defined cases: a null key is one key of its own; a null text has no bytes and the checksum of the empty text;
repeated rows get slots of their own; very long texts are measured whole; only the named columns are read,
whatever others are called; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.session import checkpoint

#: region -> rack -> shard -> weight
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]

#: Slots are counted in this many blocks per shard, so no task numbers a whole shard.
BLOCKS = 1024
_BITS = 52


def even_tree(shards: int, per_rack: int = 2, racks: int = 2) -> Tree:
    """Shards of weight 1 filled into racks, racks into regions."""
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(shards):
        rack = s // per_rack
        tree.setdefault(f"r{rack // racks}", {}).setdefault(f"k{rack}", {})[s] = 1.0
    return tree


def grown(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, which takes rows only into itself."""
    return {**tree, f"own{shard}": {f"own{shard}": {shard: weight}}}


def _hash_bits(text: Column) -> Column:
    """The first 52 bits of the MD5 digest as a long."""
    return F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("long")


def _draw(key: Column, path: Column, weight: Column) -> Column:
    u = (_hash_bits(F.concat_ws("|", key, path)) + 0.5) / float(2**_BITS)
    return -F.ln(u) / weight


def _children(tree: Tree) -> dict[str, list[tuple[str, float]]]:
    """path of an inner node -> (path, weight) of its children with any weight."""
    out: dict[str, list[tuple[str, float]]] = {"": []}
    for region, racks in tree.items():
        out[region] = []
        for rack, shards in racks.items():
            leaves = [(f"{region}/{rack}/{s}", float(w)) for s, w in shards.items() if w > 0]
            if leaves:
                out[f"{region}/{rack}"] = leaves
                out[region].append((f"{region}/{rack}", sum(w for _, w in leaves)))
        if out[region]:
            out[""].append((region, sum(w for _, w in out[region])))
    if not out[""]:
        raise ValueError("the tree has no shard with a weight")
    return {k: v for k, v in out.items() if v}


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard number of a key. The tree is part of the plan: its size is the number of shards, not of rows."""
    nodes = F.create_map(*[
        x
        for parent, kids in _children(tree).items()
        for x in (F.lit(parent), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(w).alias("weight")) for p, w in kids]))
    ])
    text = F.coalesce(key.cast("string"), F.lit("null"))
    at = F.lit("")
    for _ in ("region", "rack", "shard"):
        draws = F.transform(
            F.element_at(nodes, at),
            lambda c: F.struct(_draw(text, c["path"], c["weight"]).alias("draw"), c["path"].alias("path")),
        )
        at = F.array_min(draws)["path"]
    return F.element_at(F.split(at, "/"), -1).cast("int")


def assign(docs: DataFrame, tree: Tree, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """The rows with their shard, which replaces a column of that name. No shuffle."""
    return docs.withColumn(name, shard_of(F.col(key), tree))


def placed(docs: DataFrame, tree: Tree, more: Tree | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and, with a second tree, grown_shard of every row.

    Repeated rows are counted on the map side and numbered together, and a shard is numbered in `BLOCKS` blocks:
    block counts (shards x BLOCKS rows, whatever the input) give each block its offset.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    facts = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32")
    )
    counted = facts.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    doc = F.col("doc_id")
    rows = checkpoint(counted.select(
        "*",
        shard_of(doc, tree).alias("shard"),
        (shard_of(doc, more) if more else F.lit(None).cast("int")).alias("grown_shard"),
        (_hash_bits(F.concat_ws("|", doc.cast("string"), "size", "text_crc32")) % BLOCKS).alias("block"),
    ))
    blocks = rows.groupBy("shard", "block").agg(F.sum("copies").alias("in_block"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("shard", "block", F.coalesce(F.sum("in_block").over(before), F.lit(0)).alias("offset"))
    inside = (
        Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    )
    first = F.col("offset") + F.coalesce(F.sum("copies").over(inside), F.lit(0))
    return (
        rows.join(F.broadcast(offsets), ["shard", "block"])  # at most shards x BLOCKS rows
        .withColumn("first", first)
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "grown_shard",
            F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("slot"),
        )
    )
