"""SimHash near-dedup by vantage-point trees.

Equal fingerprints fold into one first. A vantage-point tree over a bounded sample cuts the fingerprint space into
shards: each inner node has a vantage point and a radius; the near branch takes the points within the radius, the far
branch those beyond it and, since they may link across, those less than `LINK` inside it. By the triangle inequality
two fingerprints at most LINK apart then always meet in some shard: either both lie within the radius, or one lies
beyond it and so the other beyond radius - LINK. Every shard searches its points with a tree of its own down to
small blocks that compare all pairs, and hands on one tree of links for each connected set, not all pairs. The
components of those links are found in the cluster (`graph`).

Defined cases: a null or empty text, or one of white space, has fingerprint zero and links like any other; a null id
has a component but never names one (a component of null ids only has the id null); repeated rows share a component;
very long texts are hashed whole; ties of a bit (set in exactly half of the hashes) leave it 0; only the named columns are read,
whatever others are called; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import id_and_text, one_row_each, per_slice
from panelmill.llm.graph import components
from panelmill.session import checkpoint

#: Words of a shingle, seed of its hash, and differing bits that still link.
WORDS, SEED, LINK = 3, 42, 2
#: Fingerprints that the tree of shards is built on (expected), fingerprints a shard is to have, and the most shards.
SAMPLE, SHARD, MOST_SHARDS = 16_384, 4_000, 4_096
#: Up to this many fingerprints are compared with one another; a shard expected to be larger than this is dealt out in pairs of parts.
BLOCK, PART = 512, 200_000
#: Vantage points tried at each node.
TRIALS = 8


def fingerprint(text: str) -> int:
    """The signed 64-bit fingerprint of a text."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(WORDS, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1].tolist()
    ends = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=False)], np.uint64)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and fingerprint (long) of every row."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = pa.array([fingerprint(t) for t in batch.column("text").to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), marks], ["doc_id", "text_hash", "fingerprint"])

    texts = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return texts.mapInArrow(per_slice(of), "doc_id long, text_hash long, fingerprint long")


def _apart(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def _split(points: np.ndarray, rng: np.random.Generator, link: int = LINK) -> tuple[np.uint64, int] | None:
    """The vantage point and radius that leave least to compare; None if no split makes both branches smaller."""
    best = None
    for vantage in points[rng.integers(0, len(points), TRIALS)]:
        counts = np.bincount(_apart(points, vantage), minlength=65 + LINK)
        near = np.cumsum(counts)
        far = len(points) - np.r_[np.zeros(link, int), near[:-link]]  # beyond radius - link
        cost = near.astype(float) ** 2 + far.astype(float) ** 2
        radius = int(cost[:65].argmin())
        if max(near[radius], far[radius]) < len(points) and (best is None or cost[radius] < best[0]):
            best = (cost[radius], vantage, radius)
    return best and best[1:]


@dataclass(frozen=True)
class Tree:
    """Inner nodes as (vantage, radius, near, far); a branch below zero is the shard -1 - branch. parts: of each shard."""

    nodes: tuple[tuple[int, int, int, int], ...]
    parts: tuple[int, ...]

    @classmethod
    def built(cls, sample: np.ndarray, total: int) -> Tree:
        """A tree over the sample whose shards hold about SHARD of `total` points."""
        goal = max(SHARD * len(sample) / max(total, 1), 1)
        rng = np.random.default_rng(SEED)
        nodes: list[list[int]] = []
        parts: list[int] = []

        def grow(points: np.ndarray, left: int) -> int:
            found = _split(points, rng) if len(points) > goal and left > 1 else None
            if found is None:
                share = len(points) / max(len(sample), 1)
                parts.append(max(1, -(-round(total * share) // PART)))
                return -len(parts)
            vantage, radius = found
            apart = _apart(points, vantage)
            nodes.append([int(vantage), radius, 0, 0])
            at = len(nodes) - 1
            nodes[at][2] = grow(points[apart <= radius], left // 2)
            nodes[at][3] = grow(points[apart > radius - LINK], left // 2)
            return at

        grow(sample, MOST_SHARDS)
        return cls(tuple(map(tuple, nodes)), tuple(parts))

    def shards(self, points: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """The shards that the points lie in, with the points' positions."""
        out, todo = [], [(0 if self.nodes else -1, np.arange(len(points)))]
        while todo:
            at, which = todo.pop()
            if not len(which):
                continue
            if at < 0:
                out.append((-1 - at, which))
                continue
            vantage, radius, near, far = self.nodes[at]
            apart = _apart(points[which], np.uint64(vantage))
            todo += [(near, which[apart <= radius]), (far, which[apart > radius - LINK])]
        return out


def _linked(points: np.ndarray, link: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the connected sets of a few points: (point, smallest point it reaches here)."""
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= link
    some = np.flatnonzero(near.sum(axis=1) > 1)
    if not len(some):
        return points[:0], points[:0]
    near, points = near[np.ix_(some, some)], points[some]
    label = np.arange(len(points))
    while True:
        new = np.where(near, label, len(points)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(points))
    return points[moved], points[label[moved]]


def links(points: np.ndarray, link: int = LINK) -> tuple[np.ndarray, np.ndarray]:
    """Links of distinct points by a vantage-point tree; where no split helps, blocks meet in pairs."""
    rng = np.random.default_rng(SEED)
    left, right, todo = [], [], [points]
    while todo:
        own = todo.pop()
        if len(own) <= 1:
            continue
        if len(own) <= BLOCK:
            pair = [_linked(own, link)]
        elif found := _split(own, rng, link):
            apart = _apart(own, found[0])
            todo += [own[apart <= found[1]], own[apart > found[1] - link]]
            continue
        else:
            blocks = [own[i : i + BLOCK // 2] for i in range(0, len(own), BLOCK // 2)]
            pair = [_linked(np.concatenate([a, b]), link) for i, a in enumerate(blocks) for b in blocks[i + 1 :]]
        left += [a for a, _ in pair]
        right += [b for _, b in pair]
    if not left:
        return points[:0], points[:0]
    both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
    return both[0], both[1]


def classes(marks: DataFrame) -> DataFrame:
    """(fingerprint, component) of every distinct fingerprint, the component named by one of its fingerprints."""
    spark = marks.sparkSession
    distinct = checkpoint(marks.select("fingerprint").distinct())
    total = distinct.count()
    drawn = F.pmod(F.xxhash64(F.lit("vantage"), "fingerprint"), F.lit(1 << 30)) < min(1.0, SAMPLE / max(total, 1)) * float(1 << 30)
    sample = np.array(sorted(r[0] for r in distinct.filter(drawn).collect()), np.int64).view(np.uint64)  # about SAMPLE, whatever the input
    tree = spark.sparkContext.broadcast(Tree.built(sample, total))

    def route(batches):
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            for shard, which in tree.value.shards(points):
                parts = tree.value.parts[shard]
                own = points[which]
                mine = (own * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(parts)
                for first in range(parts):
                    for second in range(first + (parts > 1), parts):
                        chosen = own[(mine == first) | (mine == second)]
                        if len(chosen):
                            yield pa.RecordBatch.from_pydict({
                                "shard": np.full(len(chosen), shard, np.int32), "first": np.full(len(chosen), first, np.int32),
                                "second": np.full(len(chosen), second, np.int32), "fingerprint": chosen.view(np.int64),
                            })

    def search(shard: pa.Table) -> pa.Table:
        a, b = links(np.sort(shard.column("fingerprint").to_numpy().view(np.uint64)))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    routed = distinct.mapInArrow(route, "shard int, first int, second int, fingerprint long")
    edges = routed.groupBy("shard", "first", "second").applyInArrow(search, "a long, b long")
    found = components(edges).select(F.col("node").alias("_node"), "component")
    return distinct.join(found, F.col("fingerprint") == F.col("_node"), "left").select(
        "fingerprint", F.coalesce("component", "fingerprint").alias("component")
    )


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, fingerprint of every row, and its component's first (no_id, doc_id, text_hash)."""
    marks = checkpoint(fingerprints(docs, id_col, text_col))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    own = marks.groupBy("fingerprint").agg(F.min(first).alias("first"))
    named = own.join(classes(marks), "fingerprint")
    least = named.groupBy("component").agg(F.min("first").alias("first"))
    answer = checkpoint(named.drop("first").join(least, "component").select("fingerprint", "first"))
    return marks.join(answer, "fingerprint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    return _marked(docs, id_col, text_col).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns, that stay when one row of each component does: the smallest id, then text hash."""
    stay = _marked(docs, id_col, text_col).select("first.doc_id", "first.text_hash").distinct()
    return one_row_each(docs, {"doc_id": F.col(id_col).cast("long"), "text_hash": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))}, stay)
