"""Phrase collocations by a weighted de Bruijn graph of words.

Texts are cut into pieces and those into words. Nodes are pairs of neighbouring words, edges the triples that lead from one node to the
next, overlapping in a word; an edge weighs as much as its triple occurs. Only triples are counted in the corpus, plus what ends with a
piece: its last pair has no third word, its last word no second one. Shorter counts follow from the flow: a pair occurs as often as its
node's edges weigh together, plus the pieces that end there; a word as often as the pairs that begin with it, plus the pieces that end
with it.

Counting triples is the one large shuffle. Python folds equal triples of a slice of text, deals them into buckets by their first word,
and hands on one compressed block for each bucket: its words once, and its triples as sorted numbers of them. A bucket's blocks meet in
one task, which sums edges, flows of nodes and flows of words where they are and lets on only those of `least` or more: nothing rarer can
be a phrase or part of one (a phrase's parts occur at least as often as itself). The number of buckets follows the bytes of text, so a
bucket stays small. A word with very many different edges would fill its bucket: words, and nodes, with over 1 / HOT of the distinct
triples of a bounded sample (so at most HOT of each) are dealt by the node and by the edge instead, and their flows summed afterwards.
The sample decides where triples meet, never what they count.

The frequent part is compacted: a node that all of one edge flows into and all of one edge flows out of, nothing beginning or ending
there, is passed in one way only; chains of such nodes become one path of one weight (pointer doubling, the length of the longest path
halves each round). Inside a path every pair weighs what the path weighs, so flows are looked up for the ends of paths alone.

A phrase is scored by its weakest cut, floor(10^6 a^2 / (l r)) with exact decimals. It goes if a longer candidate that contains
it has `share` percent of its count or more; longer candidates are the edges into and out of its node.

Defined cases: a null or empty text has no words; a null language is `und`, and so is the language named so; repeated rows count as
often as they occur; ids are not read; equal scores are ordered by count, then by phrase in UTF-8; columns other than text and language
are not read, whatever their names; very long texts are taken in one slice each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.common import slices, staged
from panelmill.session import broadcast_if_small, checkpoint

#: A word or node is hot beyond this part of a sample's distinct triples; documents of the sample (expected).
HOT, SAMPLE = 5_000, 4_000
#: Bytes of text for each bucket.
BUCKET = 16 << 20
#: Parts that a language's phrases are ranked in first.
RANKERS = 64
_SLICE = 8 << 20
#: A-Z become a-z, signs and line ends that cut pieces become line feeds, tabs spaces.
_FOLD = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" "
)
_COUNTS = "lang string, w1 string, w2 string, w3 string, c long"


def _words(texts: list[str], known: defaultdict[bytes, int]) -> np.ndarray:
    """Numbers of the words of some texts, 0 after each piece."""
    whole = "\n".join(texts).encode().translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
    numbers = np.append(np.fromiter(map(known.__getitem__, whole), np.int64, len(whole)), 0)
    numbers = numbers[numbers != 1]  # the empty word between two spaces
    return numbers[np.append(True, (numbers[1:] > 0) | (numbers[:-1] > 0))]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sum of each one's counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], np.add.reduceat(counts, starts)


@dataclass(frozen=True)
class Triples:
    """Distinct triples of one language as numbers of `words` (0: the piece has ended), sorted, and their counts."""

    words: list[bytes]
    one: np.ndarray
    two: np.ndarray
    three: np.ndarray
    count: np.ndarray

    @classmethod
    def summed(cls, words: list[bytes], one: np.ndarray, two: np.ndarray, three: np.ndarray, counts: np.ndarray) -> Triples:
        """Word numbers are below 2^31, so two of them fit a key; nodes are numbered before the third is added."""
        width = max(len(words), 1)
        nodes, node = np.unique(one * width + two, return_inverse=True)
        keys, counts = _summed(node * width + three, counts)
        at = nodes[keys // width]
        return cls(words, at // width, at % width, keys % width, counts)

    @classmethod
    def of(cls, texts: list[str]) -> Triples:
        known: defaultdict[bytes, int] = defaultdict(count().__next__)
        known[b"\n"], known[b""]
        numbers = np.concatenate([_words(texts, known), [0, 0]])
        one, two = numbers[:-2], numbers[1:-1]
        three = np.where(two > 0, numbers[2:], 0)
        begins = one > 0
        return cls.summed(list(known), one[begins], two[begins], three[begins], np.ones(int(begins.sum()), np.int64))

    def packed(self, some: np.ndarray) -> bytes:
        """Some of the triples, and the words in them, compressed."""
        columns = [self.one[some], self.two[some], self.three[some]]
        used, numbers = np.unique(np.concatenate([[0], *columns]), return_inverse=True)
        columns = [*np.split(numbers[1:], 3), self.count[some]]
        columns[0] = np.diff(columns[0], prepend=0)
        # bytes of equal weight side by side compress best
        body = np.array(columns, "<i8").view(np.uint8).reshape(4, -1, 8).transpose(0, 2, 1).tobytes()
        names = b"\n".join(self.words[u] for u in used[1:].tolist())
        return zstandard.ZstdCompressor(level=3).compress(len(columns[0]).to_bytes(8, "little") + body + names)

    @classmethod
    def merged(cls, blocks: list[bytes]) -> Triples:
        """The triples of several blocks, summed."""
        known: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        parts = []
        for block in blocks:
            raw = zstandard.ZstdDecompressor().decompress(block)
            n = int.from_bytes(raw[:8], "little")
            columns = np.frombuffer(raw, np.uint8, 32 * n, 8).reshape(4, 8, n).transpose(0, 2, 1).copy().view("<i8")[:, :, 0]
            names = raw[8 + 32 * n :].split(b"\n")
            number = np.append(0, np.fromiter(map(known.__getitem__, names), np.int64, len(names)))
            parts.append((number[np.cumsum(columns[0])], number[columns[1]], number[columns[2]], columns[3]))
        return cls.summed([b"", *known], *(np.concatenate(c) for c in zip(*parts, strict=True)))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ np.atleast_1d(b) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ h >> np.uint64(32)


@dataclass(frozen=True)
class Deal:
    """Where triples meet: the number of buckets, and the hot words and nodes by language."""

    buckets: int
    words: dict[str, list[bytes]]
    nodes: dict[str, list[tuple[bytes, bytes]]]

    def hot(self, lang: str, t: Triples) -> tuple[np.ndarray, np.ndarray]:
        """Which triples begin with a hot word, and which with a hot node."""
        words, nodes = self.words.get(lang, []), self.nodes.get(lang, [])
        number = {w: i for i, w in enumerate(t.words)} if words or nodes else {}
        own = np.zeros(len(t.words), bool)
        own[[number[w] for w in words if w in number]] = True
        keys = [number[a] * len(t.words) + number[b] for a, b in nodes if a in number and b in number]
        return own[t.one], np.isin(t.one * len(t.words) + t.two, np.array(keys, np.int64))

    def bucket(self, lang: str, t: Triples) -> np.ndarray:
        hashes = np.fromiter((zlib.crc32(w) for w in t.words), np.uint64, len(t.words))
        if t.words:
            hashes[0] = 1
        word, node = self.hot(lang, t)
        h = _mixed(hashes[t.one], np.uint64(zlib.crc32(lang.encode())))
        h = np.where(word | node, _mixed(h, hashes[t.two]), h)
        h = np.where(node, _mixed(h, hashes[t.three]), h)
        return (h % np.uint64(self.buckets)).astype(np.int32)


def _by_lang(batch: pa.RecordBatch) -> dict[str, list[str]]:
    out: defaultdict[str, list[str]] = defaultdict(list)
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
        out[lang].append(text)
    return out


def _rows(lang: str, t: Triples, columns: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
    """Triples as rows of words, null for number 0; columns left out are null."""
    words = pa.array(t.words, pa.binary()).cast(pa.string())
    taken = [words.take(pa.array(c, mask=c == 0)) for c in columns]
    taken += [pa.nulls(len(counts), pa.string())] * (3 - len(taken))
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), *taken, pa.array(counts)], ["lang", "w1", "w2", "w3", "c"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct triples of each slice, as rows."""
    for batch in batches:
        for piece in slices(batch, most=_SLICE):
            for lang, texts in _by_lang(piece).items():
                t = Triples.of(texts)
                yield _rows(lang, t, [t.one, t.two, t.three], t.count)


def _frequent(lang: str, t: Triples, deal: Deal, least: int) -> Iterator[pa.RecordBatch]:
    """Edges, flows of nodes and flows of words of a bucket that may be frequent; the rest as one flow of the language."""
    width = max(len(t.words), 1)
    hot_word, hot_node = deal.hot(lang, t)
    edge = (t.count >= least) & (t.three > 0)
    yield _rows(lang, t, [t.one[edge], t.two[edge], t.three[edge]], t.count[edge])
    nodes, flows = _summed(t.one * width + t.two, t.count)
    partial = np.isin(nodes, np.unique((t.one * width + t.two)[hot_node]))
    stay = ((flows >= least) | partial) & (nodes % width > 0)
    yield _rows(lang, t, [nodes[stay] // width, nodes[stay] % width], flows[stay])
    words, flows = _summed(t.one, t.count)
    stay = (flows >= least) | np.isin(words, np.unique(t.one[hot_word | hot_node]))
    yield _rows(lang, t, [words[stay]], flows[stay])
    yield _rows(lang, t, [], np.array([flows[~stay].sum()], np.int64))


@dataclass(frozen=True)
class Graph:
    """The frequent part of the graph: edges (lang, w1, w2, w3, c), nodes (lang, w1, w2, f), words (lang, w1, f), totals (lang, n)."""

    edges: DataFrame
    nodes: DataFrame
    words: DataFrame
    totals: DataFrame


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _deal(texts: DataFrame) -> Deal:
    """Buckets by the bytes of text; hot words and nodes, at most HOT of each, by a sample of documents."""
    rows, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(max(1, rows // SAMPLE))) == 0)
    edges = some.mapInArrow(_sampled, _COUNTS).select("lang", "w1", "w2", "w3").distinct()
    nodes = checkpoint(edges.groupBy("lang", "w1", "w2").agg(F.count(F.lit(1)).alias("n")))
    often = F.col("n") > max((nodes.agg(F.sum("n")).first()[0] or 0) / HOT, 8)
    words_of, nodes_of = defaultdict(list), defaultdict(list)
    for r in nodes.groupBy("lang", "w1").agg(F.sum("n").alias("n")).filter(often).collect():
        words_of[r["lang"]].append(r["w1"].encode())
    for r in nodes.filter(often & F.col("w2").isNotNull()).collect():
        nodes_of[r["lang"]].append((r["w1"].encode(), r["w2"].encode()))
    shuffled = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Deal(max(2 * shuffled, -(-size // BUCKET)), dict(words_of), dict(nodes_of))


def build(docs: DataFrame, least: int, text_col: str = "text", lang_col: str = "lang") -> Graph:
    """The graph of all texts, without edges, nodes and words that occur less than `least` times; the totals count all words."""
    texts = _texts(docs, text_col, lang_col)
    shared = texts.sparkSession.sparkContext.broadcast(_deal(texts))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, most=_SLICE):
                for lang, own in _by_lang(piece).items():
                    t = Triples.of(own)
                    bucket = shared.value.bucket(lang, t)
                    order = np.argsort(bucket, kind="stable")
                    numbers, starts = np.unique(bucket[order], return_index=True)
                    blocks = [t.packed(some) for some in np.split(order, starts[1:])] if len(numbers) else []
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(numbers, pa.int32()), pa.array([lang] * len(blocks), pa.string()), pa.array(blocks, pa.binary())],
                        ["bucket", "lang", "block"],
                    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(n).to_pylist() for n in ("bucket", "lang", "block")), strict=True))
        for (_, lang), own in groupby(rows, key=lambda r: r[:2]):  # they come sorted
            yield from _frequent(lang, Triples.merged([block for _, _, block in own]), shared.value, least)

    blocks = texts.mapInArrow(pack, "bucket int, lang string, block binary").repartition("bucket").sortWithinPartitions("bucket", "lang")
    graph = staged(blocks.mapInArrow(merge, _COUNTS).groupBy("lang", "w1", "w2", "w3").agg(F.sum("c").alias("c")))
    words = graph.filter("w2 is null")
    return Graph(
        graph.filter("w3 is not null"),
        graph.filter((F.col("c") >= least) & F.col("w2").isNotNull() & F.col("w3").isNull()).select("lang", "w1", "w2", F.col("c").alias("f")),
        words.filter((F.col("c") >= least) & F.col("w1").isNotNull()).select("lang", "w1", F.col("c").alias("f")),
        words.groupBy("lang").agg(F.sum("c").alias("n")),
    )


_EDGE = ("lang", "w1", "w2", "w3")


def _through(graph: Graph) -> DataFrame:
    """One row per node with its heaviest edges: lang, w1, w2, f, w0, into (weight in), w3, out (weight out)."""
    none = F.lit(None).cast("struct<c: long, w: string>")
    zero = F.lit(0).cast("long").alias("f")
    into = graph.edges.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), zero, F.struct("c", F.col("w1").alias("w")).alias("i"), none.alias("o"))
    out = graph.edges.select("lang", "w1", "w2", zero, none.alias("i"), F.struct("c", F.col("w3").alias("w")).alias("o"))
    rows = into.unionByName(out).unionByName(graph.nodes.select("lang", "w1", "w2", "f", none.alias("i"), none.alias("o")))
    most = rows.groupBy("lang", "w1", "w2").agg(F.max("f").alias("f"), F.max("i").alias("i"), F.max("o").alias("o"))
    return most.select(
        "lang", "w1", "w2", "f", F.col("i.w").alias("w0"), F.coalesce("i.c", F.lit(0)).alias("into"), F.col("o.w").alias("w3"), F.coalesce("o.c", F.lit(0)).alias("out")
    )


def compacted(graph: Graph, through: DataFrame | None = None) -> DataFrame:
    """lang, w1, w2, w3, c, path, place, last: the edges in their paths, by the triple that a path begins with and the place in it.

    A node is passed in one way only if the edge into it and the edge out of it each carry its whole flow. No cycle consists of such nodes
    alone, as each occurrence follows from the beginning of its piece.
    """
    through = _through(graph) if through is None else through
    key = lambda *words: F.concat_ws(" ", *words)  # noqa: E731 - words hold no spaces
    only = through.filter((F.col("into") == F.col("f")) & (F.col("out") == F.col("f")))
    links = checkpoint(only.select("lang", key("w0", "w1", "w2").alias("before"), key("w1", "w2", "w3").alias("edge"), F.lit(1).cast("long").alias("steps")))
    # each edge that has one before it points at that, then at what that points at, until all point at the first of their paths
    while True:
        ahead = links.select(F.col("lang").alias("_lang"), F.col("edge").alias("_edge"), F.col("before").alias("_next"), F.col("steps").alias("_more"))
        moved = links.join(ahead, (F.col("lang") == F.col("_lang")) & (F.col("before") == F.col("_edge")), "left")
        if moved.filter("_edge is not null").isEmpty():
            break
        links = checkpoint(moved.select(
            "lang", F.coalesce("_next", "before").alias("before"), "edge", (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps")
        ))
    placed = links.select(F.col("lang").alias("_lang"), F.col("edge").alias("_edge"), F.col("before").alias("path"), F.col("steps").alias("place"))
    ends = only.select(F.col("lang").alias("_l"), key("w0", "w1", "w2").alias("_before"))
    edges = graph.edges.withColumn("_key", key("w1", "w2", "w3"))
    edges = edges.join(placed, (F.col("lang") == F.col("_lang")) & (F.col("_key") == F.col("_edge")), "left")
    edges = edges.join(ends, (F.col("lang") == F.col("_l")) & (F.col("_key") == F.col("_before")), "left")
    return edges.select(*_EDGE, "c", F.coalesce("path", "_key").alias("path"), F.coalesce("place", F.lit(0)).alias("place"), F.col("_l").isNull().alias("last"))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a^2 / (l r)), exact: products of three counts may pass 64 bits, so they are decimals of 38 digits."""
    big = lambda c: c.cast("decimal(19,0)")
    upper, lower = big(a) * big(a) * F.lit(1_000_000).cast("decimal(7,0)"), big(left) * big(right)
    return F.call_function("div", upper, lower)


def phrases(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2_000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, path_words: the `top` phrases of each language.

    path_words is the length in words of the compacted path that a phrase of three words lies on; null for pairs.
    """
    graph = build(docs, least, text_col, lang_col)
    through = checkpoint(_through(graph))
    paths = compacted(graph, through)
    sizes = paths.filter("last").select("lang", "path", (F.col("place") + 3).alias("path_words"))
    nodes = through.filter("f > 0").select("lang", "w1", "w2", "f")
    # inside a path a pair weighs what the path does; the flows of its two ends are looked up
    head = nodes.select("lang", "w1", "w2", F.col("f").alias("_head"), F.lit(0).cast("long").alias("place"))
    tail = nodes.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("_tail"), F.lit(True).alias("last"))
    three = paths.join(sizes, ["lang", "path"]).join(head, ["lang", "w1", "w2", "place"], "left").join(tail, ["lang", "w2", "w3", "last"], "left")
    three = checkpoint(three.select(*_EDGE, F.col("c").alias("a"), F.coalesce("_head", "c").alias("f12"), F.coalesce("_tail", "c").alias("f23"), "path_words"))
    # a pair goes if an edge into or out of its node has enough of its flow
    two = through.filter((F.col("f") > 0) & (100 * F.greatest("into", "out") < share * F.col("f"))).select(
        "lang", "w1", "w2", F.lit(None).cast("string").alias("w3"), F.col("f").alias("a"), F.lit(None).cast("long").alias("f12"),
        F.lit(None).cast("long").alias("f23"), F.lit(None).cast("long").alias("path_words"),
    )
    words = broadcast_if_small(graph.words)
    either = three.unionByName(two).withColumn("w", F.coalesce("w3", "w2"))
    either = either.join(words.select("lang", "w1", F.col("f").alias("f1")), ["lang", "w1"])
    either = either.join(words.select("lang", F.col("w1").alias("w"), F.col("f").alias("f3")), ["lang", "w"])
    a = F.col("a")
    pair = F.col("w3").isNull()
    first = F.struct(score(a, F.col("f1"), F.when(pair, F.col("f3")).otherwise(F.col("f23"))).alias("score"), F.lit(1).alias("k"),
                     F.col("f1").alias("l"), F.when(pair, F.col("f3")).otherwise(F.col("f23")).alias("r"))
    second = F.struct(score(a, F.col("f12"), F.col("f3")).alias("score"), F.lit(2).alias("k"), F.col("f12").alias("l"), F.col("f3").alias("r"))
    cut = F.when(pair, first).otherwise(F.least(first, second))
    scored = either.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", cut.alias("cut"), "path_words")
    order = [F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase")]
    # ranked in parts first: no task gets more than the best of each part of a language
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANKERS))
    best = scored.withColumn("_part", part).withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order)))
    ranked = best.filter(F.col("_at") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    out = ranked.filter(F.col("rank") <= top).join(graph.totals, "lang")
    return out.select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"), "path_words")
