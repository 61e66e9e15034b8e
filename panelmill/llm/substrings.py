"""Substring dedup by seed and extend: words that repeat a passage of a document with a smaller id are removed.

Seeds. Every window of `WINDOW` words holds WINDOW - GRAM + 1 grams of `GRAM` words; the gram of the smallest hash
(the last of equals) is its anchor. The choice depends on the window's words alone, so equal windows have equal
anchors, and one anchor stands for a run of about 16 neighbouring windows.

Extension. An occurrence of an anchor is extended to both sides over all windows of its run; the words of that stretch are
its class. Documents meet by anchor. Occurrences of one class agree in every window, so against the class's smallest
document all windows of the others match in full. Where an anchor has several classes, the stretches differ somewhere
to the left or right, and the smallest document of each class is compared window by window: each window is extended as
far as it still agrees with one of another class. Matched windows that overlap or touch merge into maximal repeats.

No pairs of documents are ever listed: a passage that a third of all documents share folds into one class (plus one
for each distinct surrounding at its ends) on the map side.

Equality is that of two independent 64-bit hashes of the words. Defined cases: a null, empty or short text has no
window and is kept whole; a null id is neither smaller nor larger than any id; rows with the same id do not remove
from each other; very long texts are cut into windows like any other; only the named columns are read,
whatever others are called; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import id_and_text, per_slice, staged

#: Words of a window and of an anchor.
WINDOW, GRAM = 50, 20
_SLICE = 8 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """The words of some texts behind one another, with hashes of any stretch of them."""

    def __init__(self, texts: list[str]):
        known: defaultdict[bytes, int] = defaultdict(count().__next__)
        numbers = []
        for text in texts:
            words = text.encode().split()
            numbers.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        flat = np.concatenate(numbers) if numbers else np.empty(0, np.int32)
        self.ends = np.cumsum([len(x) for x in numbers], dtype=np.int64)
        self.starts = np.r_[0, self.ends[:-1]].astype(np.int64)
        self.n = len(flat)
        self._sums, self._back = [], []
        for seed, (base, inverse) in enumerate(zip(_BASES, _INVERSES, strict=True)):
            word = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in known), np.uint64, len(known))
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(word[flat] * _powers(base, self.n)[:-1], out=sums[1:], dtype=np.uint64)
            self._sums.append(sums)
            self._back.append(_powers(inverse, self.n))

    def hashes(self, which: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums = self._sums[which]
        return _mixed((sums[end] - sums[begin]) * self._back[which][begin])


def _last_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each start, the position of the smallest of the next `width` values, the last of equals."""
    at = np.arange(len(values))
    span = 1

    def lesser(left, right):
        return np.where(values[right] <= values[left], right, left)

    while span * 2 <= width:
        at = lesser(at[: len(at) - span], at[span:])
        span *= 2
    rest = width - span
    return lesser(at[: len(at) - rest], at[rest:]) if rest else at


def anchors(words: Words) -> dict[str, np.ndarray]:
    """text (number), first (window, from the text's start), runs (windows), shift (anchor from first), anchor, span."""
    grams = np.arange(max(words.n - GRAM + 1, 0))
    empty = {k: np.empty(0, np.int64) for k in ("text", "first", "runs", "shift", "anchor", "span")}
    if words.n < WINDOW:
        return empty
    value = words.hashes(0, grams, grams + GRAM)
    chosen = _last_least(value, WINDOW - GRAM + 1)
    sizes = np.maximum(words.ends - words.starts - WINDOW + 1, 0)
    text = np.repeat(np.arange(len(sizes)), sizes)
    if not len(text):
        return empty
    start = np.arange(len(text)) + np.repeat(words.starts - (np.cumsum(sizes) - sizes), sizes)
    own = chosen[start]
    new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (text[1:] != text[:-1])])
    runs = np.diff(np.r_[new, len(text)])
    first, own, text = start[new], own[new], text[new]
    span = words.hashes(1, first, first + runs + WINDOW - 1)
    shift = own - first
    # the class also says where in it the anchor lies
    span = _mixed(span ^ (runs.astype(np.uint64) << np.uint64(32) | shift.astype(np.uint64)))
    return {
        "text": text, "first": first - words.starts[text], "runs": runs, "shift": shift,
        "anchor": value[own].view(np.int64), "span": span.view(np.int64),
    }


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))


def _seeds(batch: pa.RecordBatch) -> pa.RecordBatch:
    a = anchors(Words(batch.column("text").to_pylist()))
    at = pa.array(a["text"])
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(a["anchor"]), pa.array(a["span"]),
         pa.array(a["first"].astype(np.int32)), pa.array(a["runs"].astype(np.int32))],
        ["doc_id", "text_hash", "anchor", "span", "first", "runs"],
    )


def _windows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The two hashes of every window in the stretches that a document is asked for."""
    words = Words(batch.column("text").to_pylist())
    stretches = batch.column("stretches")
    text = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(stretches).to_numpy(zero_copy_only=False))
    first, runs = (stretches.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    which = np.repeat(text, runs)
    start = np.arange(len(which)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(first, runs)
    begin = words.starts[which] + start
    at = pa.array(which)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(start.astype(np.int32)),
         *[pa.array(words.hashes(i, begin, begin + WINDOW).view(np.int64)) for i in (0, 1)]],
        ["doc_id", "text_hash", "start", "one", "two"],
    )


def _per_document(rows: DataFrame, name: str, *columns) -> DataFrame:
    """The stretches of a document in one array; a document has fewer of them than words."""
    return rows.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct(*columns)).alias(name))


def _beside(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    other = lists.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return docs.join(other, same, how).drop("_id", "_hash")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, start, end: stretches of words whose windows all start in a document with a smaller id."""
    texts = _keyed(docs, id_col, text_col)
    seeds = staged(
        texts.mapInArrow(per_slice(_seeds, _SLICE), "doc_id long, text_hash long, anchor long, span long, first int, runs int")
    )
    per_class = seeds.groupBy("anchor", "span").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    per_class = staged(per_class)
    shared = (
        per_class.groupBy("anchor")
        .agg(F.min("least").alias("first_doc"), F.max("most").alias("last_doc"), (F.count(F.lit(1)) > 1).alias("several"))
        .filter("first_doc < last_doc")
        .select(F.col("anchor").alias("_anchor"), "several")
    )
    classes = staged(
        per_class.join(shared, F.col("anchor") == F.col("_anchor"))
        .filter("several or least < most")
        .select(F.col("anchor").alias("_anchor"), F.col("span").alias("_span"), "least", "several")
    )
    met = staged(
        seeds.join(classes, (F.col("anchor") == F.col("_anchor")) & (F.col("span") == F.col("_span")))
        .filter("doc_id > least or several and doc_id = least")
        .select("doc_id", "text_hash", "first", "runs", (F.col("doc_id") > F.col("least")).alias("whole"))
    )
    asked = _per_document(met.filter("not whole"), "stretches", "first", "runs")
    windows = staged(
        _beside(texts, asked, "inner").mapInArrow(per_slice(_windows, _SLICE), "doc_id long, text_hash long, start int, one long, two long")
    )
    least = staged(
        windows.groupBy("one", "two")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        .filter("least < most")
        .select(F.col("one").alias("_one"), F.col("two").alias("_two"), "least")
    )
    some = windows.join(least, (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two"))).filter("doc_id > least")
    return (
        met.filter("whole")
        .select("doc_id", "text_hash", F.col("first").alias("start"), (F.col("first") + F.col("runs") + WINDOW - 1).alias("end"))
        .unionByName(some.select("doc_id", "text_hash", "start", (F.col("start") + WINDOW).alias("end")))
    )


def _removed(batch: pa.RecordBatch) -> pa.RecordBatch:
    n_words, kept, ranges = [], [], []
    for text, own in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
        words = text.encode().split()
        out = np.zeros(len(words) + 1, np.int64)
        for r in own or ():
            out[r["start"]] += 1
            out[r["end"]] -= 1
        gone = np.cumsum(out)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False])).tolist()
        n_words.append(len(words))
        kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode() if edges else b" ".join(words).decode())
        ranges.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(ranges, kind), pa.array(kept, pa.string())],
        ["doc_id", "n_words", "repeats", "kept"],
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, repeats (maximal removed word ranges, ends exclusive) and the kept words of every row."""
    found = _per_document(repeated(docs, id_col, text_col), "found", "start", "end")
    return _beside(_keyed(docs, id_col, text_col), found, "left").mapInArrow(
        per_slice(_removed, _SLICE), "doc_id long, n_words long, repeats array<struct<start: int, end: int>>, kept string"
    )
