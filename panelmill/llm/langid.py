"""Language ID by bit-sliced Bloom filters of n-grams.

Every language has a Bloom filter of its frequent character trigrams, all with the same hashes, stored across:
the word at a position has bit l set where the filter of language l has that position. Looking up a trigram
means ANDing the words at its positions; the bits left name all languages that hold it. A text's score in a
language is the number of its trigrams with that bit, less the number that the filter's own rate of false
positives would give. Lower-case letters count; everything else is a gap between words.

The model is fitted on all labelled documents that are not held out, counted map-side first, and has `GRAMS` trigrams per
language: its size grows with the number of languages, not with the data.

Defined cases: a text that is null or has no letter is `und` with score 0; a text of letters none of which a
language knows gets the most frequent label with score 0; ties go to the first label in order; without labelled rows
everything is `und`; a row with a null id is neither held out nor learned from; a null label is not learned;
repeated rows are each answered alike; very long texts are read whole, in slices of bounded size; only the named columns are read, whatever
others are called; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.common import per_slice

#: Trigrams kept of each language.
GRAMS = 6000
#: Positions of the filters (a power of two) and hashes of a trigram.
POSITIONS, HASHES = 1 << 18, 3
FOLDS = 5
#: Of each language, the quantile of the held-out scores and margins, and the shares of it that a text must reach to be kept.
QUANTILE, SCORE_SHARE, MARGIN_SHARE = 0.01, 0.8, 0.5
UNKNOWN = "und"
_SLICE = 2 << 20
_GAP = 32


def _letters() -> np.ndarray:
    known = np.zeros(0x110000, bool)
    known[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return known


_LETTER: list[np.ndarray] = []


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams with a letter in the middle, the n + 1 offsets of the texts in them, and which texts have a letter."""
    if not _LETTER:
        _LETTER.append(_letters())
    lower = [t.lower() for t in texts]
    points = np.frombuffer(("\n" + "\n".join(lower) + "\n").encode("utf-32-le"), "<u4")
    letter = _LETTER[0][points]
    points = np.where(letter, points, np.uint32(_GAP)).astype(np.int64)
    middle = np.flatnonzero(letter)
    grams = points[middle - 1] << 42 | points[middle] << 21 | points[middle + 1]
    # text i begins at 1 + the lengths before it and one separator each
    starts = 1 + np.cumsum([0, *(len(t) + 1 for t in lower)])
    offsets = np.searchsorted(middle, starts)
    return grams, offsets, np.diff(offsets) > 0


def positions(grams: np.ndarray) -> list[np.ndarray]:
    """The filter positions of each trigram, one array per hash."""
    h = grams.astype(np.uint64)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(POSITIONS - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass(frozen=True)
class Filters:
    """languages in order; slices (POSITIONS, words of 64 languages); rate of false positives; the most frequent label."""

    languages: tuple[str, ...]
    slices: np.ndarray
    false: np.ndarray
    usual: str

    @classmethod
    def of(cls, grams: dict[str, np.ndarray], usual: str) -> Filters:
        languages = tuple(sorted(grams))
        slices = np.zeros((-(-len(languages) // 64), POSITIONS), np.uint64)
        for i, lang in enumerate(languages):
            for at in positions(np.asarray(grams[lang], np.int64)):
                slices[i // 64, at] |= np.uint64(1 << i % 64)
        fill = [np.count_nonzero(slices[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / POSITIONS for i in range(len(languages))]
        return cls(languages, slices, np.array(fill) ** HASHES, usual)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text and language, the corrected number of known trigrams; trigrams per text; which texts have a letter."""
        grams, offsets, has = trigrams(texts)
        at = positions(grams)
        total = np.diff(offsets)
        found = np.zeros((len(texts), len(self.languages)))
        for word, column in enumerate(self.slices):
            masks = column[at[0]]
            for other in at[1:]:
                masks &= column[other]
            for i in range(64 * word, min(64 * word + 64, len(self.languages))):
                upto = np.r_[0, np.cumsum(masks >> np.uint64(i % 64) & np.uint64(1))]
                found[:, i] = upto[offsets[1:]] - upto[offsets[:-1]]
        corrected = (found - total[:, None] * self.false) / (1 - self.false)
        return np.maximum(corrected, 0), total, has

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores, _ = self.judge(texts)
        return names, scores

    def judge(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Per text: the language, its score, and by how much that is above the second language's."""
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        found, total, has = self.counts(texts)
        best = found.argmax(axis=1)
        shares = np.clip(found / np.maximum(total, 1)[:, None], 0, 1)
        score = shares[np.arange(len(texts)), best]
        shares[np.arange(len(texts)), best] = 0
        margin = score - shares.max(axis=1)
        names = [
            (self.languages[b] if s > 0 else self.usual) if h else UNKNOWN for b, s, h in zip(best, score, has, strict=True)
        ]
        return names, np.where(has, score, 0.0).tolist(), np.where(has, margin, 0.0).tolist()


def remainder(id_col: str = "doc_id") -> Column:
    """The fold of a document: crc32 of its id as text."""
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % FOLDS


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Filters:
    """Fit on labelled documents whose fold is not 0."""
    labelled = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("string").alias("lang")
    ).filter(F.col("lang").isNotNull() & (remainder("doc_id") != 0))
    rows = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one per language
    if not rows:
        return Filters((), np.zeros((0, POSITIONS), np.uint64), np.zeros(0), UNKNOWN)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = batch.column("text").to_pylist()
        out = []
        for lang in sorted(set(langs)):
            grams, n = np.unique(trigrams([t for t, k in zip(texts, langs, strict=True) if k == lang])[0], return_counts=True)
            out.append(pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams), pa.string()), "gram": grams, "n": n}))
        return pa.Table.from_batches(out).combine_chunks().to_batches(max_chunksize=None)[0] if sum(map(len, out)) else out[0]

    counted = labelled.select("text", "lang").mapInArrow(per_slice(count, _SLICE), "lang string, gram long, n long")
    grams = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the most frequent of each language: every partition keeps its first GRAMS before they meet
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    most = grams.withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= GRAMS)
    model = {r["lang"]: r["grams"] for r in most.groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()}
    usual = min(rows, key=lambda lang: (-rows[lang], lang))
    return Filters.of({lang: np.array(model.get(lang, []), np.int64) for lang in rows}, usual)


def predict(docs: DataFrame, model: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = shared.value.predict(["" if t is None else t for t in batch.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
        )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(per_slice(label, _SLICE), "doc_id long, lang_pred string, score double")


def levels(docs: DataFrame, model: Filters, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> dict[str, tuple[float, float]]:
    """The least score and margin of each language: shares of a low quantile over held-out documents that get their own label.

    All labelled documents of fold 0 count, which `fit` does not learn from.
    """
    held = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("string").alias("lang")
    ).filter(F.col("lang").isNotNull() & (remainder("doc_id") == 0))
    rows = {r["lang"]: r["n"] for r in held.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one per language
    if not rows:
        return {}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores, margins = shared.value.judge(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())],
            ["lang", "found", "score", "margin"],
        )

    judged = held.select("text", "lang").mapInArrow(per_slice(judge, _SLICE), "lang string, found string, score double, margin double")
    low = judged.filter("lang = found").groupBy("lang").agg(*[F.percentile_approx(c, QUANTILE).alias(c) for c in ("score", "margin")])
    return {r["lang"]: (SCORE_SHARE * r["score"], MARGIN_SHARE * r["margin"]) for r in low.collect()}


def known_language(
    docs: DataFrame, model: Filters, least: float = 0.1, text_col: str = "text", levels: dict[str, tuple[float, float]] | None = None
) -> DataFrame:
    """The rows, all columns, whose text has letters and a language that explains enough of its trigrams.

    Enough is the score and the margin that `levels` gives for the language; `least`, and no margin, where it gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, levels or {}))

    @F.arrow_udf("boolean")
    def keep(texts: pa.Array) -> pa.Array:
        own, level = shared.value
        out = []
        for piece in range(0, len(texts), 256):
            judged = own.judge(["" if t is None else t for t in texts.slice(piece, 256).to_pylist()])
            for name, score, margin in zip(*judged, strict=True):
                low, apart = level.get(name, (least, 0.0))
                out.append(name != UNKNOWN and score >= low and margin >= apart)
        return pa.array(out, pa.bool_())

    return docs.filter(keep(F.col(text_col)))
