"""Benchmark decontamination by latent semantic retrieval.

Passages are `PASSAGE` words, half overlapping, so each is two neighbouring cells of half as many words. Their TF-IDF rows (a term counts
once a cell, weighted by the inverse share of all corpus cells that hold it; all terms of the benchmark carry weight, and all cells are
counted) form a matrix A. The space is fitted on the passages of all documents and the benchmark's own rows, which together weigh as
much: one pass sums the pairs of terms that share a passage, each task makes Z = A'(A Omega) of its sums for a random Omega of
RANK + EXTRA columns, Z is summed map side first, and the randomised decomposition of A'A from Z and Omega gives the top RANK right
singular vectors. The search then puts every passage of every row into that space, each cell projected once and neighbours added, and
takes those whose cosine with a benchmark passage is at least `COSINE`. Each candidate is checked on the text, if the cells around hold
enough of the item's words: the longest common subsequence with the whole item, in the words around the passage, must cover
`VERBATIM` of it; or `PARAPHRASE` of it if the item's answer (its `answer` column, else its last sentence) is there as well.

What is sent to the tasks is the benchmark's: its terms times RANK numbers. Items are taken in blocks of `WORDS` words (one item at
least), so a larger benchmark means more passes over the documents, for the counts, the fit and the search of each block, not larger
tasks: this fits benchmarks of up to some millions of words, not ones that rival the corpus. Tasks work in pieces: the terms of `ROWS`
cells are summed and `COSINES` cosines made at a time, however long a text is and however many probes there are.

Defined cases: null or empty texts match nothing; an item without words matches nothing; items with a null id are reported with it;
repeated rows are reported as often as they occur (and count once in the fit); of an item's passages in a text the one that covers
most is reported, then the one with the highest cosine, then the first; very long texts are searched whole, a piece at a time; columns
other than those named are not read, whatever their names; without items or documents the result is empty.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import id_and_text, per_slice, slices
from panelmill.session import broadcast_if_small

#: Words of a passage; singular vectors and extra random columns; words of benchmark items of one round.
PASSAGE, RANK, EXTRA, WORDS = 32, 240, 16, 64_000
#: Cells summed and cosines made at a time.
ROWS, COSINES = 512, 1 << 21
#: Frequent terms whose pairs are summed in one array (38 MB), and pairs of others that are held before they are folded.
DENSE, PAIRS = 3_072, 1 << 19
#: Cells times terms looked up at a time, and cells of the longest items whose words are looked up before they are compared.
BITS, FAR = 1 << 24, 16
COSINE, VERBATIM, PARAPHRASE, ANSWER = 0.4, 0.8, 0.6, 0.8
_SEED = 7
#: Numbers of a row of Z that are summed together.
COLUMNS = 64
_SLICE = 3 << 20
_SENTENCE_END = re.compile(r"[.!?]+\s+")
_SIGNS = bytes.maketrans(bytes(string.punctuation, "ascii"), b" " * len(string.punctuation))


def words_of(text: str) -> list[bytes]:
    """Lower-case words in UTF-8, cut at white space and ASCII signs."""
    return text.lower().encode().translate(_SIGNS).split()


def numbers_of(texts: list[str], terms: dict[bytes, int]) -> list[np.ndarray]:
    """The numbers of each text's words, -1 for a word that is no term."""
    out = []
    for text in texts:
        words = words_of(text)
        out.append(np.fromiter(map(terms.get, words, repeat(-1)), np.int32, len(words)))
    return out


@dataclass(frozen=True)
class Item:
    item_id: int | None
    words: tuple[bytes, ...]
    answer: tuple[bytes, ...]

    @classmethod
    def of(cls, item_id: int | None, text: str, answer: str | None) -> Item:
        sentences = [s for s in _SENTENCE_END.split(text) if words_of(s)]
        last = answer if answer is not None else sentences[-1] if len(sentences) > 1 else ""
        return cls(item_id, tuple(words_of(text)), tuple(words_of(last)))


def common_length(one: tuple[bytes, ...], other: list[bytes]) -> int:
    """Length of the longest common subsequence, a bit per word of the first."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(one):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(one)) - 1
    row = full
    for w in other:
        if (p := places.get(w)) is not None:
            hit = row & p
            row = (row + hit | row - hit) & full
    return len(one) - row.bit_count()


class Cells:
    """The cells of some texts, half a passage each, as sorted, distinct (cell, term) pairs. Passage p of a text is its cells p and p + 1."""

    HALF = PASSAGE // 2

    def __init__(self, texts: list[np.ndarray], width: int):
        counts = np.array([len(t) for t in texts], np.int64)
        self.each = -(-counts // self.HALF)
        self.text = np.repeat(np.arange(len(texts)), self.each)
        self.offset = np.cumsum(self.each) - self.each
        self.n = len(self.text)
        numbers = np.concatenate([*texts, np.empty(0, np.int32)])
        at = np.flatnonzero(numbers >= 0)
        text = np.searchsorted(np.cumsum(counts), at, side="right")
        cell = self.offset[text] + (at - (np.cumsum(counts) - counts)[text]) // self.HALF
        keys = np.sort(cell * max(width, 1) + numbers[at])
        keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
        self.cell, self.term = np.divmod(keys, max(width, 1))

    def first_word(self, cell: np.ndarray) -> np.ndarray:
        return (cell - self.offset[self.text[cell]]) * self.HALF

    def begins_passage(self) -> np.ndarray:
        """Which cells begin a passage: all but a text's last, and a text's only one."""
        last = np.append(self.text[1:] != self.text[:-1], True) if self.n else np.empty(0, bool)
        return ~last | (self.each[self.text] == 1)


def _items_in(terms: dict[bytes, int], items: list[Item]) -> Cells:
    return Cells([np.array([terms[w] for w in i.words], np.int32) for i in items], len(terms))


class Space:
    """Terms, weights and right singular vectors; the benchmark's passages in that space."""

    def __init__(self, items: list[Item], terms: dict[bytes, int], weight: np.ndarray, vectors: np.ndarray):
        self.items, self.terms = items, terms
        self.vectors = (vectors * weight[:, None]).astype(np.float32)
        own = _items_in(terms, items)
        cells, placed = (np.concatenate(c) for c in zip(*self.placed(own, 4096), strict=True))
        self.probes, self.probe_item = placed, own.text[cells]
        self.sizes = np.array([len(i.words) for i in items])
        self.reach = -(-self.sizes // Cells.HALF)
        #: The numbers of the words of items of up to FAR cells, filled up with one that no text has.
        self.item_words = np.full((len(items), FAR * Cells.HALF), len(terms))
        for words, item in zip(self.item_words, items, strict=True):
            if len(item.words) <= len(words):
                words[: len(item.words)] = [terms[w] for w in item.words]

    def placed(self, c: Cells, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(cells that begin a passage, the passages' unit vectors) of `rows` cells at a time; passages without terms are left out."""
        begins, following = c.begins_passage(), np.append(c.text, -1)
        for low in range(0, c.n, rows):
            high = min(low + rows, c.n)
            sums = self._sums(c, low, high + 1)
            goes_on = following[low + 1 : high + 1] == c.text[low:high]
            both = sums[:-1] + np.where(goes_on[:, None], sums[1:], np.float32(0))
            norm = np.sqrt(np.einsum("ij,ij->i", both, both))
            some = np.flatnonzero(begins[low:high] & (norm > 1e-6))
            yield low + some, both[some] / norm[some, None]

    def _sums(self, c: Cells, low: int, high: int) -> np.ndarray:
        """The sums of the term vectors of the cells low..high - 1; zeros for one that is not there."""
        out = np.zeros((high - low, self.vectors.shape[1]), np.float32)
        bounds = np.searchsorted(c.cell, np.arange(low, high + 1))
        sizes = np.diff(bounds)
        order = np.argsort(-sizes, kind="stable")  # cells with most pairs first: the k-th terms of all cells that have one are added at once
        order = order[: np.count_nonzero(sizes)]
        for begin in range(0, len(order), ROWS):
            some = order[begin : begin + ROWS]
            starts, rest = bounds[some], sizes[some]
            sums = self.vectors[c.term[starts]]
            for k in range(1, int(rest[0])):
                n = int(np.count_nonzero(rest > k))
                sums[:n] += self.vectors[c.term[starts[:n] + k]]
            out[some] = sums
        return out

    def _candidates(self, c: Cells, cells: np.ndarray, placed: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(cell, item, highest cosine of its passages) of the items that are near, if enough of their words may be around the cell."""
        cosines = placed @ self.probes.T
        row, probe = np.nonzero(cosines >= COSINE)
        keys = row * len(self.items) + self.probe_item[probe]  # rising, as an item's probes lie side by side
        if not len(keys):
            return
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        best = np.maximum.reduceat(cosines[row, probe], first)
        row, item = np.divmod(keys[first], len(self.items))
        cell, span = cells[row], max(64, BITS // len(self.terms))
        for begin in range(int(cell[0]), int(cell[-1]) + 1, span):
            some = slice(*np.searchsorted(cell, [begin, begin + span]))
            held = np.flatnonzero(self._around(c, cell[some], item[some])) + some.start
            yield from zip(cell[held].tolist(), item[held].tolist(), best[held].tolist(), strict=True)

    def _around(self, c: Cells, cell: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether PARAPHRASE of an item's words may be in the words around a cell (sorted), by the whole cells that these are in.

        No pair that has them is lost; items of over FAR cells are not looked at.
        """
        reach = self.reach[item]
        out = reach > FAR
        if out.all():
            return out
        most, span = int(reach[~out].max()), int(cell[-1] - cell[0]) + 1
        low = int(cell[0]) - most
        there = np.zeros((span + 2 * most + 1, len(self.terms) + 1), bool)
        own = slice(*np.searchsorted(c.cell, [low, low + len(there)]))
        there[c.cell[own] - low, c.term[own]] = True
        there = np.packbits(there, axis=1)
        around = there[most : most + span]
        for far in range(most + 1):
            around = around | there[most - far : most - far + span] | there[most + 1 + far : most + 1 + far + span]
            of_reach = np.flatnonzero(reach == far)
            for begin in range(0, len(of_reach), ROWS * 8):
                some = of_reach[begin : begin + ROWS * 8]
                words = self.item_words[item[some], : far * c.HALF]
                bits = around[(cell[some] - cell[0])[:, None], words >> 3] >> (7 - (words & 7)).astype(np.uint8) & 1
                out[some] = bits.sum(axis=1) >= PARAPHRASE * self.sizes[item[some]]
        return out

    def matches(self, texts: list[str]) -> list[list[tuple[int | None, int, float, float, bool]]]:
        """Per text: (item_id, first word, cosine, covered share, answer found) of each item that it holds."""
        c = Cells(numbers_of(texts, self.terms), len(self.terms))
        best: list[dict[int, tuple]] = [{} for _ in texts]
        words: dict[int, list[bytes]] = {}
        for cells, placed in self.placed(c, max(64, min(4096, COSINES // max(len(self.probes), 1)))):
            for at, i, cosine in self._candidates(c, cells, placed):
                item, text, first = self.items[i], int(c.text[at]), int(c.first_word(at))
                if text not in words:
                    words[text] = words_of(texts[text])
                near = words[text][max(0, first - len(item.words)) : first + PASSAGE + len(item.words)]
                there = set(near)
                if sum(map(there.__contains__, item.words)) < PARAPHRASE * len(item.words):
                    continue  # no subsequence is longer than the words that are there
                share = common_length(item.words, near) / len(item.words)
                if share < PARAPHRASE:
                    continue
                answered = bool(item.answer) and common_length(item.answer, near) >= ANSWER * len(item.answer)
                if share >= VERBATIM or answered:
                    row = (share, cosine, -first, answered)
                    best[text][i] = max(best[text].get(i, row), row)
        return [
            [(self.items[i].item_id, -first, cos, share, answered) for i, (share, cos, first, answered) in sorted(own.items())]
            for own in best
        ]


def _term_counts(texts: DataFrame, terms: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many cells each term is, and how many cells there are. One row per term comes to the driver."""
    shared = texts.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = np.zeros(len(shared.value), np.int64), 0
        for batch in batches:
            for piece in slices(batch, most=_SLICE):
                c = Cells(numbers_of(piece.column("text").to_pylist(), shared.value), len(found))
                found += np.bincount(c.term, minlength=len(found))
                total += c.n
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"term": np.r_[-1, some].astype(np.int32), "n": np.r_[total, found[some]]})

    rows = texts.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(len(terms), np.int64), 0
    for r in rows:
        if r["term"] < 0:
            total = r["n"]
        else:
            out[r["term"]] = r["n"]
    return out, total


def weights(found: np.ndarray, total: int) -> np.ndarray:
    """Inverse cell frequencies of the benchmark's terms."""
    return np.log((total + 1) / (found + 1)) + 1


class Products:
    """Sums of A'A over passages, rows of A at unit length: how much each two terms share passages. `sketch` makes A'(A omega) of them.

    Each cell's own pairs of terms count for both passages that it is in, so a passage costs its pairs of terms, not terms times columns.
    Pairs of the `DENSE` most frequent terms are summed in one array, others in a list that is folded whenever it reaches `PAIRS`.
    """

    def __init__(self, weight: np.ndarray, found: np.ndarray, omega: np.ndarray):
        self.weight, self.omega, self.passages = weight, omega * weight[:, None], 0
        self.order = np.argsort(-found, kind="stable")  # frequent terms side by side
        self.place = np.empty(len(weight), np.int64)
        self.place[self.order] = np.arange(len(weight))
        self.dense = min(DENSE, len(weight))
        self.sums = np.zeros(self.dense * (self.dense + 1) // 2)  # row i holds its pairs with terms 0..i
        self.rare: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0
        self.rest = np.zeros(omega.shape)

    def add(self, c: Cells) -> None:
        begins = c.begins_passage()
        goes_on = np.append(c.text[1:] == c.text[:-1], False) if c.n else begins
        self.passages += int(np.count_nonzero(begins))
        if not len(c.cell):
            return
        squares = self.weight[c.term] ** 2
        own = np.bincount(c.cell, squares, c.n)
        length = own + np.where(goes_on, np.append(own[1:], 0), 0)
        keys = c.cell * len(self.weight) + c.term
        following = np.minimum(np.searchsorted(keys, keys + len(self.weight)), len(keys) - 1)
        twin = keys[following] == keys + len(self.weight)  # a term in both cells of a passage has twice its weight there
        length += np.where(goes_on, np.bincount(c.cell, 2 * squares * twin, c.n), 0)
        share = np.where(begins & (length > 0), 1 / np.where(length > 0, length, 1), 0)
        across = np.where(goes_on, share, 0)
        within = share + np.append(0, across[:-1])
        place = self.place[c.term]
        for begin in range(0, len(place), PAIRS // 16):
            self._pairs(c.cell[begin:], place[begin:], within, across, min(PAIRS // 16, len(place) - begin))

    def _pairs(self, cell: np.ndarray, place: np.ndarray, within: np.ndarray, across: np.ndarray, n: int) -> None:
        """The pairs of the first `n` terms with themselves and with those after them in the same cell and the next one."""
        self._sum(place[:n], place[:n], within[cell[:n]] / 2)
        for ahead in range(1, len(place)):
            m = min(n, len(place) - ahead)
            gap = cell[ahead : ahead + m] - cell[:m]
            near = np.flatnonzero(gap <= 1)
            if not len(near):
                break
            at = cell[near]
            self._sum(place[near], place[near + ahead], np.where(gap[near] == 0, within[at], across[at]))

    def _sum(self, one: np.ndarray, two: np.ndarray, values: np.ndarray) -> None:
        if self.dense < len(self.weight):
            often = np.maximum(one, two) < self.dense
            rare = np.flatnonzero(~often)
            self.rare.append((one[rare] * len(self.weight) + two[rare], values[rare]))
            self.held += len(rare)
            if self.held > PAIRS:
                self._fold()
            one, two, values = one[often], two[often], values[often]
        one, two = np.maximum(one, two), np.minimum(one, two)
        np.add.at(self.sums, one * (one + 1) // 2 + two, values)

    def _fold(self) -> None:
        keys, which = np.unique(np.concatenate([k for k, _ in self.rare]), return_inverse=True)
        values = np.bincount(which, np.concatenate([v for _, v in self.rare]), len(keys))
        self.rare, self.held = [], 0
        pair = np.stack([self.order[p] for p in np.divmod(keys, len(self.weight))])
        for one, two in (pair, pair[::-1]):
            order = np.argsort(one, kind="stable")
            for some in np.split(order, range(ROWS * 8, len(order), ROWS * 8)):
                if len(some):
                    first = np.flatnonzero(np.append(True, np.diff(one[some]) > 0))
                    self.rest[one[some][first]] += np.add.reduceat(self.omega[two[some]] * values[some, None], first, axis=0)

    def sketch(self) -> np.ndarray:
        """A'(A omega) of what was added."""
        if self.held:
            self._fold()
        often = self.order[: self.dense]
        out, omega, sums = self.rest.copy(), self.omega[often], np.zeros((self.dense, self.omega.shape[1]))
        for low in range(0, self.dense, 256):
            high = min(low + 256, self.dense)
            half = np.zeros((high - low, high))
            for i in range(low, high):
                half[i - low, : i + 1] = self.sums[i * (i + 1) // 2 : (i + 1) * (i + 2) // 2]
            sums[low:high] += half @ omega[:high]
            sums[:high] += half.T @ omega[low:high]
        out[often] += sums
        return out * self.weight[:, None]


def _once(texts: DataFrame) -> DataFrame:
    """All texts; of rows alike in id and text one. Only texts of repeated rows are shuffled, folded map-side first."""
    rows = texts.select(F.coalesce("doc_id", F.lit(-1)).alias("i"), F.xxhash64("text").alias("h"), "text")
    copies = rows.groupBy("i", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = broadcast_if_small(copies.select(F.col("i").alias("_i"), F.col("h").alias("_h")))
    same = (F.col("i") == F.col("_i")) & (F.col("h") == F.col("_h"))
    again = rows.join(copies, same, "left_semi").groupBy("i", "h").agg(F.first("text").alias("text"))
    return rows.join(copies, same, "left_anti").select("text").unionByName(again.select("text"))


def fit(texts: DataFrame, items: list[Item]) -> Space | None:
    """Weights from all cells of `texts` (doc_id, text), singular vectors from all their passages and the items. None if the items have no words."""
    items = [i for i in items if i.words]
    terms = {w: n for n, w in enumerate(sorted({w for i in items for w in i.words}))}
    if not terms:
        return None
    found, total = _term_counts(texts, terms)
    weight = weights(found, total)
    columns = min(RANK + EXTRA, len(terms))
    omega = np.random.default_rng(_SEED).standard_normal((len(terms), columns)).astype(np.float32)
    shared = texts.sparkSession.sparkContext.broadcast((terms, weight, found, omega))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight_of, often, random = shared.value
        products = Products(weight_of, often, random)
        for batch in batches:
            for piece in slices(batch, most=_SLICE):
                products.add(Cells(numbers_of(piece.column("text").to_pylist(), known), len(known)))
        z, passages = products.sketch(), products.passages
        some = np.flatnonzero(z.any(axis=1))
        # a row of Z in pieces of COLUMNS numbers, so that the sums stay narrow; row -1 counts passages
        names = ["term", "part", *(f"z{i}" for i in range(COLUMNS))]
        for part in range(0, random.shape[1], COLUMNS):
            values = np.zeros((len(some) + 1, COLUMNS))
            values[1:, : random.shape[1] - part] = z[some, part : part + COLUMNS]
            values[0, 0] = passages
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[-1, some].astype(np.int32)), pa.array(np.full(len(values), part, np.int32)), *(pa.array(c) for c in values.T)], names
            )

    names = [f"z{i}" for i in range(COLUMNS)]
    parts = _once(texts).mapInArrow(sketch, ", ".join(["term int", "part int", *(f"{n} double" for n in names)]))
    z, passages = np.zeros((len(terms), columns + COLUMNS)), 0
    for r in parts.groupBy("term", "part").agg(*[F.sum(n).alias(n) for n in names]).toLocalIterator():  # the size of Z, whatever the input
        if r["term"] < 0:
            passages = r["z0"]
        else:
            z[r["term"], r["part"] : r["part"] + COLUMNS] = r[2:]
    z = z[:, :columns]
    ours = Products(weight, found, omega)
    ours.add(_items_in(terms, items))
    z += ours.sketch() * max(passages, ours.passages) / max(ours.passages, 1)
    return Space(items, terms, weight, singular_vectors(z, omega.astype(float)))


def singular_vectors(z: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """The top right singular vectors of A from Z = A'A omega: A'A is close to Z (omega' Z)^-1 Z'."""
    z = z + 1e-8 * np.linalg.norm(z) * omega  # a small shift keeps the inner matrix positive
    inner = omega.T @ z
    values, basis = np.linalg.eigh((inner + inner.T) / 2)
    good = values > 1e-12 * values.max()
    return np.linalg.svd(z @ (basis[:, good] / np.sqrt(values[good])), full_matrices=False)[0][:, :RANK]


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[Item]]:
    """The benchmark in blocks. It is the query set: read in order, WORDS words at a time and one item at least."""
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None)
    rows = benchmark.select(
        F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), answer.cast("string").alias("a")
    )
    block: list[Item] = []
    size = 0
    for r in rows.toLocalIterator():
        item = Item.of(r["i"], r["t"], r["a"])
        if block and size + len(item.words) > WORDS:
            yield block
            block, size = [], 0
        block.append(item)
        size += len(item.words)
    if block:
        yield block


_SCHEMA = "doc_id long, item_id long, first_word int, cosine double, covered double, answered boolean"


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, first_word, cosine, covered, answered: each item that a document holds."""
    texts = id_and_text(docs, id_col, text_col)
    spark = docs.sparkSession
    out = spark.createDataFrame([], _SCHEMA)
    for block in items_of(benchmark):
        space = fit(texts, block)
        if space is not None:
            out = out.unionByName(texts.mapInArrow(per_slice(_search(spark.sparkContext.broadcast(space)), _SLICE), _SCHEMA))
    return out


def _search(space):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = space.value.matches(batch.column("text").to_pylist())
        at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
        rows = [r for own in found for r in own]
        kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.bool_())
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(at), *columns], ["doc_id", "item_id", "first_word", "cosine", "covered", "answered"]
        )

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows, all columns, that hold no benchmark item. No shuffle of texts: the check runs beside the scan."""
    texts = id_and_text(docs, id_col, text_col)
    for block in items_of(benchmark):
        space = fit(texts, block)
        if space is not None:
            docs = docs.filter(_holds_none(docs.sparkSession.sparkContext.broadcast(space))(F.col(text_col)))
    return docs


def _holds_none(space):
    @F.arrow_udf("boolean")
    def run(texts: pa.Array) -> pa.Array:
        out: list[bool] = []
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        for piece in slices(batch, most=_SLICE):
            found = space.value.matches([t or "" for t in piece.column("text").to_pylist()])
            out += [not f for f in found]
        return pa.array(out, pa.bool_())

    return run
