"""Byte-level BPE encoding and decoding by merge replay over a corpus block.

A task takes a block of its documents, splits the texts by the tokenizer's pattern, and keeps each distinct piece
once. All pieces of the block lie behind one another as byte symbols, linked to their neighbours. An inverted
index holds, for each merge rank, the positions whose pair of symbols makes that token. Ranks are taken off in
order: one step applies a merge at all its positions in the block and then looks up only the pairs to the left
and right of those. Pieces never merge across their edges, so blocks are independent and no shuffle is needed.

A merge that makes a pair of a lower rank than its own (possible only in rank files that no training made)
would come too late in this order; such pieces are encoded again one merge at a time.

Defined cases: a null or empty text has no ids and decodes to no bytes; an id that the file lacks is an error in
decoding; null ids decode to no bytes; repeated rows and rows with a null id are encoded like any other; very long texts are
taken in one slice each; only the named columns are read, whatever others are called; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections import defaultdict
from collections.abc import Sequence
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import id_and_text, per_slice

#: Text bytes of one block; its distinct pieces and their index live in one task.
BLOCK_BYTES = 5 << 20
_NONE = np.iinfo(np.int32).max
#: White space before a space: only there may a piece of the pattern reach across the start of a space.
_SPACES = regex.compile(r"\s ")


class Ranks:
    """Token bytes by id, and the id that each pair of ids merges to."""

    def __init__(self, content: bytes):
        self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.bytes = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            (self.ids[t[:k]] << 32 | self.ids[t[k:]], i)
            for t, i in self.ids.items()
            for k in range(1, len(t))
            if t[:k] in self.ids and t[k:] in self.ids
        ]
        pairs.sort()
        self._pairs = np.array([p for p, _ in pairs] or [-1], np.int64)
        self._made = np.array([m for _, m in pairs] or [_NONE], np.int32)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair makes, _NONE where it makes no token."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where(self._pairs[at] == key, self._made[at], _NONE)

    def one_by_one(self, piece: bytes) -> list[int]:
        """The ids of a piece, the lowest and leftmost merge first."""
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            rank, at = min((self.ids.get(parts[i] + parts[i + 1], _NONE), i) for i in range(len(parts) - 1))
            if rank == _NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]


@lru_cache(maxsize=2)
def _ranks(content: bytes) -> Ranks:
    return Ranks(content)


@lru_cache(maxsize=4)
def _pattern(text: str) -> regex.Pattern:
    return regex.compile(text)


def replay(pieces: Sequence[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the pieces behind one another, and the n + 1 offsets of the pieces."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(ends) else 0
    if not n:
        return np.empty(0, np.int32), np.zeros(len(pieces) + 1, np.int64)
    symbol = ranks.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
    right = np.arange(1, n + 1, dtype=np.int32)
    right[ends[lengths > 0] - 1] = -1
    left = np.arange(-1, n - 1, dtype=np.int32)
    left[(ends - lengths)[lengths > 0]] = -1
    alive = np.ones(n, bool)
    rank = np.full(n, _NONE, np.int32)  # of the pair that starts here
    odd: list[np.ndarray] = []
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def enter(at: np.ndarray, after: int) -> None:
        """Look up the pairs at these positions and put them into the index."""
        at = at[(right[at] >= 0) & alive[at]]
        made = ranks.merged(symbol[at], symbol[right[at]])
        rank[at] = made
        at, made = at[made != _NONE], made[made != _NONE]
        if (early := made < after).any():
            odd.append(owner[at[early]])
        order = np.argsort(made, kind="stable")
        at, made = at[order], made[order]
        starts = np.flatnonzero(np.r_[True, made[1:] != made[:-1]]) if len(made) else []
        for i, start in enumerate(starts):
            r = int(made[start])
            if r not in index:
                index[r] = []
                heapq.heappush(queue, r)
            index[r].append(at[start : starts[i + 1] if i + 1 < len(starts) else None])

    enter(np.arange(n, dtype=np.int32), -1)
    while queue:
        r = heapq.heappop(queue)
        at = np.concatenate(index.pop(r))
        at = np.sort(at[alive[at] & (rank[at] == r)])
        if not len(at):
            continue
        # where occurrences overlap (a a a), every second one counts from the left
        follows = np.r_[False, right[at[:-1]] == at[1:]]
        if follows.any():
            places = np.arange(len(at))
            at = at[(places - np.maximum.accumulate(np.where(follows, 0, places))) % 2 == 0]
        gone = right[at]
        symbol[at] = r
        alive[gone] = False
        beyond = right[gone]
        right[at] = beyond
        has = beyond >= 0
        left[beyond[has]] = at[has]
        rank[at] = _NONE
        before = left[at]
        before = before[before >= 0]
        enter(np.concatenate([at, before[symbol[before] != r]]) if len(before) else at, r)
    ids, sizes = symbol[alive], np.bincount(owner[alive], minlength=len(pieces))
    again = {int(p): ranks.one_by_one(pieces[p]) for p in (np.unique(np.concatenate(odd)) if odd else ())}
    # a piece that is itself a token is that token, also if no merges lead to it
    again |= {p: [i] for p in np.flatnonzero(sizes > 1).tolist() if (i := ranks.ids.get(pieces[p])) is not None}
    if again:
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for p, own in again.items():
            parts[p] = np.array(own, np.int32)
        ids, sizes = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    return ids, np.r_[0, np.cumsum(sizes)]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each range behind one another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _numbered() -> defaultdict:
    """Keys numbered from 0 in the order they are first asked for."""
    return defaultdict(count().__next__)


def encode_texts(texts: Sequence[str], ranks: Ranks, pattern: regex.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts behind one another, and the n + 1 offsets of the texts.

    A text is first cut before its spaces: a space after anything but white space always begins a piece, so the
    pattern need only split the distinct chunks. Texts with white space before a space are split whole.
    """
    heads, known = _numbered(), _numbered()  # chunks at the start of a text, and those after a space
    used = []
    for text in texts:
        if _SPACES.search(text):
            used.append(np.array([heads[text]], np.int32))
            continue
        first, *rest = text.split(" ")
        numbers = np.fromiter(map(known.__getitem__, rest), np.int32, len(rest))
        used.append(np.r_[np.int32(heads[first]), -1 - numbers])
    # chunks -> distinct pieces -> ids
    pieces = _numbered()
    of_chunks, counts = array("i"), array("i")
    for chunk in chain(heads, (" " + c for c in known)):
        own = pattern.findall(chunk)
        counts.append(len(own))
        of_chunks.extend(map(pieces.__getitem__, own))
    ids, offsets = replay([p.encode() for p in pieces], ranks)
    of_chunks, inside = np.array(of_chunks, np.int32), np.r_[0, np.cumsum(np.array(counts, np.int64))]
    flat = np.concatenate(used) if used else np.empty(0, np.int32)
    flat = np.where(flat < 0, len(heads) - 1 - flat, flat)
    piece = of_chunks[_ranges(inside[:-1][flat], np.diff(inside)[flat])]
    sizes = np.diff(offsets)
    upto = np.r_[0, np.cumsum(np.add.reduceat(np.r_[sizes[of_chunks], 0], inside[:-1])[flat] * (np.diff(inside)[flat] > 0))] if len(flat) else [0]
    return ids[_ranges(offsets[:-1][piece], sizes[piece])], upto[np.r_[0, np.cumsum([len(u) for u in used])]].astype(np.int64)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row. The rank file is read by the driver and sent along: its size is the vocabulary's."""
    with open(ranks_path, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, offsets = encode_texts(batch.column("text").to_pylist(), _ranks(content.value), _pattern(pattern))
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(per_slice(block, BLOCK_BYTES), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """The rows with the bytes that their ids stand for."""
    with open(ranks_path, "rb") as file:
        content = encoded.sparkSession.sparkContext.broadcast(file.read())

    @F.arrow_udf("binary")
    def texts(ids: pa.Array) -> pa.Array:
        token = _ranks(content.value).tokens.__getitem__
        return pa.array([b"".join(map(token, x.values.to_numpy())) if x.is_valid else b"" for x in ids], pa.binary())

    return encoded.withColumn(name, texts(F.col(ids_col)))
