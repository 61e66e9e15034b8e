"""Periodic runs of words: a suffix automaton whose link tree is walked with link-cut access.

The words of a text are appended one by one. Appending word i makes all suffixes of the prefix that ends there end at i; in
the automaton's tree of suffix links they are the path from the prefix's state to the root. The tree is kept in paths of one
colour, the place where the strings of a path last ended (splay trees, link-cut `access`). Walking up, each path that is met
gives its colour e and the length L of its longest string on the way: that string ends at e and at i. If d = i - e <= L, the two
overlap or touch, so the L + d words up to i have period d: a square, and d is their smallest period, else the string would have ended
later than e. Then the whole way takes colour i. The walks recolour O(n log n) paths in all. At the last word of a run, its longest
suffix that also ends one period earlier reaches back to the run's start, so the longest such stretch of each (start, period) is the
maximal run. Runs of `LEAST` words and `TIMES` periods are kept.

Most words cannot be in a run, and the automaton is spared them without loss. The last word of each run, and all words of it but its
first q + GRAM - 1, end a run of GRAM words that also ended q words earlier. So only stretches of words are walked where GRAM-grams
recur within a third of the stretch (plus GRAM - 1 words), together with the words before them that a run could begin with. Equal
words have equal hashes, so a chance collision widens a stretch and changes nothing.

Texts are worked on one by one beside the scan, in slices of bounded size: nothing is shuffled and no text waits for another. The
automaton of one text's stretch is held in one task; it takes a few hundred bytes a word of the stretch.

Defined cases: words are the runs of bytes outside [\\x20\\x09-\\x0D]; a null or empty text has no words and no runs; a null id is kept (and
gets no planted repeat, see `planted`); repeated rows are answered each; of runs of equal length the smaller start, then the smaller
period is the longest; columns other than id and text are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelmill.llm.common import id_and_text, per_slice

#: Least words and least periods of a run; words of the grams that tell where a run can be (fewer than LEAST).
LEAST, TIMES, GRAM = 6, 4, 5
_SLICE = 4 << 20


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the repeat that the id's checksum plants: from word a on, the p words there over and over."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The state of each prefix, and each state's link and length, of the suffix automaton of the words."""
    edges: list[dict[int, int]] = [{}]
    link, length, prefix = [-1], [0], []
    last = 0
    for i, w in enumerate(words):
        new = len(link)
        edges.append({})
        length.append(i + 1)
        link.append(0)
        at = last
        while at >= 0 and w not in edges[at]:
            edges[at][w] = new
            at = link[at]
        if at >= 0:
            to = edges[at][w]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(link)
                edges.append(dict(edges[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                link[to] = link[new] = copy
                while at >= 0 and edges[at].get(w) == to:
                    edges[at][w] = copy
                    at = link[at]
        prefix.append(new)
        last = new
    return prefix, link, length


def squares(words: list[int]):
    """(end, distance, length) of each path met: `length` words up to `end` also end `distance` words earlier, and not in between.

    Nodes of the link tree are held in splay trees, one for each path of a colour, ordered by depth. `up` is the parent in the splay
    tree or, at its root, the node above the path; the root alone knows the colour.
    """
    prefix, link, length = automaton(words)
    up = [0 if at <= 0 else at for at in link]  # state 0, the empty string, stands for none
    low, high = [0] * len(up), [0] * len(up)  # children: towards the root of the tree, away from it
    colour = [-1] * len(up)
    for i, state in enumerate(prefix):
        x, below = state, 0
        while x:
            root, p = x, up[x]
            while p and (low[p] == root or high[p] == root):
                root, p = p, up[p]
            e = colour[root]
            while x != root:  # rotations bring x to the root
                p = up[x]
                if p == root:
                    turns, root = (x,), x
                else:
                    g = up[p]
                    turns = (p, x) if (low[g] == p) == (low[p] == x) else (x, x)
                    if g == root:
                        root = x
                for y in turns:
                    z = up[y]
                    above = up[z]
                    if low[z] == y:
                        c = low[z] = high[y]
                        high[y] = z
                    else:
                        c = high[z] = low[y]
                        low[y] = z
                    if c:
                        up[c] = z
                    up[z], up[y] = y, above
                    if above:
                        if low[above] == z:
                            low[above] = y
                        elif high[above] == z:
                            high[above] = y
            if e >= 0:
                yield i, i - e, length[x]
            if high[x]:
                colour[high[x]] = e
            high[x] = below
            below, x = x, up[x]
        if below:
            colour[below] = i


def runs_of(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a stretch, by start and period."""
    ends: dict[tuple[int, int], int] = {}
    for i, distance, length in squares(words):
        whole = length + distance
        if whole >= TIMES * distance and whole >= LEAST:
            ends[i - whole + 1, distance] = i
    return [(start, end - start + 1, period) for (start, period), end in sorted(ends.items())]


def _mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ a >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    return a ^ a >> np.uint64(29)


def stretches(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Per text, (begin, first, last): runs end in the words first..last, and none of these runs begins before `begin`."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    words = np.fromiter((hash(w) for t in texts for w in t), np.int64, int(sizes.sum())).view(np.uint64)
    if len(words) < LEAST:
        return out
    text = np.repeat(np.arange(len(texts)), sizes)
    grams = words[GRAM - 1 :].copy()
    for back in range(1, GRAM):
        grams = _mixed(grams) + words[GRAM - 1 - back : len(words) - back]
    at = np.arange(GRAM - 1, len(words))
    inside = at - starts[text[at]] >= GRAM - 1
    at, grams = at[inside], _mixed(grams[inside]) + text[at[inside]].astype(np.uint64)
    order = np.argsort(grams, kind="stable")
    again = np.flatnonzero(grams[order][1:] == grams[order][:-1])
    here, gap = at[order][again + 1], at[order][again + 1] - at[order][again]
    same = text[here] == text[here - gap]
    here, gap = here[same], gap[same]
    by_place = np.argsort(here)
    here, gap = here[by_place], gap[by_place]
    while len(here):
        first = np.append(True, (here[1:] != here[:-1] + 1) | (text[here[1:]] != text[here[:-1]]))
        number = np.cumsum(first) - 1
        reach = (np.bincount(number) + GRAM - 1) // (TIMES - 1)
        stay = gap <= reach[number]
        if stay.all():
            begins = np.flatnonzero(first)
            for b, e, r in zip(here[begins].tolist(), here[np.append(begins[1:], len(here)) - 1].tolist(), reach.tolist(), strict=True):
                t = int(text[b])
                s = int(starts[t])
                out[t].append((max(0, b - s - (GRAM - 1) - r), b - s, e - s))
            break
        here, gap = here[stay], gap[stay]
    return out


def runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Per text, (start, length, period) of every run, by start and period."""
    out = []
    for words, places in zip(texts, stretches(texts), strict=True):
        known: dict[bytes, int] = {}
        found = []
        for begin, first, last in places:
            numbers = [known.setdefault(w, len(known)) for w in words[begin : last + 1]]
            # runs that end before `first` belong to another stretch, which sees all of them
            found += [(begin + s, n, q) for s, n, q in runs_of(numbers) if begin + s + n - 1 >= first]
        out.append(sorted(found, key=lambda r: (r[0], r[2])))
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats: of each run its first period stays, unless another run repeats that."""
    if not found:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
    "runs array<struct<start: long, length: long, period: long>>"
)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """One row for each document: its runs, the longest of them, and digests of the runs and of the words that stay.

    With `plant`, the words are those of `planted`.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("doc_id").to_pylist()
        texts = [t.encode().split() for t in batch.column("text").to_pylist()]
        if plant:
            texts = [planted(i, t) for i, t in zip(ids, texts, strict=True)]
        columns: dict[str, list] = {n: [] for n in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs")}
        for words, found in zip(texts, runs(texts), strict=True):
            start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
            listed = "".join(f"{a},{b},{c}\n" for a, b, c in found)
            values = (
                len(found), start, length, period, 1000 * length // period if found else None,
                hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest(),
                [{"start": a, "length": b, "period": c} for a, b, c in found],
            )
            for column, value in zip(columns.values(), values, strict=True):
                column.append(value)
        run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [run]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns.values(), kinds, strict=True))], ["doc_id", *columns]
        )

    return id_and_text(docs, id_col, text_col).mapInArrow(per_slice(work, _SLICE), SCHEMA)
