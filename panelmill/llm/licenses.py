"""Licence scan: TF-IDF cosine of text segments to licence templates, then inheritance along directories.

Segments of a document are its lines, the sentences of its lines, runs of consecutive sentences and lines (so that a notice may be
wrapped) of up to `RUN` words, and the whole text, which is compared with the full licence texts as well. Vectors hold the templates' terms,
weighted by inverse document frequency over all documents; a word that no template has counts in the length of a
segment's vector like a term of no document. A segment whose cosine with a template is at least `SIMILAR` states that
licence. Only segments that hold a marker word are compared: the markers of a template are its rarest words, so many that
the others alone could not reach `SIMILAR`.

A document that is a licence file (`FILE` of its words lie in such segments) licenses its directory; so do headers where all licensed
documents of a directory state one and the same licence. A document without a licence of its own takes that of the
nearest licensed directory at or above its own, found by joining the directories' ancestor paths.

Defined cases: a null or empty text states nothing; a null path is a directory of its own at the top, which
neither gives nor takes; among equal cosines the first licence in order counts; repeated rows are scanned alike;
very long texts are scanned whole, segment by segment; only the named columns are read, whatever others are called; an empty table
gives an empty result. The full texts cover six of the nine licences: those of the CC and proprietary kinds are told by their notices alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import per_slice, slices, staged

#: Least cosine of a segment, and share of a document's words that makes it a licence file.
SIMILAR, FILE = 0.8, 0.5
_SLICE = 8 << 20
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")

# The texts that state a licence.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved."),
}


#: Full licence texts, which a licence file holds.
FULL = {f.stem: f.read_text() for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


_TERMS = {w: i for i, w in enumerate(sorted({w for texts in (*TEMPLATES.values(), FULL.values()) for t in texts for w in words_of(t)}))}
#: Words of a run of sentences and lines: twice the longest notice.
RUN = 2 * max(len(words_of(t)) for texts in TEMPLATES.values() for t in texts)


@dataclass(frozen=True)
class Stated:
    licence: str
    similarity: float


class Scanner:
    """Templates as weighted vectors of unit length, and their markers."""

    def __init__(self, weights: np.ndarray, strange: float):
        self._strange = strange
        self._weights = {w: float(weights[i]) for w, i in _TERMS.items()}
        self._templates: list[tuple[str, dict[str, float]]] = []
        markers: set[str] = set()
        for licence, texts in sorted(TEMPLATES.items()):
            for text in texts:
                vector, length = self._vector(words_of(text))
                unit = {w: v / length for w, v in vector.items()}
                self._templates.append((licence, unit))
                rest = 1.0
                for w in sorted(unit, key=lambda w: (-self._weights[w], w)):
                    if rest < SIMILAR**2 - 1e-9:
                        break
                    markers.add(w)
                    rest -= unit[w] ** 2
        self._markers = frozenset(markers)
        self._full: list[tuple[str, dict[str, float]]] = []
        for licence, text in sorted(FULL.items()):
            vector, length = self._vector(words_of(text))
            self._full.append((licence, {w: v / length for w, v in vector.items()}))

    def _vector(self, words: list[str]) -> tuple[dict[str, float], float]:
        counts = Counter(words)
        known = {w: n * self._weights[w] for w, n in counts.items() if w in self._weights}
        others = sum((n * self._strange) ** 2 for w, n in counts.items() if w not in self._weights)
        return known, (sum(v * v for v in known.values()) + others) ** 0.5

    def file(self, words: list[str]) -> Stated | None:
        """The licence whose full text these words are."""
        vector, length = self._vector(words)
        if not vector:
            return None
        scores = [(sum(v * unit.get(w, 0.0) for w, v in vector.items()) / length, licence) for licence, unit in self._full]
        top = max(s for s, _ in scores)
        return Stated(min(name for s, name in scores if s == top), min(top, 1.0)) if top >= SIMILAR else None

    def best(self, words: list[str]) -> Stated | None:
        if self._markers.isdisjoint(words):
            return None
        vector, length = self._vector(words)
        scores = [(sum(v * unit.get(w, 0.0) for w, v in vector.items()) / length, licence) for licence, unit in self._templates]
        top = max(s for s, _ in scores)
        return Stated(min(name for s, name in scores if s == top), min(top, 1.0)) if top >= SIMILAR else None

    def scan(self, text: str) -> tuple[Stated | None, bool]:
        """The licence that a text states best, and whether it is a licence file."""
        every = words_of(text)
        if full := self.file(every):
            return full, True
        if self._markers.isdisjoint(every):
            return None, False
        found: list[Stated] = []
        units: list[list[str]] = []
        states: list[bool] = []  # of each unit, whether it lies in a segment that states a licence
        for line in text.split("\n"):
            own = [w for w in map(words_of, _SENTENCE.split(line)) if w]
            stated = self.best([w for words in own for w in words])
            if stated:
                found.append(stated)
            units += own
            states += [stated is not None] * len(own)
        marked = [not self._markers.isdisjoint(u) for u in units]
        for i in range(len(units)):
            run: list[str] = []
            any_marked = False
            for j in range(i, len(units)):
                run = run + units[j]
                if j > i and len(run) > RUN:
                    break
                any_marked |= marked[j]
                if any_marked and (stated := self.best(run)):
                    found.append(stated)
                    states[i : j + 1] = [True] * (j + 1 - i)
        if whole := self.best(every):
            return whole, True
        if not found:
            return None, False
        top = min(found, key=lambda s: (-s.similarity, s.licence))
        return top, sum(len(u) for u, s in zip(units, states, strict=True) if s) >= FILE * len(every)


def fit(texts: DataFrame) -> Scanner:
    """Term weights from all documents; one row per template term comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = np.zeros(len(_TERMS), np.int64), 0
        for batch in batches:
            for piece in slices(batch, most=_SLICE):
                for text in piece.column("text").to_pylist():
                    total += 1
                    found[[_TERMS[w] for w in _TERMS.keys() & set(words_of(text))]] += 1
        yield pa.RecordBatch.from_pydict({"term": np.arange(-1, len(found), dtype=np.int32), "n": np.r_[total, found]})

    rows = {r["term"]: r["n"] for r in texts.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    total = rows.get(-1, 0)
    found = np.array([rows.get(i, 0) for i in range(len(_TERMS))], float)
    return Scanner(np.log((total + 1) / (found + 1)) + 1, float(np.log(total + 1) + 1))


def stated(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, path, own (licence), similarity and is_file of every row."""
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), path.cast("string").alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    scanner = docs.sparkSession.sparkContext.broadcast(fit(texts))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [scanner.value.scan(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("path"), pa.array([s and s.licence for s, _ in found], pa.string()),
             pa.array([s and s.similarity for s, _ in found], pa.float64()), pa.array([f for _, f in found], pa.bool_())],
            ["doc_id", "path", "own", "similarity", "is_file"],
        )

    return texts.mapInArrow(per_slice(scan, _SLICE), "doc_id long, path string, own string, similarity double, is_file boolean")


def _directory(path: Column) -> Column:
    """All of a path before its last slash; null for a null path."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def inherited(found: DataFrame) -> DataFrame:
    """doc_id, path, licence, how (file, header, inherited, none), similarity, licensed_dir of every row of `stated`."""
    files = staged(found.withColumn("dir", _directory(F.col("path"))))
    by_dir = files.filter("own is not null and dir is not null").groupBy("dir").agg(
        F.min(F.when(F.col("is_file"), F.col("own"))).alias("of_files"), F.min("own").alias("low"), F.max("own").alias("high")
    )
    licensed = staged(
        by_dir.select(F.col("dir").alias("licensed_dir"), F.coalesce("of_files", F.when(F.col("low") == F.col("high"), F.col("low"))).alias("given"))
        .filter("given is not null")
    )
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    dirs = files.filter("dir is not null").select("dir").distinct().select("dir", F.explode(F.array_union(F.array(F.lit("")), above)).alias("at"))
    nearest = staged(
        dirs.join(licensed, F.col("at") == F.col("licensed_dir"))
        .groupBy(F.col("dir").alias("_dir"))
        .agg(F.max_by(F.struct("licensed_dir", "given"), F.length("at")).alias("near"))
        .select("_dir", "near.*")
    )
    own = F.col("own").isNotNull()
    how = F.when(own & F.col("is_file"), "file").when(own, "header").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return files.join(nearest, F.col("dir") == F.col("_dir"), "left").select(
        "doc_id", "path", F.coalesce("own", "given").alias("licence"), how.alias("how"), "similarity",
        F.when(~own, F.col("licensed_dir")).alias("licensed_dir"),
    )
