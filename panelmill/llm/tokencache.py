"""Token counts through a cache of content digests.

The cache is a table of (tokenizer, content, n_tokens), in one folder for each tokenizer digest. `tokenizer` is the SHA-256 of the
tokenizer's file, its library's version and the rule of normalisation, so counts of another version are never taken; `content` is the
SHA-256 of the normalised text. Digests are computed beside the scan and are all that is looked up: one row per distinct content is left
by an aggregate, an anti join with the cache leaves the misses, and of each miss the text of one row (the smallest id) is fetched, encoded
and its count appended. All rows then join the cache by digest. Texts are shuffled once, to fetch those of the misses, and rows alike in id
and content fold before that; a content that fills a third of the table is one digest per task in the aggregate and one row in the fetch.

Normalisation takes away only what the tokenizer does not see. With `spaces`, runs of [\\x20\\x09-\\x0D] become one space and those at the
ends go: right for tokenizers that cut at white space and drop it. Their counts add up over the pieces between spaces as well, so a
slice's distinct pieces are encoded once, a worker keeps the counts of pieces it has seen (up to KNOWN, then it forgets them all), and a
very long text never stands in the encoder whole. Other tokenizers get whole texts.

A lost executor repeats its tasks; appended files count only when their job commits, and two jobs that append the same digest at
once do no harm, as equal digests are folded when they are read.

Defined cases: a null or empty text has 0 bytes and the count of the empty text; null ids are kept; repeated rows are answered each; of
rows equal in content the smallest id is encoded (a null id last), and ties do not matter, as the counts are equal; columns other than id
and text are not read, whatever their names; an empty table gives an empty result and appends nothing.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import os
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import id_and_text, slices
from panelmill.session import checkpoint

#: Text bytes of a slice, pieces of one call of the library, pieces whose counts a worker keeps.
_SLICE, _CALL, KNOWN = 4 << 20, 8192, 1 << 20
CACHE = "tokenizer string, content binary, n_tokens long"


@dataclass(frozen=True)
class Tokenizer:
    """A tokenizer's file, read once: `.json` for tokenizers, `.model` for sentencepiece."""

    kind: str
    content: bytes
    spaces: bool

    @classmethod
    def of(cls, path: str) -> Tokenizer:
        """White space is folded (`spaces`) where the file says that the tokenizer cuts at it and drops it."""
        with open(path, "rb") as file:
            content = file.read()
        kind = {"json": "tokenizers", "model": "sentencepiece"}[path.rsplit(".", 1)[-1]]
        return cls(kind, content, kind == "tokenizers" and cut_at_space(json.loads(content)) is not None)

    @property
    def digest(self) -> str:
        """Changes with the file, the library's version and the rule of normalisation."""
        parts = (self.content, self.kind.encode(), importlib.metadata.version(self.kind).encode(), b"spaces" if self.spaces else b"whole")
        return hashlib.sha256(b"".join(hashlib.sha256(p).digest() for p in parts)).hexdigest()

    def normalised(self, text: Column) -> Column:
        return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")) if self.spaces else text

    def counter(self) -> Callable[[list[str]], list[int]]:
        """The library's token count of each text, without begin, end or added special tokens."""
        if self.kind == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=self.content)
            return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        own = _library(self.content)
        return lambda texts: [len(e) for e in own.encode_batch_fast(texts, add_special_tokens=False)]


def _library(content: bytes):
    import tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
    own = tokenizers.Tokenizer.from_buffer(content)
    own.no_truncation()
    own.no_padding()
    return own


def cut_at_space(file: dict) -> str | None:
    """The pattern that a tokenizer file cuts texts with, if the file folds white space, cuts at it and drops it, and reads small letters only.

    Then white space between pieces tells the tokenizer nothing. Added tokens with spaces in or around them would see it.
    """
    steps = (file.get("normalizer") or {}).get("normalizers", [])
    cuts = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]]) for t in file.get("added_tokens", []))
    folds = any(s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in steps)
    known = {s["type"] for s in steps} == {"NFC", "Replace", "Lowercase"} and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
    if not (plain and folds and known and cuts[0]["invert"] and cuts[0]["behavior"] == "Removed" and not cuts[1]["use_regex"]):
        return None
    pattern = cuts[0]["pattern"].get("Regex", "")
    return pattern if regex.findall(pattern, " \t\n\x0b\x0c\r") == [] else None


class Pieces:
    """Token counts of pieces of text without white space. Counts of pieces and of their parts are kept, up to KNOWN of each."""

    def __init__(self, tokenizer: Tokenizer):
        file = json.loads(tokenizer.content)
        self.whole, self.model = tokenizer.counter(), _library(tokenizer.content).model
        self.cut = regex.compile(cut_at_space(file)).findall
        self.marks = {t["content"][:2] for t in file.get("added_tokens", [])}
        self.known: dict[str, int] = {}
        self.parts: dict[str, int] = {}

    def plain(self, piece: str) -> bool:
        """Printable ASCII without the beginning of an added token: its small letters are cut by the pattern and each part is merged by itself."""
        return piece.isascii() and piece.isprintable() and not any(m in piece for m in self.marks)

    def part(self, part: str) -> int:
        n = self.parts.get(part)
        if n is None:
            if len(self.parts) >= KNOWN:
                self.parts.clear()
            n = self.parts[part] = len(self.model.tokenize(part))
        return n

    def counts(self, pieces: list[str]) -> np.ndarray:
        if len(self.known) + len(pieces) > KNOWN:
            self.known.clear()
        others = []
        for p in pieces:
            if p not in self.known:
                if self.plain(p):
                    self.known[p] = sum(map(self.part, self.cut(p.lower())))
                else:
                    others.append(p)
        for begin in range(0, len(others), _CALL):
            some = others[begin : begin + _CALL]
            self.known.update(zip(some, self.whole(some), strict=True))
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))


def counts_of(texts: list[str], counter: Callable[[list[str]], list[int]] | Pieces) -> np.ndarray:
    """The token count of each text, whole or by its distinct pieces between spaces."""
    if not isinstance(counter, Pieces):
        return np.fromiter((n for i in range(0, len(texts), 64) for n in counter(texts[i : i + 64])), np.int64, len(texts))
    numbers: defaultdict[str, int] = defaultdict(count().__next__)
    which = [np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)) for own in (t.split(" ") for t in texts)]
    each = counter.counts(list(numbers))
    return np.array([each[w].sum() for w in which], np.int64)


#: What a Python worker keeps from task to task, by tokenizer digest.
_KEPT: dict[str, Callable[[list[str]], list[int]] | Pieces] = {}


def _kept(tokenizer: Tokenizer) -> Callable[[list[str]], list[int]] | Pieces:
    if tokenizer.digest not in _KEPT:
        _KEPT.clear()
        _KEPT[tokenizer.digest] = Pieces(tokenizer) if tokenizer.spaces else tokenizer.counter()
    return _KEPT[tokenizer.digest]


def cached(cache: str, tokenizer: Tokenizer, like: DataFrame) -> DataFrame:
    """The cache's rows (content, n_tokens) of a tokenizer; the folder is made if it is not there."""
    spark = like.sparkSession
    folder = f"{cache}/{tokenizer.digest}"
    spark.createDataFrame([], CACHE).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.schema(CACHE).parquet(folder).filter(F.col("tokenizer") == tokenizer.digest).select("content", "n_tokens")


def missing(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """(content, doc_id) of each distinct content that the cache lacks, with the smallest id that has it."""
    first = keyed.groupBy("content").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("first"))
    return first.join(known, "content", "left_anti").select("content", F.col("first.doc_id").alias("doc_id"))


def counted(
    docs: DataFrame, tokenizer: Tokenizer, cache: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens of every row. Misses are encoded and appended to the cache folder."""
    texts = id_and_text(docs, id_col, text_col)
    content = F.unhex(F.sha2(tokenizer.normalised(F.col("text")), 256)).alias("content")
    keyed = checkpoint(texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), content))
    misses = missing(keyed, cached(cache, tokenizer, docs))
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Tokenizer = shared.value
        counter = _kept(own)
        for batch in batches:
            for piece in slices(batch, most=_SLICE):
                numbers = counts_of(piece.column("text").to_pylist(), counter)
                names = pa.array([own.digest] * len(numbers), pa.string())
                yield pa.RecordBatch.from_arrays([names, piece.column("content"), pa.array(numbers)], ["tokenizer", "content", "n_tokens"])

    # the text of one row of each miss: rows alike in id and content fold first
    # the id as two columns without nulls, so aggregate and join share one exchange
    whole_id = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "content"]
    bodies = texts.withColumn("content", content).select(*whole_id, tokenizer.normalised(F.col("text")).alias("text"))
    folded = bodies.groupBy("id", "no_id", "content").agg(F.first("text").alias("text"))
    fresh = folded.join(misses.select(*whole_id), ["id", "no_id", "content"], "left_semi").select("content", "text").mapInArrow(encode, CACHE)
    fresh.write.mode("append").parquet(f"{cache}/{tokenizer.digest}")
    mine = keyed.select("content").distinct().withColumnRenamed("content", "_content")
    counts = cached(cache, tokenizer, docs).join(mine, F.col("content") == F.col("_content"), "left_semi")
    # checkpointed, so both sides of the join are plain exchanges and a hot content can be split
    counts = checkpoint(counts.groupBy("content").agg(F.max("n_tokens").alias("n_tokens")))
    return keyed.join(counts, "content").select("doc_id", "n_bytes", "n_tokens")
