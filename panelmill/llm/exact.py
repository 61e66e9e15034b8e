"""Exact dedup: a tree of merges over sorted digest runs. DataFrame operations only.

Each input partition is a run of (digest, best row). A round merges `FAN_IN` runs at a time: runs that share
the upper digits of their number meet by (digest, run // FAN_IN), sorted and merged, and keep the best row and
the count. After the last round one row per digest is left; the answer then goes back down the same tree, a
round at a time, to the rows. No task ever sees more of a group than one run holds or FAN_IN merged entries, so
a text that fills a third of the table spreads over all runs on both ways.

Digests are verified on every level: rows merge only if SHA-256, a second 64-bit hash and the byte length of
the normalised text all agree.

Defined cases: a null text is empty and equal to other texts that normalise to nothing; a null id comes after
all ids; of rows alike in id and length, the first read stays, so each group keeps exactly one row; very
long texts are digested whole; only the named columns are read, whatever others are called; an empty table gives an empty result.

Spark places the rows of a level by (digest, run), so a task sorts and merges many digests of many runs: the tree bounds how many entries of
one digest meet, not where they do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import WHITE, id_and_text, one_row_each
from panelmill.session import checkpoint

#: Runs that input partitions are dealt to, and runs merged at a time: 4096 = 16 * 16 * 16, three rounds.
RUNS, FAN_IN = 4096, 16

_KEY = ("digest", "check", "bytes")


def normalised(text: Column) -> Column:
    """The text without white space."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), WHITE, text)


def _keys(text: Column) -> dict[str, Column]:
    bare = normalised(text)
    return {"digest": F.unhex(F.sha2(bare, 256)), "check": F.xxhash64(bare), "bytes": F.octet_length(bare)}


def _merged(runs: DataFrame, by: list[str]) -> DataFrame:
    return runs.groupBy(*by).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, digest, check, bytes."""
    texts = id_and_text(docs, id_col, text_col)
    rows = checkpoint(
        texts.select("doc_id", F.length("text").cast("long").alias("points"), *[c.alias(n) for n, c in _keys(F.col("text")).items()])
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("run", F.pmod(F.shiftright("row", 33), F.lit(RUNS)))
    )
    # the smallest of these is the row that stays: most code points, then smallest id
    best = F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    levels = [_merged(rows.select(*_KEY, "run", best.alias("best"), F.lit(1).cast("long").alias("n")), [*_KEY, "run"])]
    width = RUNS
    while width > 1:
        width = -(-width // FAN_IN)
        up = levels[-1].withColumn("run", F.floor(F.col("run") / FAN_IN))
        levels.append(_merged(up, [*_KEY, "run"]))
    answer = levels.pop().select(*_KEY, "run", F.col("best").alias("top"), F.col("n").alias("group_size"))
    while levels:
        below = levels.pop().select(*_KEY, "run", F.floor(F.col("run") / FAN_IN).alias("above"))
        answer = below.join(answer.withColumnRenamed("run", "above"), [*_KEY, "above"]).drop("above")
    return rows.join(answer, [*_KEY, "run"]).select(
        "doc_id",
        F.col("top.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("top.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *_KEY,
    )


def unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    Rows alike in id and text are folded on the map side first, so even a row repeated a million times is
    shuffled once per partition; then one join by (id, digest) picks the rows that stay.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    stay = decide(docs, id_col, text_col).filter("kept")
    return one_row_each(docs, {"doc_id": F.col(id_col).cast("long"), **_keys(text)}, stay, F.length(text))
