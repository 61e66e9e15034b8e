"""Helpers that the operators share.

Operators read the named id and text columns only, or pack a row's own columns into one struct, so that
extra input columns never clash with theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.session import staged  # noqa: F401

#: White space of the word and normalisation rules, [\x20\x09-\x0D].
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Rows of one Arrow batch that Python functions take up at once are cut to about this many text bytes.
BATCH_BYTES = 16 << 20


def packed(docs: DataFrame, **extra: Column) -> DataFrame:
    """All columns of a row as `row`, beside the given columns; `.select("row.*")` undoes it."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in extra.items()])


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, named `doc_id` and `text`; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def one_row_each(docs: DataFrame, keys: dict[str, Column], stay: DataFrame, largest: Column | None = None) -> DataFrame:
    """One row, with all its columns, for each key that `stay` has (as columns of the same names, null-safe).

    Rows alike in the key are folded on the map side first (the one with the `largest` value stays), so even a row
    repeated a million times is shuffled once per partition.
    """
    rows = packed(docs, **keys, largest=F.lit(0) if largest is None else largest)
    first = rows.groupBy(*keys).agg(F.max_by("row", "largest").alias("row"))
    wanted = stay.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return first.join(wanted, same, "left_semi").select("row.*")


def slices(batch: pa.RecordBatch, column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch with about `most` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield batch.slice(start)


def per_slice(work: Callable[[pa.RecordBatch], pa.RecordBatch], most: int = BATCH_BYTES, column: str = "text") -> Callable:
    """A function for mapInArrow that gives `work` pieces of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, column, most):
                out = work(piece)
                if out.num_rows:
                    yield out

    return run
