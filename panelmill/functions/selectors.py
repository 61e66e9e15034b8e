"""Column lists read from a frame's schema."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelmill.functions import keys as K


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns without keys, label and look-ahead columns."""
    fixed = {K.ENTITY, K.PERIOD, K.LABEL, *K.LOOK_AHEAD, *exclude}
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in fixed]


def predictor_columns(df: DataFrame) -> list[str]:
    out = {*K.LOOK_AHEAD, *K.NOT_PREDICTORS}
    return [c for c in df.columns if c not in out]


def numeric_predictors(df: DataFrame) -> list[str]:
    allowed = set(predictor_columns(df))
    return [c for c in numeric_columns(df) if c in allowed]


# Prefixes of amount columns, suffixes of derived columns.
AMOUNT_PREFIXES = ("m", "Visa_m", "Master_m")
HISTORY_SUFFIXES = ("__lag1", "__delta1", "__lag2", "__delta2")


def with_prefix(columns: Iterable[str], *prefixes: str) -> list[str]:
    return [c for c in columns if c.startswith(prefixes)]


def with_suffix(columns: Iterable[str], *suffixes: str) -> list[str]:
    return [c for c in columns if c.endswith(suffixes)]


def amount_columns(columns: Iterable[str]) -> list[str]:
    return [c for c in columns if c.startswith(AMOUNT_PREFIXES) and "__" not in c]


def own_amounts(columns: Iterable[str]) -> list[str]:
    """Amounts of the accounts, without the card amounts."""
    return [c for c in columns if c.startswith("m") and "__" not in c and c not in (K.EXIT_PERIOD, K.LAST_PERIOD, K.N_PERIODS)]


def family(column: str) -> str:
    """The raw column a derived one comes from."""
    return re.sub(r"__.*", "", column)


def allow_list(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Keep the keys and the listed columns; fail when one is missing."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the panel: {missing}")
    fixed = [c for c in (K.ENTITY, K.PERIOD, K.LABEL) if c in df.columns and c not in wanted]
    return df.select(*fixed, *wanted)


def read_allow_list(df: DataFrame, path: str) -> DataFrame:
    """`allow_list` with one column name per line of a text file."""
    lines = df.sparkSession.read.text(path).collect()
    return allow_list(df, [r.value.strip() for r in lines if r.value.strip()])
