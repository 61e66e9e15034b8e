"""Registered queries: a Spark job over the given tables and, where there is one, its check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    job: Job
    covers: tuple[str, ...]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Job], Job]:
    """Register a job under a name with the survey ids it covers and its check SQL."""

    def keep(job: Job) -> Job:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = Query(name, job, tuple(covers.split()), sql)
        return job

    return keep
