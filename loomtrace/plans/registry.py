"""Registration of queries: a name, a function of canonical frames, and SQL over the same frames for another engine."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..sources.bridge import ORACLE_FRAMES, Frames

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


#: Bytes of a compiled step beyond which the JVM only interprets it. Spark's own limit is eight times that; above this one it
#: compiles an operator's columns apart, which takes less than half of the time.
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit", "8000"


def _run(build: Callable[[Frames], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set(*METHOD_LIMIT)
    return build(Frames(spark, sf_dir))


def with_frames(sql: str, frames: tuple[str, ...]) -> str:
    """The SQL with the definitions of the frames it reads (and of those that they read) put before it."""
    needed: list[str] = []

    def add(name: str) -> None:
        for other in ORACLE_FRAMES[name][0]:
            add(other)
        if name not in needed:
            needed.append(name)

    for name in frames:
        add(name)
    ctes = [f"{name} AS ({ORACLE_FRAMES[name][1]})" for name in needed]
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        body = body[len("WITH RECURSIVE") if recursive else len("WITH") :].strip()
        ctes.append(body)
        return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def query(name: str, sql: str | None = None, frames: tuple[str, ...] = ("calls",)):
    """Registers a function of Frames under a name; sql may begin with WITH and is given the canonical frames."""

    def register(build: Callable[[Frames], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"two queries are called {name}")
        _QUERIES[name] = partial(_run, build)
        if sql:
            _ORACLES[name] = with_frames(sql, frames)
        return build

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
