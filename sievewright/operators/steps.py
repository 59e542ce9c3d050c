"""Steps whose failures stay in their rows, and health checks over a table in one pass."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """``run`` makes a value of Spark type ``returns`` from the value of ``column``; it may raise."""

    name: str
    column: str
    run: Callable[[object], object]
    returns: str


def _tried(step: Step) -> Column:
    run = step.run

    @F.pandas_udf(f"value {step.returns}, error string, ms double")
    def attempt(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for x in part:
                begun = time.perf_counter()
                try:
                    value, error = run(x), None
                except Exception as e:  # a row's failure is its own
                    value, error = None, f"{type(e).__name__}: {e}"
                rows.append((value, error, (time.perf_counter() - begun) * 1000))
            yield pd.DataFrame(rows, columns=["value", "error", "ms"], dtype=object).astype({"ms": float})

    return attempt(F.col(step.column))


def run_steps(df: DataFrame, steps: list[Step]) -> DataFrame:
    """Adds a column for each step (null where it failed), ``trace`` (step, status, detail, ms),
    ``degraded_reasons`` and ``status``: degraded where any step failed, else ok. A later step may read
    an earlier one's column."""
    made = []
    for step in steps:
        df = df.withColumn(f"__{step.name}", _tried(step)).withColumn(step.name, F.col(f"__{step.name}.value"))
        made.append((step.name, F.col(f"__{step.name}.error"), F.col(f"__{step.name}.ms")))
    trace = F.array(*[F.struct(F.lit(n).alias("step"), F.when(e.isNull(), "ok").otherwise("degraded").alias("status"), e.alias("detail"), ms.alias("ms")) for n, e, ms in made])
    reasons = F.filter(F.array(*[F.concat(F.lit(n + ": "), e) for n, e, _ in made]), lambda r: r.isNotNull())
    out = df.withColumns({"trace": trace, "degraded_reasons": reasons})
    return out.withColumn("status", F.when(F.size("degraded_reasons") > 0, "degraded").otherwise("ok")).drop(*[f"__{s.name}" for s in steps])


def health(df: DataFrame, checks: dict[str, tuple[Column, bool]]) -> DataFrame:
    """(check, required, ok, ready) from aggregates over one pass: ``checks`` gives each a boolean
    aggregate and whether it is required. A table is ready where no required check fails; a check
    that gives null has failed."""
    done = df.agg(*[F.coalesce(ok, F.lit(False)).alias(name) for name, (ok, _) in checks.items()])
    ready = F.lit(True)
    for name, (_, required) in checks.items():
        ready = ready & (F.col(name) if required else F.lit(True))
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.lit(r).alias("required"), F.col(n).alias("ok"), ready.alias("ready")) for n, (_, r) in checks.items()])
    return done.select(F.explode(rows).alias("x")).select("x.*")
