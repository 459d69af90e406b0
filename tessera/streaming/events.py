"""Events ``(t, x, y, p)``, spike encoders and stateful neurons.

One step function serves both forms: a batch is folded cell by cell in event
order, a stream keeps each cell's state between micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events(spark: SparkSession, rows: list[tuple[float, int, int, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "t double, x int, y int, p int")


def encode_rate(df: DataFrame, i: str, v: str, max_rate: float = 100.0, t_window: float = 1.0) -> DataFrame:
    """``i, t``: round(v * max_rate * t_window / 1000) spikes, evenly spread over the window."""
    n = F.rint(F.col(v) * (max_rate * t_window / 1000)).cast("int")
    counted = df.select(F.col(i).alias("i"), n.alias("n")).filter("n > 0")
    return counted.select("i", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s")).select("i", (F.lit(float(t_window)) * F.col("s") / F.col("n")).alias("t"))


def encode_temporal(df: DataFrame, i: str, v: str, t_window: float = 1.0) -> DataFrame:
    """One spike each; stronger values spike earlier."""
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(v).cast("double")))
    return df.select(F.col(i).alias("i"), ((1 - held) * t_window).alias("t"))


def stdp(dt: Column, a_plus: float = 0.01, a_minus: float = 0.012, tau: float = 20.0) -> Column:
    """Weight change by the time between a cell's spike and its input's."""
    return F.when(dt > 0, a_plus * F.exp(-dt / tau)).when(dt < 0, -a_minus * F.exp(dt / tau)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class LIF:
    """A leaky integrate-and-fire cell."""

    tau: float = 20.0
    threshold: float = 1.0
    reset: float = 0.0
    weight: float = 1.0
    dt: float = 1.0

    def step(self, state: tuple, current: float) -> tuple[tuple, bool]:
        v = state[0] + (-state[0] + current) / self.tau * self.dt
        return ((self.reset,), True) if v >= self.threshold else ((v,), False)

    start = (0.0,)


@dataclass(frozen=True)
class Izhikevich:
    a: float = 0.02
    b: float = 0.2
    c: float = -65.0
    d: float = 8.0
    weight: float = 1.0
    dt: float = 1.0

    def step(self, state: tuple, current: float) -> tuple[tuple, bool]:
        v, u = state
        v, u = v + self.dt * (0.04 * v * v + 5 * v + 140 - u + current), u + self.dt * self.a * (self.b * v - u)
        return ((self.c, u + self.d), True) if v >= 30 else ((v, u), False)

    @property
    def start(self) -> tuple:
        return (-65.0, self.b * -65.0)


def _fold(pdf: pd.DataFrame, cell, state: tuple) -> tuple[pd.DataFrame, tuple]:
    keep = []
    for p in pdf["p"].to_numpy():
        state, fired = cell.step(state, cell.weight * float(p))
        keep.append(fired)
    return pdf.loc[keep, ["t", "x", "y"]].assign(p=1), state


def simulate(df: DataFrame, cell=LIF(), width: int | None = None, height: int | None = None, order: list[str] = ("t",)) -> DataFrame:
    """``t, x, y, p`` of the spikes: each cell folds its events in order of t (add
    columns to ``order`` to break ties).  Events outside the grid are dropped."""
    inside = F.lit(True)
    if width is not None:
        inside = inside & (F.col("x") >= 0) & (F.col("x") < width)
    if height is not None:
        inside = inside & (F.col("y") >= 0) & (F.col("y") < height)
    cols = list(dict.fromkeys(["t", "x", "y", "p", *order]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _fold(pdf.sort_values(list(order), kind="stable"), cell, cell.start)[0]

    return df.filter(inside).select(*cols).groupBy("x", "y").applyInPandas(run, "t double, x int, y int, p int")


def simulate_stream(df: DataFrame, cell=LIF()) -> DataFrame:
    """The same over a stream of ``t, x, y, p``: state lives with Spark, late rows of
    a micro-batch are ordered within it."""
    names = ", ".join(f"s{k} double" for k in range(len(cell.start)))

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else tuple(cell.start)
        pdf = pd.concat(list(batches)).sort_values("t", kind="stable")
        out, now = _fold(pdf, cell, now)
        state.update(now)
        yield out

    return df.select("t", "x", "y", "p").groupBy("x", "y").applyInPandasWithState(run, "t double, x int, y int, p int", names, "append", GroupStateTimeout.NoTimeout)


def tumbling(df: DataFrame, time: str, width: str, late: str = "10 minutes", keys: list[str] = (), **aggs: Column) -> DataFrame:
    """Windowed aggregates over a stream or a table, with a watermark for late rows."""
    rows = df.withWatermark(time, late) if df.isStreaming else df
    return rows.groupBy(F.window(time, width), *keys).agg(*[a.alias(n) for n, a in aggs.items()]).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggs)


def sliding(df: DataFrame, time: str, width: str, slide: str, late: str = "10 minutes", keys: list[str] = (), **aggs: Column) -> DataFrame:
    rows = df.withWatermark(time, late) if df.isStreaming else df
    return rows.groupBy(F.window(time, width, slide), *keys).agg(*[a.alias(n) for n, a in aggs.items()]).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggs)


def sessions(df: DataFrame, time: str, gap: str, late: str = "10 minutes", keys: list[str] = (), **aggs: Column) -> DataFrame:
    rows = df.withWatermark(time, late) if df.isStreaming else df
    return rows.groupBy(F.session_window(time, gap), *keys).agg(*[a.alias(n) for n, a in aggs.items()]).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, *aggs)
