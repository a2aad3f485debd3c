"""Profiles over streams: windows, sessions, and keyed state with late rows told apart."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from molquarry.catalog import describe


def describe_stream(stream: DataFrame, smiles: Column, names: Sequence[str] | None = None) -> DataFrame:
    """Descriptors are local to a row, so a stream takes the same plan as a table."""
    return describe(stream, smiles, names)


def windowed_profile(stream: DataFrame, time_col: str, value_col: str, by: Sequence[str] = (), width: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Count, mean and population variance of a column in windows of event time, with a watermark."""
    timed = stream.withWatermark(time_col, late)
    window = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    x = F.col(value_col).cast("double")
    grouped = timed.groupBy(window.alias("w"), *by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance"))
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "mean", "variance")


def session_profile(stream: DataFrame, time_col: str, value_col: str, by: Sequence[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Count, mean and population variance of a column over sessions: rows of one group that follow each other within a gap.

    session_end is the last row's time plus the gap. Rows without a time are in no session. A session's rows are
    merged as they come, so a long one takes no more memory than a short one.
    """
    timed = stream.withWatermark(time_col, late)
    x = F.col(value_col).cast("double")
    grouped = timed.groupBy(F.session_window(time_col, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("rows"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance"))
    return grouped.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "rows", "n", "mean", "variance")


class _LateProfile(StatefulProcessor):
    """Of each key: number, mean and centred squares of its rows in time, the newest time, and number and sum of late rows."""

    def __init__(self, allowed: float):
        self.allowed = allowed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("profile", "n long, mean double, m2 double, newest double, late long, late_sum double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, mean, m2, newest, late, late_sum = self.state.get() if self.state.exists() else (0, 0.0, 0.0, float("-inf"), 0, 0.0)
        for part in rows:
            for at, x in zip(part["at"], part["x"], strict=True):
                if at < newest - self.allowed:
                    late, late_sum = late + 1, late_sum + x
                    continue
                newest, n = max(newest, at), n + 1
                step = x - mean
                mean += step / n
                m2 += step * (x - mean)
        self.state.update((n, mean, m2, newest, late, late_sum))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "mean": [mean if n else None], "variance": [m2 / n if n else None], "late": [late], "late_sum": [late_sum]})

    def close(self) -> None:
        pass


def late_profile(stream: DataFrame, key_col: str, time_col: str, value_col: str, allowed_seconds: float) -> DataFrame:
    """A running profile of each key as keyed state: key, n, mean, variance, and late and late_sum of the rows that came too late.

    A row is late if its time is more than ``allowed_seconds`` before the newest that its key has had before; late rows change nothing else. Rows without
    key, time or value are left out. The state of a key has a fixed size; the last row of a key in update mode is its profile.
    The state store has to be RocksDB's (spark.sql.streaming.stateStore.providerClass).
    """
    rows = stream.select(F.col(key_col).cast("string").alias("key"), F.unix_micros(F.col(time_col).cast("timestamp")).cast("double").alias("us"), F.col(value_col).cast("double").alias("x"))
    some = rows.where("key IS NOT NULL AND us IS NOT NULL AND x IS NOT NULL").select("key", (F.col("us") / 1e6).alias("at"), "x")
    return some.groupBy("key").transformWithStateInPandas(_LateProfile(allowed_seconds), "key string, n long, mean double, variance double, late long, late_sum double", "Update", "None")


def late_table(table: DataFrame, key_col: str, time_col: str, value_col: str, order_col: str, allowed_seconds: float) -> DataFrame:
    """What ``late_profile`` ends with if the rows of a finished table come in an order: key, n, mean, variance, late, late_sum."""
    at = F.unix_micros(F.col(time_col).cast("timestamp")).cast("double") / 1e6
    rows = table.select(F.col(key_col).cast("string").alias("key"), at.alias("at"), F.col(value_col).cast("double").alias("x"), F.col(order_col).alias("o")).where("key IS NOT NULL AND at IS NOT NULL AND x IS NOT NULL")
    # A late row is never the newest of its key, so the newest row before is the newest one in time before.
    newest = F.max("at").over(Window.partitionBy("key").orderBy("o").rowsBetween(Window.unboundedPreceding, -1))
    told = rows.withColumn("late", F.coalesce(F.col("at") < newest - F.lit(float(allowed_seconds)), F.lit(False)))
    x, y = F.when(~F.col("late"), F.col("x")), F.when(F.col("late"), F.col("x"))
    return told.groupBy("key").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance"), F.count(y).alias("late"), F.coalesce(F.sum(y), F.lit(0.0)).alias("late_sum"))
