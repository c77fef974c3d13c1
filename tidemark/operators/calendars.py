"""Session calendars: rule-built phase tables, lookups, windows, expected minutes, retention cutoffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.timeops import from_micros, micros
from tidemark.operators.schedule import evaluate


def phases(spark: SparkSession, first: str, last: str, opens: str = "13:30:00", closes: str = "20:00:00") -> DataFrame:
    """trade_date, phase, open_ts, close_ts: PRE, REGULAR and POST of every weekday (three rows a day: a small table)."""
    days = spark.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}', INTERVAL 1 DAY)) AS d").where("dayofweek(d) BETWEEN 2 AND 6")
    at = lambda clock: F.to_timestamp_ntz(F.concat_ws(" ", F.col("d").cast("string"), F.lit(clock)))
    marks = [("PRE", "08:00:00", opens), ("REGULAR", opens, closes), ("POST", closes, "23:59:59")]
    return days.select(F.explode(F.array(*(F.struct(F.to_timestamp_ntz(F.col("d").cast("string")).alias("trade_date"), F.lit(p).alias("phase"), at(a).alias("open_ts"), at(b).alias("close_ts")) for p, a, b in marks))).alias("x")).select("x.*")


def session_of(rows: DataFrame, ts: str, calendar: DataFrame) -> DataFrame:
    """Adds trade_date and phase, CLOSED outside; windows do not span days, so the range join is an equi-join on the date."""
    c = calendar.select("trade_date", "phase", F.col("open_ts").alias("_o"), F.col("close_ts").alias("_c"))
    r = rows.withColumn("_d", F.date_trunc("day", ts).cast("timestamp_ntz"))
    j = r.join(c, (F.col("_d") == F.col("trade_date")) & (F.col(ts) >= F.col("_o")) & (F.col(ts) < F.col("_c")), "left")
    return j.withColumn("phase", F.coalesce("phase", F.lit("CLOSED"))).drop("_d", "_o", "_c")


def next_transition(rows: DataFrame, ts: str, calendar: DataFrame) -> DataFrame:
    """The first boundary of the calendar after each time: the end of the window, or of the closed stretch, that holds it."""
    return evaluate(rows, ts, calendar).select(*rows.columns, "next_transition")


def expected_opens(calendar: DataFrame, seconds: int, phase: str = "REGULAR") -> DataFrame:
    """Every bar open inside the phase, with its ordinal over all sessions of the phase."""
    step = F.expr(f"INTERVAL {seconds} SECONDS")
    rows = calendar.where(F.col("phase") == phase).select("trade_date", F.explode(F.sequence("open_ts", F.col("close_ts") - step, step)).alias("open_ts"))
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("trade_date").orderBy("open_ts")).cast("long"))


def retention_cutoff(calendar: DataFrame, as_of: Column, sessions: int) -> DataFrame:
    """Open of the ``sessions``-th newest session that had closed by ``as_of``."""
    done = calendar.where((F.col("phase") == "REGULAR") & (F.col("close_ts") <= as_of))
    return done.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("open_ts")))).where(F.col("_r") == sessions).select(F.col("open_ts").alias("cutoff"))


def subtract(windows: DataFrame, breaks: DataFrame) -> DataFrame:
    """``windows(id, open_ts, close_ts)`` less ``breaks(id, open_ts, close_ts)`` (which do not overlap): what is left, in order."""
    b = breaks.select("id", F.col("open_ts").alias("_bo"), F.col("close_ts").alias("_bc"))
    cut = windows.join(b, "id", "left").where("_bo IS NULL OR (_bo < close_ts AND _bc > open_ts)").groupBy("id", "open_ts", "close_ts").agg(F.sort_array(F.collect_list(F.struct("_bo", "_bc"))).alias("_x"))
    none = windows.join(cut.select("id", "open_ts"), ["id", "open_ts"], "left_anti").withColumn("_x", F.array().cast(cut.schema["_x"].dataType)).select("id", "open_ts", "close_ts", "_x")
    every = cut.unionByName(none).withColumn("_x", F.filter("_x", lambda x: x["_bo"].isNotNull()))
    starts = F.concat(F.array("open_ts"), F.transform("_x", lambda x: x["_bc"]))
    ends = F.concat(F.transform("_x", lambda x: x["_bo"]), F.array("close_ts"))
    return every.select("id", F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("p")).select("id", F.col("p.s").alias("open_ts"), F.col("p.e").alias("close_ts")).where("open_ts < close_ts")


def resolve_window(kind: str, open_ts: Column, close_ts: Column, as_of: Column, interval_seconds: int, offset: int = 0, duration: int = 0) -> tuple[Column, Column]:
    """Bounds of a historical window kind: the end is the last completed boundary, and inclusive (exclusive end less one microsecond)."""
    floor_ = F.floor(micros(as_of) / (interval_seconds * 1_000_000)) * (interval_seconds * 1_000_000)
    o, c = micros(open_ts), micros(close_ts)
    begin, end = {
        "current_session": (o, F.least(c, floor_)),
        "whole_session": (o, c),
        "from_open": (o + offset * 1_000_000, F.least(o + (offset + duration) * 1_000_000, c, floor_)),
        "to_close": (c - duration * 1_000_000, F.least(c, floor_)),
        "trailing": (floor_ - duration * 1_000_000, floor_),
    }[kind]
    good = end > begin
    return F.when(good, from_micros(begin)), F.when(good, from_micros(end - 1))
