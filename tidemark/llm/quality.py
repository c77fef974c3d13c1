"""Robust multivariate outliers: a minimum-covariance-determinant estimate per language and source.

Five transformed statistics of a text (log mean word length, log symbol rate, square roots of the duplicate-line,
repeated-word and capital shares) form a vector.  Concentration steps find, per (language, source) group, the mean
and covariance of the ``support`` share of vectors with the smallest Mahalanobis distance, from three starts of which the
smallest determinant wins; a text whose squared distance exceeds ``cutoff`` is rejected.

A concentration step is one aggregation over all rows: moments per (group, distance bin), combined before the
shuffle, then cumulated over the at most a few hundred bins of each group.  So the h-subset is exact up to the width of
a bin, no group is ever gathered, and a source with a third of all rows is no special case.  Vectors are
integers (1/1024 units), so sums are exact and do not depend on the order of rows.

Edge cases: a null text has no words (base_failed); null languages and sources are groups of their own; groups
with fewer than ``min_group`` usable rows form one common group, and if that is still smaller, nothing is rejected
by distance; constant statistics are held apart from singularity by a floor on each standard deviation; repeated
rows each get a row; an empty table gives an empty result; extra columns are
kept by ``reject_outliers`` unless it makes one of that name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import textops as X
from tidemark.llm.workspace import Workspace, maybe_broadcast

UNIT = 1024
STATS = ["x1", "x2", "x3", "x4", "x5"]
#: Least standard deviation of each statistic, in its own unit.  With 0.1 a share of duplicate lines or repeated words above
#: 0.36 over a group that has none is beyond the cutoff by itself.
FLOOR = [0.06, 0.15, 0.1, 0.1, 0.05]
SUPPORT = 0.75
#: 0.75 over the probability that chi-square(7) stays below the 0.75 quantile of chi-square(5).
CONSISTENCY = 1.41
#: The 1 - 1e-6 quantile of chi-square with five degrees of freedom.
CUTOFF = 35.9
MIN_GROUP = 64
PAIRS = [(i, j) for i in range(5) for j in range(i, 5)]

_CASED = X.SPACED.copy()
_CASED[65:91] = np.arange(65, 91)
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def _duplicate_lines(text: str) -> tuple[int, int]:
    seen, again, n = set(), 0, 0
    for line in text.split("\n"):
        n += 1
        if line.strip(" \t\n\x0b\x0c\r"):
            if line in seen:
                again += 1
            seen.add(line)
    return again, n


def text_statistics(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (the text itself only on request), the base counts and the statistic vector."""
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept)}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_capitals bigint"

    def measure(batches):
        for rows, data, offs in X.chunks(batches, text):
            per = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offs])
            hashes, first = X.words(data, offs, _CASED)
            h, at = X.grams(hashes, first, 3)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            order = np.lexsort((h, doc))
            same = np.zeros(len(h) + 1, bool)
            same[1:-1] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
            twice = np.zeros(len(h), bool)
            twice[order] = same[:-1] | same[1:]
            word = first[doc] + np.arange(len(h)) - at[doc]  # the first word of each window
            hit = np.zeros(len(hashes) + 3, bool)
            for j in range(3):
                hit[word[twice] + j] = True
            repeat = np.diff(np.concatenate(([0], np.cumsum(hit)))[first])
            in_word = (_CASED[data] != 0) & (data & 0xC0 != 0x80)
            lines = [_duplicate_lines(t or "") for t in rows.column(rows.schema.get_field_index(text)).to_pylist()]
            made = [np.diff(first), per(in_word), per(_SYMBOL[data]), np.array([a for a, _ in lines], np.int64), repeat, np.array([n for _, n in lines], np.int64), per((data >= 65) & (data <= 90))]
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(f.name)) for f in kept), *(pa.array(m.astype(np.int64)) for m in made)], names=[*(f.name for f in kept), *"n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_capitals".split()])

    found = docs.mapInArrow(measure, schema)
    n, q = F.col("n_words"), lambda x: F.round(x * UNIT).cast("long")
    vector = {
        "x1": q(F.log(F.col("word_chars") / n)),
        "x2": q(F.log1p(20 * F.col("n_symbols") / n)),
        "x3": q(F.sqrt(F.col("n_dup_lines") / F.col("n_lines"))),
        "x4": q(F.sqrt(F.col("n_repeat_words") / n)),
        "x5": q(F.sqrt(F.col("n_capitals") / F.col("word_chars"))),
    }
    failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    return found.withColumn("base_failed", failed).withColumns({k: F.when(~F.col("base_failed"), v) for k, v in vector.items()})


def _distance(center: list[Column], inverse: dict[tuple[int, int], Column]) -> Column:
    dev = [F.col(x) - c for x, c in zip(STATS, center, strict=True)]
    total = F.lit(0.0)
    for (i, j), w in inverse.items():
        total = total + (w if i == j else 2 * w) * dev[i] * dev[j]
    return total


def _estimates(moments: DataFrame, support: float) -> DataFrame:
    """Cumulated moments of the smallest distances of every (group, start) -> center, inverse covariance and determinant."""
    own = Window.partitionBy("grp", "start")
    to_here = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = ["n", *STATS, *(f"p{i}{j}" for i, j in PAIRS)]
    run = moments.withColumns({c: F.sum(c).over(to_here) for c in sums} | {"all": F.sum("n").over(own)})
    chosen = run.where(F.col("n") >= F.ceil(F.col("all") * support)).groupBy("grp", "start").agg(F.min_by(F.struct(*sums), "bin").alias("s")).select("grp", "start", "s.*")

    def solve(batches):
        for b in batches:
            p = b.to_pandas()
            n = p["n"].to_numpy(float)
            mean = p[STATS].to_numpy(float) / n[:, None]
            cov = np.zeros((len(p), 5, 5))
            for i, j in PAIRS:
                cov[:, i, j] = cov[:, j, i] = p[f"p{i}{j}"].to_numpy(float) / n - mean[:, i] * mean[:, j]
            cov = cov * CONSISTENCY + np.diag((np.array(FLOOR) * UNIT) ** 2)
            inv = np.linalg.inv(cov)
            made = {"grp": pa.array(p["grp"], pa.string()), "start": pa.array(p["start"], pa.int32()), "logdet": pa.array(np.linalg.slogdet(cov)[1])}
            yield pa.record_batch(made | {f"c{i}": pa.array(mean[:, i]) for i in range(5)} | {f"w{i}{j}": pa.array(inv[:, i, j]) for i, j in PAIRS})

    return chosen.mapInArrow(solve, "grp string, start int, logdet double, " + ", ".join(f"c{i} double" for i in range(5)) + ", " + ", ".join(f"w{i}{j} double" for i, j in PAIRS))


def _moments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("grp", "start", "bin").agg(F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(x) for x in STATS), *(F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"p{i}{j}") for i, j in PAIRS))


def _medians(cells: DataFrame, least: int) -> DataFrame:
    """``cells(grp, stat, v, n)`` -> grp, stat and the (lower) median of every group of ``least`` rows at least."""
    by = Window.partitionBy("grp", "stat")
    run = cells.withColumn("run", F.sum("n").over(by.orderBy("v"))).withColumn("all", F.sum("n").over(by))
    return run.where(f"2 * run >= all AND all >= {least}").groupBy("grp", "stat").agg(F.min("v").alias("m"))


_MEMBERS = ["c0", "c1", "c2", "c3", "c4", *(f"w{i}{j}" for i, j in PAIRS)]


def fit_mcd(vectors: DataFrame, work: Workspace, steps: int = 4, support: float = SUPPORT, least: int = MIN_GROUP) -> DataFrame:
    """``vectors(grp, x1 .. x5)`` (integers) -> per group of ``least`` rows at least: center c, inverse covariance w and logdet.

    Concentration runs from three starts at once - medians with fixed scales, medians with median absolute deviations, and mean and covariance of
    all - and the one whose final covariance has the smallest determinant is taken."""
    every = F.explode(F.array(*(F.struct(F.lit(i).alias("stat"), F.col(x).alias("v")) for i, x in enumerate(STATS)))).alias("e")
    cells = work.save(vectors.select("grp", every).groupBy("grp", "e.stat", "e.v").agg(F.count(F.lit(1)).alias("n")), "cells")
    median = work.save(_medians(cells, least), "medians")
    n_groups = median.count() // 5
    off = cells.join(maybe_broadcast(median, 5 * n_groups, 80), ["grp", "stat"]).groupBy("grp", "stat", F.abs(F.col("v") - F.col("m")).alias("v")).agg(F.sum("n").alias("n"))
    spread = _medians(off, least).select("grp", "stat", F.col("m").alias("mad"))
    wide = median.join(spread, ["grp", "stat"]).groupBy("grp").pivot("stat", list(range(5))).agg(F.first("m").alias("m"), F.first("mad").alias("mad"))

    def diagonal(start, scale):
        weights = (((1 / (scale(i) * scale(i))) if i == j else F.lit(0.0)).cast("double").alias(f"w{i}{j}") for i, j in PAIRS)
        return wide.select("grp", F.lit(start).alias("start"), F.lit(0.0).alias("logdet"), *(F.col(f"{i}_m").cast("double").alias(f"c{i}") for i in range(5)), *weights)

    fixed = diagonal(0, lambda i: F.lit(2.0 * FLOOR[i] * UNIT))
    robust = diagonal(1, lambda i: F.greatest(1.4826 * F.col(f"{i}_mad"), F.lit(FLOOR[i] * UNIT)))
    large = F.broadcast(median.select("grp").distinct()) if n_groups * 60 <= 24 << 20 else median.select("grp").distinct()
    every_row = vectors.join(large, "grp", "left_semi").select("*", F.lit(2).alias("start"), F.lit(0).alias("bin"))
    params = work.save(fixed.unionByName(robust).unionByName(_estimates(_moments(every_row), 1.0)), "params0")
    distance = _distance([F.col(f"c{i}") for i in range(5)], {(i, j): F.col(f"w{i}{j}") for i, j in PAIRS})
    for step in range(1, steps + 1):
        near = vectors.join(maybe_broadcast(params, 3 * n_groups, 300), "grp").withColumn("bin", F.least(F.floor(16 * F.log2(1 + distance)), F.lit(400)).cast("int"))
        params = work.save(_estimates(_moments(near), support), f"params{step}")
    best = params.groupBy("grp").agg(F.min_by(F.struct("logdet", *_MEMBERS), F.struct("logdet", "start")).alias("b"))
    return work.save(best.select("grp", "b.*"), "params")


def reject_outliers(docs: DataFrame, work: Workspace, steps: int = 4, support: float = SUPPORT, cutoff: float = CUTOFF, min_group: int = MIN_GROUP, keep_text: bool = False) -> DataFrame:
    """``docs(text, lang, source, ...)`` -> its columns (the text only with ``keep_text``), the base counts, ``distance`` (squared; null where no
    estimate applies), ``base_failed`` and ``kept``."""
    made = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_capitals base_failed kept distance own grp logdet".split()
    docs = docs.drop(*made, *STATS, *_MEMBERS)
    key = F.concat_ws("\x01", F.coalesce("lang", F.lit("\x00")), F.coalesce("source", F.lit("\x00")))
    table = work.save(text_statistics(docs, keep_text=keep_text).withColumn("own", key), "statistics")
    vectors = table.where("NOT base_failed").select("own", *STATS)
    large = work.save(vectors.groupBy("own").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_group).select("own", F.col("own").alias("grp")), "groups")
    n_large = large.count()
    grouped = lambda df: df.join(maybe_broadcast(large, n_large, 120), "own", "left").withColumn("grp", F.coalesce("grp", F.lit("*")))
    params = fit_mcd(grouped(vectors).select("grp", *STATS), work, steps, support, min_group)
    work.keep_only("statistics", "groups", "params")
    distance = _distance([F.col(f"c{i}") for i in range(5)], {(i, j): F.col(f"w{i}{j}") for i, j in PAIRS})
    judged = grouped(table).join(maybe_broadcast(params, n_large + 1, 300), "grp", "left").withColumn("distance", distance)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).drop("own", "grp", "logdet", *STATS, *_MEMBERS)


def op2_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return reject_outliers(docs, Workspace(spark, "quality")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )
