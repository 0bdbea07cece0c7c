"""Request-log analysis: phase metrics, plateau rule, failure runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordscope import fixed_values as fv
from ordscope.operators.checks import join_null_safe
from ordscope.operators.quantiles import exact_quantiles


def phase_metrics(
    log: DataFrame,
    wall_total: Column | None = None,
    phase_col: str = "phase_n",
    order_cols: Sequence[str] = ("img_idx",),
) -> DataFrame:
    """Counts, latency quantiles, throughput and first errors per concurrency phase.

    p95 uses the exclusive definition from 20 successes on, else the maximum.
    ``wall_total`` is an aggregate expression for the phase's duration; by
    default the longest request.
    """
    ok = F.coalesce(F.col("ok"), F.lit(False))
    status = F.col("status")
    server_error = status.between(500, 599)
    other = ~ok & (status.isNull() | ((status != 429) & ~server_error))
    has_error = F.col("error").isNotNull() & (F.col("error") != "")
    wall = F.max("wall_s") if wall_total is None else wall_total
    counts = log.groupBy(phase_col).agg(
        F.count(F.lit(1)).alias("n_attempted"),
        wall.alias("wall_total_s"),
        F.count_if(ok).alias("n_ok"),
        F.count_if(F.coalesce(status == 429, F.lit(False))).alias("n_429"),
        F.count_if(F.coalesce(server_error, F.lit(False))).alias("n_5xx"),
        F.count_if(other).alias("n_other_error"),
        F.max(F.when(ok, F.col("wall_s"))).alias("__max_ok"),
    )
    good = log.where(ok)
    latency = exact_quantiles(
        good, [phase_col], "wall_s", {"p50_wall_s": 0.5, "__p95": (0.95, True)}
    ).drop("n")
    errors = first_errors(log.where(has_error), [phase_col], order_cols)
    per_min = F.when(F.col("wall_total_s") > 0, F.col("n_ok") / F.col("wall_total_s") * 60.0).otherwise(0.0)
    return (
        counts.join(latency, phase_col, "left")
        .join(errors, phase_col, "left")
        .withColumn("p95_wall_s", F.when(F.col("n_ok") >= 20, F.col("__p95")).otherwise(F.col("__max_ok")))
        .withColumn("per_minute", per_min)
        .withColumn(
            "per_minute_per_stream",
            F.when(F.col(phase_col) > 0, F.col("per_minute") / F.col(phase_col)).otherwise(0.0),
        )
        .drop("__p95", "__max_ok")
    )


def first_errors(
    log: DataFrame, keys: Sequence[str], order_cols: Sequence[str], k: int = 3
) -> DataFrame:
    """First k error texts per key as an array.

    The row-number filter becomes a per-task group limit, so the array collects
    at most k entries per group.
    """
    order = Window.partitionBy(*keys).orderBy(*order_cols)
    first = log.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= k)
    return first.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__rn", "error"))), lambda e: e["error"]).alias(
            "error_examples"
        )
    )


def recommend_phase(metrics: DataFrame, phase_col: str = "phase_n") -> DataFrame:
    """Concurrency to use, with the rule that decided.

    Input is the phase table (one row per tried concurrency, a handful), so the
    unpartitioned window below orders a few rows by construction.
    """
    n = F.greatest(F.col("n_attempted"), F.lit(1))
    rows = metrics.select(
        F.col(phase_col).alias("phase"),
        (F.col("n_429") / n).alias("r429"),
        (F.col("n_other_error") / n).alias("rother"),
        (F.col("n_ok") / n).alias("rok"),
        "per_minute",
    )
    phases = rows.agg(F.array_sort(F.collect_list(F.struct("phase", "r429", "rother", "rok", "per_minute"))).alias("p"))
    worst_429 = F.array_max(F.transform("p", lambda x: x["r429"]))
    sequential_ok = F.exists("p", lambda x: (x["phase"] == 1) & (x["rok"] >= fv.SEQUENTIAL_OK_MIN))
    parallel_errors = F.exists("p", lambda x: (x["phase"] > 1) & (x["rother"] > fv.OTHER_ERROR_HARD))
    first = F.get("p", F.lit(0))
    start = F.struct(
        first["phase"].alias("best"), first["per_minute"].alias("prev"), F.lit(True).alias("going")
    )

    def walk(acc: Column, x: Column) -> Column:
        gain = F.when(acc["prev"] > 0, x["per_minute"] / acc["prev"]).otherwise(F.lit(0.0))
        up = acc["going"] & (gain >= fv.PLATEAU_GAIN) & (x["r429"] <= fv.RATE_LIMIT_SOFT)
        return F.struct(
            F.when(up, x["phase"]).otherwise(acc["best"]).alias("best"),
            x["per_minute"].alias("prev"),
            up.alias("going"),
        )

    plateau = F.aggregate(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), start, walk, lambda a: a["best"])
    hard = worst_429 > fv.RATE_LIMIT_HARD
    parallel = sequential_ok & parallel_errors
    empty = F.size("p") == 0
    return phases.select(
        F.when(empty | hard | parallel, F.lit(1)).otherwise(plateau).cast("int").alias("recommended_n"),
        F.when(empty, F.lit("no phases"))
        .when(hard, F.lit("rate limited"))
        .when(parallel, F.lit("parallel access limited"))
        .otherwise(F.lit("plateau"))
        .alias("rule"),
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order_cols: Sequence[str],
    value: Column,
    chunk: Column,
    name: str,
) -> DataFrame:
    """Running sum per key in two levels, so one hot key spreads over many tasks.

    ``chunk`` must be non-decreasing in the order (a time bucket, say). Rows are
    windowed per (key, chunk); the chunk totals, one small row each, are windowed
    per key. Rows without a key are a key of their own.
    """
    rows = df.withColumn("__value", value).withColumn("__chunk", chunk)
    part = [*keys, "__chunk"]
    totals = rows.groupBy(*part).agg(F.sum("__value").alias("__sum"))
    order = Window.partitionBy(*keys).orderBy("__chunk")
    totals = totals.withColumn(
        "__before", F.sum("__sum").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__sum")
    ).drop("__sum")
    inside = Window.partitionBy(*part).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    return (
        join_null_safe(rows, totals, part)
        .withColumn(name, F.col("__before") + F.sum("__value").over(inside))
        .drop("__value", "__chunk", "__before")
    )


def failure_runs(
    log: DataFrame,
    keys: Sequence[str],
    order_cols: Sequence[str],
    chunk: Column,
    failed: Column,
    min_length: int = 1,
) -> DataFrame:
    """Maximal runs of consecutive failures with at least ``min_length`` rows.

    The running number of successes labels the run a failure belongs to.
    """
    labelled = running_total(
        log.withColumn("__failed", failed),
        keys,
        order_cols,
        F.when(F.col("__failed"), 0).otherwise(1),
        chunk,
        "run",
    )
    first = order_cols[0]
    runs = labelled.where("__failed").groupBy(*keys, "run").agg(
        F.count(F.lit(1)).alias("run_length"),
        F.min(first).alias("run_start"),
        F.max(first).alias("run_end"),
    )
    return runs.where(F.col("run_length") >= min_length)
