"""Progress of processing: status counts, batches, step times, quotas, stuck records.

All functions but the step times work on a stream as well as on a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from talentloom import rules
from talentloom.operators.ordered import exact_quantiles, next_in_order, running_sum, value_positions


def status_counts(df: DataFrame, by_day: bool = False) -> DataFrame:
    """Records per status, from one row per record (see ``latest_status``); ``by_day`` adds days with subtotals (null day or status = all)."""
    if not by_day:
        return df.groupBy("status").agg(F.count("*").alias("n"))
    return df.withColumn("day", F.to_date("ts")).rollup("day", "status").agg(F.count("*").alias("n"))


def file_status(status_events: DataFrame, batch: str = "batch", key: str = "resume_id") -> DataFrame:
    """(batch, record, status, since, progress, error): the latest status of every file of a batch, percent done, and what failed."""
    order = F.struct("ts", "event_id")
    latest = status_events.groupBy(batch, key).agg(F.max_by("status", order).alias("status"), F.max("ts").alias("since"))
    steps = F.create_map(*[F.lit(x) for pair in rules.STEP_PROGRESS.items() for x in pair])
    return latest.withColumn("progress", F.coalesce(F.try_element_at(steps, F.col("status")), F.lit(0))).withColumn(
        "error", F.when(F.col("status").isin(*rules.FAILURE_STATUSES), F.col("status"))
    )


def bulk_progress(status_events: DataFrame, batch: str = "batch", key: str = "resume_id") -> DataFrame:
    """Files per batch by their latest status, and percent finished (completed or failed)."""
    failed = F.col("status").isin(*rules.FAILURE_STATUSES)
    counts = file_status(status_events, batch, key).groupBy(batch).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == rules.COMPLETED).alias("completed"),
        F.count_if(failed).alias("failed"),
    )
    finished = F.col("completed") + F.col("failed")
    return (
        counts.withColumn("processing", F.col("total") - finished)
        .withColumn("progress", F.floor(finished * 100 / F.col("total")).cast("int"))
        .withColumn("status", F.when(F.col("processing") > 0, "processing")
                    .when(F.col("completed") == 0, "failed").otherwise("completed"))
    )


def step_durations(status_events: DataFrame, key: str = "resume_id") -> DataFrame:
    """Add ``seconds`` to the next event of the record and ``next_status``; null for the last event."""
    following = next_in_order(status_events, [key], F.date_trunc("minute", "ts"), ["ts", "event_id"], ["ts", "status"])
    micros = F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return following.withColumn("seconds", F.round(micros / 1e6, 3)).drop("next_ts")


def total_times(status_events: DataFrame, key: str = "resume_id") -> DataFrame:
    """Seconds from the first to the last event per record."""
    micros = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    return status_events.groupBy(key).agg(F.count("*").alias("n_events"), F.round(micros / 1e6, 3).alias("seconds"))


def step_times(durations: DataFrame) -> DataFrame:
    """(status, n, mean, median, p95) of the time spent in each step, exact.

    The mean comes from whole milliseconds, so it does not depend on row order.
    """
    rows = durations.filter(F.col("seconds").isNotNull()).withColumn(
        "_ms", F.round(F.col("seconds") * 1000, 0).cast("bigint")
    )
    counted = rows.groupBy("status", "_ms").agg(F.count("*").alias("_n"))  # feeds mean and quantiles
    means = counted.groupBy("status").agg(
        F.sum("_n").alias("n"), F.round(F.sum(F.col("_ms") * F.col("_n")) / F.sum("_n") / 1000, 3).alias("mean")
    )
    spread = exact_quantiles(counted, ["status"], "_ms", {"median": 0.5, "p95": 0.95}, weight="_n")
    return means.join(spread, "status", "inner").select(
        "status", "n", "mean",
        F.round(F.col("median") / 1000, 3).alias("median"), F.round(F.col("p95") / 1000, 3).alias("p95"),
    )


def waiting_steps(status_events: DataFrame, as_of: str, key: str = "resume_id") -> DataFrame:
    """(record, status, seconds, finished): whole seconds of every step, ended by the next event or still going on at ``as_of``.

    The last event of a record with a final status is no step.
    """
    steps = step_durations(status_events, key)
    spent = F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6)
    ended = F.col("seconds").isNotNull()
    return steps.where(ended | ~F.col("status").isin(*rules.TERMINAL_STATUSES)).select(
        key, "status", F.when(ended, F.floor("seconds")).otherwise(spent).cast("bigint").alias("seconds"), ended.alias("finished"))


def step_survival(steps: DataFrame) -> DataFrame:
    """(status, seconds, ended, at_risk, survival): the share of steps that last longer, by the product-limit estimator.

    Steps still going on count among those at risk as long as they have been watched. Equal waiting times are counted first, and running sums are taken in
    slices, so a status that holds most steps is in no single task.
    """
    counts = steps.groupBy("status", "seconds").agg(F.count_if("finished").alias("ended"), F.count("*").alias("_n"))
    places = value_positions(counts, ["status"], "seconds", weight="_n").select("status", "seconds", (F.col("total") - F.col("below")).alias("at_risk"))
    known = counts.join(places, ["status", "seconds"], "inner")
    left = 1 - F.col("ended") / F.col("at_risk")
    known = known.withColumn("_term", F.when(left > 0, F.ln(left)).otherwise(F.lit(-50.0)))
    summed = running_sum(known, ["status"], "seconds", "_term", "_sum")
    return summed.select("status", "seconds", "ended", "at_risk", F.round(F.exp("_sum"), 6).alias("survival"))


#: Shares of steps that times are kept for: one in so many.
_SHARES = 1000


def time_remaining(steps: DataFrame, survival: DataFrame, key: str = "resume_id") -> DataFrame:
    """(record, status, spent, remaining) of the steps still going on: seconds until half of the steps that lasted as long are over.

    Null where fewer than half of those have ever ended. Per status the survival curve is kept at ``_SHARES`` points.
    """
    points = survival.groupBy("status", F.ceil(F.col("survival") * _SHARES).cast("int").alias("_share")).agg(F.min("seconds").alias("_until"))
    grid = points.select("status").distinct().select("status", F.explode(F.sequence(F.lit(0), F.lit(_SHARES))).alias("_share"))
    upward = Window.partitionBy("status").orderBy("_share")  # a thousand rows a status
    curve = grid.join(points, ["status", "_share"], "left").select("status", "_share", F.last("_until", ignorenulls=True).over(upward).alias("_until"))
    open_ = steps.where(~F.col("finished")).join(survival.select("status", "seconds", "survival"), ["status", "seconds"], "inner")
    half = F.floor(F.col("survival") * (_SHARES // 2)).cast("int")
    found = open_.withColumn("_share", half).join(curve, ["status", "_share"], "left")
    return found.select(key, "status", F.col("seconds").alias("spent"), (F.col("_until") - F.col("seconds")).alias("remaining"))


def quota_audit(events: DataFrame, key: str = "user_id", limit: int = rules.REQUESTS_PER_HOUR) -> DataFrame:
    """(key, hour, n): clock hours in which a key made more than ``limit`` requests.

    On a stream set a watermark on ``ts`` first.
    """
    hour = F.window("ts", "1 hour")
    return (
        events.groupBy(hour, key).agg(F.count("*").alias("n")).filter(F.col("n") > limit)
        .select(key, F.col("window.start").alias("hour"), "n")
    )


def stuck_records(status_events: DataFrame, as_of: str, seconds: int = rules.STUCK_AFTER_SECONDS,
                  key: str = "resume_id") -> DataFrame:
    """Records whose latest status is not final and which started longer ago than allowed."""
    order = F.struct("ts", "event_id")
    state = status_events.groupBy(key).agg(
        F.max_by("status", order).alias("status"),
        F.max(F.when(F.col("status") == rules.PROCESSING, F.col("ts"))).alias("_start"), F.min("ts").alias("_first"),
    )
    started = F.coalesce("_start", "_first")
    micros = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(started.cast("timestamp"))
    waiting = F.floor(micros / 1e6).cast("bigint")
    return (
        state.withColumn("waiting_seconds", waiting)
        .filter(~F.col("status").isin(*rules.TERMINAL_STATUSES) & (F.col("waiting_seconds") > seconds))
        .select(key, "status", "waiting_seconds")
    )
