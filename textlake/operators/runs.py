"""Run logs as time series: merging, down-sampling, alerts, summaries, lineage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.operators.mixture import running_total

#: Parts of a run of which each gives its last rows.
TAIL_PARTS = 32


def finite(c: Column | str) -> Column:
    """A number, or null where it is missing, NaN or infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def number(c: Column) -> Column:
    """A number from text with thousands separators, or null."""
    return F.trim(F.regexp_replace(c, ",", "")).try_cast("double")


def first_truthy(*cols: Column) -> Column:
    """The first value that is neither null nor zero: the fallback chains of the logs."""
    return F.coalesce(*(F.nullif(c, F.lit(0)) for c in cols))


def merge_logs(own: DataFrame, ancestors: DataFrame, order: str = "log_id") -> DataFrame:
    """One row per (run_id, step).

    ancestors has depth (1 the nearest; greater is earlier). Precedence: own heartbeats, own evals, then of the ancestors the first eval in order
    from the earliest run; a heartbeat of an ancestor stands only where no eval does, the latest one. Rows without a step pass unmerged.
    """
    hb = lambda: F.col("status_source") == "heartbeat"
    a = own.withColumns({"_p": F.when(hb(), 0).otherwise(1), "_k": -F.col(order)}).withColumn("_d", F.lit(0))
    b = ancestors.withColumn("_d", -F.col("depth")).withColumns({"_p": F.when(hb(), 3).otherwise(2), "_k": F.when(hb(), -F.col(order)).otherwise(F.col(order))}).withColumn("_d", F.when(hb(), -F.col("_d")).otherwise(F.col("_d"))).drop("depth")
    every = a.unionByName(b, allowMissingColumns=True)
    cols = [c for c in own.columns if c not in ("run_id", "step")]
    best = every.where("step is not null").groupBy("run_id", "step").agg(F.min_by(F.struct(*cols), F.struct("_p", "_d", "_k")).alias("x")).select("run_id", "step", "x.*")
    return best.unionByName(own.where("step is null").select("run_id", "step", *cols))


def latest_per_step(log: DataFrame) -> DataFrame:
    """One row per (run_id, step): heartbeats over evals, then the largest log_id."""
    cols = [c for c in log.columns if c not in ("run_id", "step")]
    return log.where("step is not null").groupBy("run_id", "step").agg(F.max_by(F.struct(*cols), F.struct((F.col("status_source") == "heartbeat").cast("int"), "log_id")).alias("x")).select("run_id", "step", "x.*")


def history_import(log: DataFrame, source_order: str) -> DataFrame:
    """One row per (step, tokens_seen): of the last source."""
    cols = [c for c in log.columns if c not in ("step", "tokens_seen")]
    return log.groupBy("step", "tokens_seen").agg(F.max_by(F.struct(*cols), source_order).alias("x")).select("step", "tokens_seen", "x.*")


#: A run of at least this many rows is cut into PARTS ranges of its steps, each with the rows its frames reach back to.
SPLIT_ROWS = 200_000
PARTS = 64


def with_halos(log: DataFrame, rows: int, by: str = "run_id", order: str = "step", tie: str = "log_id", split_rows: int = SPLIT_ROWS, parts: int = PARTS) -> DataFrame:
    """log cut so that frames of the `rows` rows before can be computed part by part: adds _part, and _halo rows that only serve as those before.

    A hot run is sorted in `parts` tasks instead of one. Each part gets the last `rows` rows of all earlier parts of its run, taken from the tails of
    the parts, so the frames are exact whatever the sizes of the parts.
    """
    borders = log.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(order, [i / parts for i in range(1, parts)], 20 * parts).alias("_b"))
    borders = borders.select(F.col(by).alias("_by"), F.when(F.col("_n") >= split_rows, F.array_distinct("_b")).otherwise(F.array().cast("array<bigint>")).alias("_b"))
    d = log.join(F.broadcast(borders), log[by].eqNullSafe(borders["_by"])).withColumn("_part", F.coalesce(F.size(F.filter("_b", lambda x: x < F.col(order))), F.lit(0))).drop("_by", "_b")
    back = [F.desc(order), F.desc(tie)]
    tails = d.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_part").orderBy(*back))).where(F.col("_r") <= rows).drop("_r")
    later = d.where(F.col("_part") > 0).select(F.col(by).alias("_by"), F.col("_part").alias("_q")).distinct()
    reach = tails.join(F.broadcast(later), tails[by].eqNullSafe(later["_by"]) & (F.col("_part") < F.col("_q"))).withColumn("_part", F.col("_q")).drop("_by", "_q")
    halo = reach.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_part").orderBy(*back))).where(F.col("_r") <= rows).drop("_r")
    return d.withColumn("_halo", F.lit(False)).unionByName(halo.withColumn("_halo", F.lit(True)))


def _frame(rows: int, by: str = "run_id", order: tuple[str, ...] = ("step", "log_id")):
    return Window.partitionBy(by, "_part").orderBy(*order).rowsBetween(-rows, -1)


def _own(d: DataFrame) -> DataFrame:
    return d.where("not _halo").drop("_part", "_halo")


def loss_spikes(log: DataFrame, window: int = 20, min_delta: float = 0.5, sigma: float = 4.0, ratio: float = 1.15, by: str = "run_id", split_rows: int = SPLIT_ROWS) -> DataFrame:
    """log's rows of a finite train_loss with rolling_mean, rolling_stdev, threshold and is_spike: above mean + max(min_delta, sigma sd) and above
    mean x ratio of the `window` rows before, which must all be there. Rows need a step."""
    d = with_halos(log.withColumn("loss", finite("train_loss")).where("loss is not null"), window, by, split_rows=split_rows)
    w = _frame(window, by)
    d = d.withColumns({"rolling_mean": F.avg("loss").over(w), "rolling_stdev": F.stddev_pop("loss").over(w), "_n": F.count("loss").over(w)})
    d = d.withColumn("threshold", F.col("rolling_mean") + F.greatest(F.lit(min_delta), F.lit(sigma) * F.col("rolling_stdev")))
    return _own(d.withColumn("is_spike", (F.col("_n") == window) & (F.col("loss") > F.col("threshold")) & (F.col("loss") > F.col("rolling_mean") * ratio)).drop("_n"))


def median_spikes(log: DataFrame, window: int = 20, least: int = 10, factor: float = 1.5, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """As loss_spikes, against the median of up to `window` rows before, of which at least `least` (5 to 10) must be there."""
    least = max(5, min(least, 10))
    d = with_halos(log.withColumn("loss", finite("train_loss")).where("loss is not null"), window, split_rows=split_rows)
    w = _frame(window)
    d = d.withColumns({"baseline": F.percentile("loss", F.lit(0.5)).over(w), "_n": F.count("loss").over(w)})
    return _own(d.withColumn("is_spike", (F.col("_n") >= least) & (F.col("baseline") > 0) & (F.col("loss") > F.col("baseline") * factor)).drop("_n"))


def throughput_drops(log: DataFrame, window: int = 20, ratio: float = 0.55, after_step: int = 1400, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Rows with recent_median of tokens_per_second over the rows before (positive finite ones) and is_drop: below ratio x median past after_step."""
    d = with_halos(log.withColumn("speed", finite("tokens_per_second")), window, split_rows=split_rows)
    good = F.when(F.col("speed") > 0, F.col("speed"))
    d = d.withColumn("recent_median", F.percentile(good, F.lit(0.5)).over(_frame(window)))
    return _own(d.withColumn("is_drop", F.coalesce((F.col("step") > after_step) & (F.col("speed") < F.col("recent_median") * ratio), F.lit(False))))


def downsample(log: DataFrame, points: int, by: str = "run_id", order: tuple[str, ...] = ("step", "log_id")) -> DataFrame:
    """At most `points` rows of each run at even places, the first and the last among them; places are rounded half to even."""
    if points <= 0:
        return log.limit(0)
    # Places come from running totals over ranges of the order, so a run that holds a third of all rows is not sorted in one task.
    n = log.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(by, "_by")
    d = running_total(log, [by], order[0], F.lit(1), "_i", tie=order[1])
    d = d.join(n, d[by].eqNullSafe(n["_by"])).drop("_by")
    if points == 1:
        return d.where(F.col("_i") == F.col("_n") - 1).drop("_i", "_n")
    step = (F.col("_n") - 1) / F.lit(points - 1)
    # The point whose place this row could be is one of two neighbours.
    k = F.floor(F.col("_i") / step)
    at = lambda j: F.bround(j * (F.col("_n") - 1) / F.lit(points - 1))
    return d.where((F.col("_n") <= points) | (at(k) == F.col("_i")) | (at(k + 1) == F.col("_i")) | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")


def tail(log: DataFrame, n: int, by: str = "run_id") -> DataFrame:
    """The last n rows of each run, at most 5000."""
    n, last = min(n, 5000), [F.desc("step"), F.desc("log_id")]
    # First the last n of each of some parts of a run, then of those: no task sorts a whole run.
    d = log.withColumn("_salt", F.pmod(F.xxhash64("step", "log_id"), F.lit(TAIL_PARTS)))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_salt").orderBy(*last))).where(F.col("_r") <= n)
    return d.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*last))).where(F.col("_r") <= n).drop("_r", "_salt")


def run_summary(log: DataFrame) -> DataFrame:
    """Per run: rows, first and last step, first and last finite loss, best val_loss and its step, mean throughput, tokens, seconds."""
    loss, val, speed = finite("train_loss"), finite("val_loss"), finite("tokens_per_second")
    at = F.struct("step", "log_id")
    d = log.withColumns({"_loss": loss, "_val": val, "_speed": speed})
    return d.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("step").alias("first_step"), F.max("step").alias("last_step"),
        F.min_by("_loss", F.when(F.col("_loss").isNotNull(), at)).alias("first_loss"), F.max_by("_loss", F.when(F.col("_loss").isNotNull(), at)).alias("last_loss"),
        F.count("_loss").alias("losses"), F.min("_val").alias("best_val_loss"), F.min_by("step", F.when(F.col("_val").isNotNull(), F.struct("_val", "step"))).alias("best_step"),
        F.avg("_speed").alias("mean_tokens_per_second"), F.max("tokens_seen").alias("tokens_seen"), F.max(finite("elapsed_sec")).alias("elapsed_sec"),
    )


def diagnosis(summary: DataFrame, flat: float = 0.02) -> DataFrame:
    """summary with loss_delta (null below two losses) and diagnosis."""
    delta = F.when(F.col("losses") >= 2, F.col("last_loss") - F.col("first_loss"))
    word = F.when(delta.isNull(), "not enough data").when(delta < -flat, "improving").when(delta > flat, "worsening").otherwise("flat")
    return summary.withColumn("loss_delta", delta).withColumn("diagnosis", word)


def estimates(summary: DataFrame, parameters: Column) -> DataFrame:
    """6 P flops a token: teraflops at the mean speed, petaflops in all, tokens per parameter. parameters null or 0 gives nulls."""
    p = F.nullif(parameters, F.lit(0))
    return summary.withColumns({"tflops": F.round(6.0 * p * F.col("mean_tokens_per_second") / 1e12, 6), "total_pflops": F.round(6.0 * p * F.col("tokens_seen") / 1e15, 4), "tokens_per_parameter": F.round(F.col("tokens_seen") / p, 6)})


def state(state_: Column, age_seconds: Column, has_final: Column, stale: int = 900) -> Column:
    """The state of a run: 'completed' where a final text exists, 'stale' where it claims to run and has been silent for longer than stale."""
    return F.when(has_final, "completed").when((state_ == "running") & (age_seconds > stale), "stale").otherwise(F.coalesce(state_, F.lit("unknown")))


def progress(step: Column, local_step: Column, max_steps: Column, tokens_per_step: Column, elapsed: Column) -> Column:
    """STRUCT run_tokens, tokens_per_second, eta_sec, percent."""
    steps = local_step + 1
    return F.struct((steps * tokens_per_step).alias("run_tokens"), (steps * tokens_per_step / F.greatest(elapsed, F.lit(1e-9))).alias("tokens_per_second"), ((max_steps - local_step - 1) * elapsed / F.greatest(steps, F.lit(1))).alias("eta_sec"), F.round(100.0 * steps / F.greatest(max_steps, F.lit(1)), 2).alias("percent"))


def learning_rate(step: Column, schedule: str, peak: float, floor: float = 0.0, warmup: int = 0, warmup_from: float = 0.0, decay: int = 1, ramp_start: int = 0) -> Column:
    """The rate at a step: constant, linear, cosine, warmup_linear, warmup_cosine, resume_ramp_cosine (warmup is then the length of the ramp)."""
    s = step.cast("double")

    def linear(x: Column, a: float, b: float, n: int) -> Column:
        return F.lit(a) + F.least(F.greatest(x, F.lit(0.0)), F.lit(float(n))) * ((b - a) / n)

    def cosine(x: Column, n: int) -> Column:
        t = F.least(F.greatest(x, F.lit(0.0)), F.lit(float(n)))
        return F.lit(floor) + 0.5 * (peak - floor) * (1 + F.cos(F.lit(math.pi) * t / n))

    decay = max(1, decay)
    if schedule == "constant":
        return F.lit(peak) + 0 * s
    if schedule == "linear" or schedule == "warmup_linear" and warmup < 1:
        return linear(s, peak, floor, decay)
    if schedule == "cosine" or schedule in ("warmup_cosine", "resume_ramp_cosine") and warmup < 1:
        return cosine(s, decay)
    rest = max(1, decay - warmup - (ramp_start if schedule == "resume_ramp_cosine" else 0))
    if schedule == "warmup_linear":
        return F.when(s < warmup, linear(s, warmup_from, peak, warmup)).otherwise(linear(s - warmup, peak, floor, rest))
    if schedule == "warmup_cosine":
        return F.when(s < warmup, linear(s, warmup_from, peak, warmup)).otherwise(cosine(s - warmup, rest))
    if schedule == "resume_ramp_cosine":
        return F.when(s < ramp_start + warmup, linear(s - ramp_start, warmup_from, peak, warmup)).otherwise(cosine(s - ramp_start - warmup, rest))
    raise ValueError(f"unsupported schedule: {schedule}")


def alerts(status: DataFrame, status_stale: int = 900, status_slow: int = 300, heartbeat_stale: int = 900, grace: float = 2.0) -> DataFrame:
    """(run_id, key, severity) from one status row per run.

    status: run_id, state, step, local_step, status_age, heartbeat_age, heartbeat_interval, eval_interval, checkpoint_interval, last_eval_step,
    checkpoint_step, train_loss, val_loss, learning_rate. Nulls mean missing; an age is null where the file is not there.
    """
    c = F.col
    rules = [
        ("status_missing", "critical", c("status_age").isNull()),
        ("status_stale", "critical", c("status_age") > status_stale),
        ("status_slow", "warning", (c("status_age") > status_slow) & (c("status_age") <= status_stale)),
        ("heartbeat_missing", "warning", (c("heartbeat_interval") > 0) & c("heartbeat_age").isNull()),
        ("heartbeat_stale", "critical", (c("heartbeat_interval") > 0) & (c("heartbeat_age") > heartbeat_stale)),
        ("unexpected_state", "warning", ~F.coalesce(c("state").isin("running", "completed", "stopped"), F.lit(False))),
        ("train_loss_missing_or_nonfinite", "critical", finite("train_loss").isNull()),
        ("val_loss_nonfinite", "critical", c("val_loss").isNotNull() & finite("val_loss").isNull()),
        ("learning_rate_missing", "warning", finite("learning_rate").isNull()),
        ("eval_stale_by_step", "warning", (c("eval_interval") > 0) & (c("step") - c("last_eval_step") > c("eval_interval") * grace)),
        ("eval_missing", "warning", (c("eval_interval") > 0) & (c("step") >= 0) & c("last_eval_step").isNull()),
        ("checkpoint_stale_by_step", "warning", (c("checkpoint_interval") > 0) & (c("local_step") >= 0) & (c("step") + 1 - c("checkpoint_step") > c("checkpoint_interval") * grace)),
        ("checkpoint_missing", "warning", (c("checkpoint_interval") > 0) & c("checkpoint_step").isNull() & (c("local_step") > c("checkpoint_interval") * grace)),
    ]
    hits = F.array(*(F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(k).alias("key"), F.lit(s).alias("severity"))) for k, s, t in rules))
    return status.select("run_id", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("a")).select("run_id", "a.key", "a.severity")


def alert_changes(before: DataFrame, now: DataFrame, keys: tuple[str, ...] = ("run_id", "key")) -> DataFrame:
    """(keys, change): what opened and what was resolved between two sets of alerts."""
    a, b = before.select(*keys).distinct(), now.select(*keys).distinct()
    return b.join(a, list(keys), "left_anti").withColumn("change", F.lit("opened")).unionByName(a.join(b, list(keys), "left_anti").withColumn("change", F.lit("resolved")))


def lineage(parents: DataFrame, depth: int = 16) -> DataFrame:
    """(run_id, ancestor, depth) along parent links (run_id, parent_id), up to `depth` steps; a cycle ends where it would repeat a run."""
    spark = parents.sparkSession
    view = "textlake_parents"
    parents.select("run_id", "parent_id").where("parent_id is not null").createOrReplaceTempView(view)
    return spark.sql(f"""
        with recursive up(run_id, ancestor, depth, path) as (
            select run_id, parent_id, 1, array(run_id, parent_id) from {view} where run_id <> parent_id
            union all
            select u.run_id, p.parent_id, u.depth + 1, array_append(u.path, p.parent_id) from up u join {view} p on p.run_id = u.ancestor
            where u.depth < {depth} and not array_contains(u.path, p.parent_id)
        ) select run_id, ancestor, depth from up""")


def against_baseline(rows: DataFrame, key: str, baseline: str, measures: list[str]) -> DataFrame:
    """rows with <measure>_delta to the one baseline row."""
    b = rows.where(F.col(key) == baseline).limit(1).select(*(F.col(m).alias(f"_b_{m}") for m in measures))
    return rows.join(F.broadcast(b), how="left").withColumns({f"{m}_delta": F.col(m) - F.col(f"_b_{m}") for m in measures}).drop(*(f"_b_{m}" for m in measures))


def best_runs(summary: DataFrame) -> DataFrame:
    """One row: the run of the best loss, the fastest run, the run of the best loss per speed."""
    ratio = F.col("best_val_loss") / F.nullif("mean_tokens_per_second", F.lit(0.0))
    by = lambda f, c: f("run_id", F.when(c.isNotNull(), F.struct(c.alias("v"), "run_id")))
    return summary.agg(by(F.min_by, F.col("best_val_loss")).alias("best_loss_run"), F.max_by("run_id", F.when(F.col("mean_tokens_per_second").isNotNull(), F.col("mean_tokens_per_second"))).alias("fastest_run"), by(F.min_by, ratio).alias("best_ratio_run"))


def experiments(summary: DataFrame) -> DataFrame:
    """summary with overfit_gap: the best val_loss less the last train loss."""
    return summary.withColumn("overfit_gap", F.col("best_val_loss") - F.col("last_loss"))


def per_hundred_million(summary: DataFrame, parameters: Column) -> DataFrame:
    """summary with throughput times parameters in hundreds of millions: what the size of the model takes away is put back."""
    return summary.withColumn("normalized_speed", F.col("mean_tokens_per_second") * parameters / 1e8)


def step_benchmark(log: DataFrame, skip: int = 0) -> DataFrame:
    """(run_id, steps, tokens, seconds, tokens_per_second, mean_step, min_step, max_step) from the gaps between a run's rows, the first `skip` left out.

    A gap is the time since the row before, over the steps since; gaps that are not positive are left out.
    """
    w = Window.partitionBy("run_id").orderBy("step", "log_id")
    d = log.withColumn("_sec", finite("elapsed_sec")).where("_sec is not null and step is not null")
    d = d.withColumns({"_ds": F.col("_sec") - F.lag("_sec").over(w), "_dn": F.col("step") - F.lag("step").over(w), "_dt": F.col("tokens_seen") - F.lag("tokens_seen").over(w), "_i": F.row_number().over(w)})
    d = d.where((F.col("_i") > skip + 1) & (F.col("_ds") > 0) & (F.col("_dn") > 0)).withColumn("_step", F.col("_ds") / F.col("_dn"))
    return d.groupBy("run_id").agg(F.sum("_dn").alias("steps"), F.sum("_dt").alias("tokens"), F.sum("_ds").alias("seconds"), (F.sum("_dt") / F.sum("_ds")).alias("tokens_per_second"), F.avg("_step").alias("mean_step"), F.min("_step").alias("min_step"), F.max("_step").alias("max_step"))


def vocabulary_sizes(rows: DataFrame, baseline: int = 32_768, width: int = 640) -> DataFrame:
    """rows (vocab_size, tokens) with token_increase and parameter_saving (embedding rows x width) against the baseline size."""
    b = rows.where(F.col("vocab_size") == baseline).limit(1).select(F.col("tokens").alias("_b"))
    return rows.join(F.broadcast(b), how="left").withColumns({"token_increase": F.round(F.col("tokens") / F.col("_b") - 1, 6), "parameter_saving": (F.lit(baseline) - F.col("vocab_size")) * width}).drop("_b")
