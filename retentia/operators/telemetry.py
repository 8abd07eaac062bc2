"""Run telemetry: sums over call logs, rates, running counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_mb(c: Column) -> Column:
    return F.when(F.upper(F.trim(c)) != "N/A", c.try_cast("double"))


def gpu_delta(before: Column, after: Column) -> Column:
    """Memory after less memory before, in MB; null unless both can be read."""
    return parse_mb(after) - parse_mb(before)


def wall_time(c: Column) -> Column:
    """A written time as a timestamp, with or without fractions and a zone (none means that of the session); null where it cannot be read."""
    text = F.regexp_replace(F.trim(c), r"^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)$", "$1T$2")
    return F.coalesce(text.try_cast("timestamp"), *[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in ("dd.MM.yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyyMMdd_HHmmss")])


def durations(telemetry: DataFrame) -> DataFrame:
    """Adds the times as timestamps and the seconds between them."""
    t = telemetry.withColumns({"started_at": wall_time(F.col("wall_start")), "ended_at": wall_time(F.col("wall_end"))})
    return t.withColumn("seconds", (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1e6)


def call_sums(telemetry: DataFrame) -> DataFrame:
    """(model, phase, calls by type, tokens, successes) from the nested call logs; exact replays of a row count once."""
    calls = telemetry.distinct().select("model", "phase", F.explode("call_log").alias("c"))
    return calls.groupBy("model", "phase").agg(
        F.count("*").alias("n_calls"), F.sum(F.when(F.col("c.call_type") == "initial", 1).otherwise(0)).alias("initial_calls"), F.sum(F.when(F.col("c.call_type") == "retry", 1).otherwise(0)).alias("retry_calls"),
        F.sum("c.input_tokens").alias("input_tokens"), F.sum("c.output_tokens").alias("output_tokens"), F.sum(F.when(F.col("c.success"), 1).otherwise(0)).alias("n_ok"),
    )


def rates(telemetry: DataFrame) -> DataFrame:
    """(paper_name, model, phase, wall_start, conditions_per_minute, tokens_per_second): only where the duration is positive."""
    d = F.col("wall_duration_s")
    return telemetry.where(d > 0).select("paper_name", "model", "phase", "wall_start", F.round(F.col("conditions_extracted") * 60.0 / d, 2).alias("conditions_per_minute"), F.round(F.col("total_output_tokens") / d, 2).alias("tokens_per_second"))


def model_rollup(telemetry: DataFrame) -> DataFrame:
    """(model, runs, seconds, conditions, tokens) per model with ratio-of-sums rates; seconds are summed as decimals, in any order the same."""
    t = telemetry.distinct()
    g = t.groupBy("model").agg(F.count("*").alias("n_runs"), F.sum(F.col("wall_duration_s").cast("decimal(18,6)")).alias("s"), F.sum("conditions_extracted").alias("n_conditions"), F.sum("total_output_tokens").alias("n_tokens"), F.sum(F.when(F.col("success"), 1).otherwise(0)).alias("n_ok"))
    return g.select("model", "n_runs", "n_conditions", "n_tokens", "n_ok", F.round(F.col("s"), 2).cast("double").alias("seconds"), F.round(F.col("n_tokens") / F.nullif(F.col("s").cast("double"), F.lit(0.0)), 4).alias("tokens_per_second"))


def running_tokens(telemetry: DataFrame) -> DataFrame:
    """(paper_name, model, phase, wall_start, call_no, running_output): counters after every call of a run, inside its log."""
    t = telemetry.select("paper_name", "model", "phase", "wall_start", F.posexplode("call_log").alias("k", "c")).distinct()
    w = Window.partitionBy("paper_name", "model", "phase", "wall_start").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return t.select("paper_name", "model", "phase", "wall_start", (F.col("k") + 1).alias("call_no"), F.sum("c.output_tokens").over(w).alias("running_output"))


def performance_log(telemetry: DataFrame, records: DataFrame, first: str, second: str) -> DataFrame:
    """(paper, seconds and chunks of either extractor, whether a consensus exists)."""
    side = lambda m, n: telemetry.where((F.col("model") == m) & (F.col("phase") == "extraction")).groupBy(F.col("paper_name").alias("paper")).agg(F.max("wall_duration_s").alias(f"{n}_seconds"), F.max("num_chunks").alias(f"{n}_chunks"))
    done = records.where("model = 'consensus'").select(F.col("paper_id").alias("paper")).distinct().withColumn("there", F.lit(1))
    return side(first, "first").join(side(second, "second"), "paper", "left").join(done, "paper", "left").select("paper", "first_seconds", "first_chunks", "second_seconds", "second_chunks", F.col("there").isNotNull().alias("has_consensus"))
