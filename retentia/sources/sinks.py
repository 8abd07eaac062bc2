"""Sinks: nested files, flat layouts, logs, reports. Nothing is written over what is being read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.operators import quality, standardize


def write_conditions(records: DataFrame, path: str, mode: str = "append") -> None:
    """Runs are appended; the latest one is a view, not a second copy."""
    records.write.mode(mode).partitionBy("subfolder").parquet(path)


def write_envelopes(records: DataFrame, path: str) -> None:
    """One JSON line per paper and extractor under its subfolder. The lists are those of one run, as in the files."""
    item = F.struct(*[c for c in records.columns if c not in ("subfolder", "paper_id", "model")])
    rows = records.groupBy("subfolder", "paper_id", "model", "run_ts").agg(F.array_sort(F.collect_list(item)).alias("conditions"))
    rows.select("subfolder", F.struct(F.col("paper_id").alias("source_pdf"), "model").alias("metadata"), F.struct(F.size("conditions").alias("total_conditions")).alias("summary"), F.struct("conditions").alias("extracted_data")).write.mode("error").partitionBy("subfolder").json(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("error").option("header", True).option("nullValue", "").option("emptyValue", "").option("quoteAll", False).option("escape", '"').csv(path)


def write_summary(records: DataFrame, path: str, one_file: bool = False) -> None:
    write_csv(standardize.summary_rows(records), path, one_file)


def write_standardized(records: DataFrame, path: str, one_file: bool = False) -> None:
    write_csv(standardize.standard_rows(standardize.standardize(records)), path, one_file)


def write_standardized_json(records: DataFrame, path: str) -> None:
    standardize.standardize(records).write.mode("error").partitionBy("subfolder").json(path)


def write_markdown(parsed: DataFrame, path: str) -> None:
    """Parsed documents by name; one row a document, not one file."""
    parsed.where("markdown is not null").select(F.regexp_extract("path", r"([^/]+?)(?:\.pdf)?$", 1).alias("paper"), "markdown").write.mode("append").parquet(path)


def append_log(telemetry: DataFrame, path: str) -> None:
    telemetry.write.mode("append").json(path)


def log_to_csv(log: DataFrame, path: str) -> None:
    write_csv(log.drop("call_log"), path, True)


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("error").json(f"{path}/json")
    write_csv(scores, f"{path}/csv", True)


# Header of the performance log.
PERFORMANCE_HEADER = ["Paper", "First Runtime (s)", "First Extraction Calls (Chunks)", "Second Runtime (s)", "Second Extraction Calls (Chunks)", "Consensus Generated"]


def write_performance_log(log: DataFrame, path: str) -> None:
    """The six columns of the performance log (operators.telemetry.performance_log) under their header."""
    write_csv(log.toDF(*PERFORMANCE_HEADER).orderBy("Paper"), path)


def write_master(records: DataFrame, path: str) -> None:
    """All papers' records of a set in one table by subfolder, with paper and extractor beside every record."""
    records.select("subfolder", "paper_id", "model", *[c for c in records.columns if c not in ("subfolder", "paper_id", "model")]).write.mode("error").partitionBy("subfolder").parquet(path)


def removed_rows(before: DataFrame, after: DataFrame, key: str = "record_id") -> DataFrame:
    """The rows of `before` that are no longer in `after`; rows without a key cannot be found again and count as removed."""
    return before.join(after.select(key).distinct(), key, "left_anti")


def rewrite_changed(before: DataFrame, after: DataFrame, path: str, key: str = "paper_id", dry_run: bool = False) -> DataFrame:
    """(key, removed): papers whose records became fewer; their remaining records are written to a new place unless it is a dry run."""
    b, a = before.groupBy(key).agg(F.count("*").alias("b")), after.groupBy(key).agg(F.count("*").alias("a"))
    changed = b.join(a, key, "left").select(key, (F.col("b") - F.coalesce("a", F.lit(0))).alias("removed")).where("removed > 0")
    if not dry_run:
        after.join(changed, key, "left_semi").write.mode("error").parquet(path)
    return changed


def markdown_report(records: DataFrame, title: str = "Record report") -> str:
    """A page of counts: only aggregates reach the driver."""
    lines = [f"# {title}", "", "| subfolder | extractor | records |", "|---|---|---|"]
    for r in quality.counts_rollup(records).orderBy(F.asc_nulls_last("subfolder"), F.asc_nulls_last("model")).collect():
        lines.append(f"| {r['subfolder'] or 'all'} | {r['model'] or 'all'} | {r['n']} |")
    lines += ["", "| agreement | records | share |", "|---|---|---|"]
    lines += [f"| {r['bucket']} | {r['n']} | {r['share']} % |" for r in quality.agreement(records).orderBy("bucket").collect()]
    return "\n".join(lines) + "\n"


def comparison_report(old: DataFrame, new: DataFrame, title: str = "Comparison") -> str:
    """Records per paper in two sets, largest change first: one line a paper that changed, and totals."""
    c = quality.compare_sets(old, new)
    n_old, n_new, n = c.agg(F.coalesce(F.sum("n_old"), F.lit(0)), F.coalesce(F.sum("n_new"), F.lit(0)), F.count("*")).first()
    lines = [f"# {title}", "", f"{n} papers, {n_old} records before, {n_new} after.", "", "| subfolder | paper | before | after | change |", "|---|---|---|---|---|"]
    for r in c.where("delta <> 0").orderBy(F.desc(F.abs("delta")), "subfolder", "paper_id").toLocalIterator():  # a page is read whole: one line a paper
        lines.append(f"| {r['subfolder']} | {r['paper_id']} | {r['n_old']} | {r['n_new']} | {r['delta']:+d} |")
    return "\n".join(lines) + "\n"


def quality_report(records: DataFrame, title: str = "Quality") -> str:
    """Findings of the audit, null rates and agreement: only aggregates reach the driver."""
    lines = [f"# {title}", "", "| check | found |", "|---|---|"]
    lines += [f"| {r['name']} | {r['n']} |" for r in quality.audit(records).orderBy("name").collect()]
    lines += ["", "| field | null | rows |", "|---|---|---|"]
    lines += [f"| {r['field']} | {r['n_null']} | {r['n_rows']} |" for r in quality.null_profile(records).orderBy(F.desc("n_null"), "field").collect()]
    lines += ["", "| agreement (strict) | records | share |", "|---|---|---|"]
    lines += [f"| {r['bucket']} | {r['n']} | {r['share']} % |" for r in quality.agreement(records, strict=True).orderBy("bucket").collect()]
    return "\n".join(lines) + "\n"


def detail_lines(records: DataFrame) -> DataFrame:
    """(record_id, line): one table row of the detail report per record."""
    nz = lambda c: F.nullif(F.col(c), F.lit(""))
    name = F.coalesce(nz("critical_component"), nz("analyte_polymer"), F.lit("N/A"))
    column = F.concat(F.coalesce(nz("column_name"), F.lit("N/A")), F.lit(" ("), F.coalesce(nz("stationary_phase_chemistry"), F.lit("N/A")), F.lit(")"))
    return records.select("record_id", F.concat_ws(" | ", name, column, F.coalesce(F.array_join("mobile_phase_solvents", "/"), F.lit("N/A")), F.coalesce(nz("mobile_phase_ratio"), F.lit("N/A"))).alias("line"))
