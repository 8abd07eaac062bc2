"""Entity resolution over extraction runs: order-dependent folds, one row per run or paper in, rows out.

A run is what one extractor said about one paper at one time; its record list is short, so the lists are built by one shuffle on the
run, the latest run of each extractor is chosen map-side, and each fold runs inside its row. A paper with a third of all rows is many
runs, of which the latest two or three meet.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from retentia.functions import scalars as S
from retentia.operators import matching as M

FIELDS = ("analyte_polymer", "critical_component", "architecture", "critical_condition_basis", "critical_condition_confidence", "column_name", "stationary_phase_chemistry", "column_mode", "mobile_phase_solvents", "mobile_phase_ratio", "mobile_phase_ratio_units", "temperature_celsius", "flow_rate", "pore_size", "detector", "field_evidence", "notes", "paper_doi", "corresponding_author_name", "corresponding_email_address", "physical_address", "publication_year")


def runs(records: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(paper_id, model, run_ts, items): the records of every run in their order, exact replays (same id) once."""
    item = F.struct("cond_idx", "record_id", *fields)
    return records.groupBy("paper_id", "model", "run_ts").agg(F.array_sort(F.collect_list(item), lambda a, b: F.when(a["cond_idx"] < b["cond_idx"], -1).when(a["cond_idx"] > b["cond_idx"], 1).when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)).alias("items"))


def latest_runs(records: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(paper_id, model, items): the last run of every extractor; one without a time counts as its earliest.

    The last times are found on three narrow columns; only the rows of those runs carry their fields into the shuffle.
    """
    last = records.groupBy("paper_id", "model").agg(F.max("run_ts").alias("run_ts")).select(*[F.col(c).alias(f"_{c}") for c in ("paper_id", "model", "run_ts")])
    same = F.lit(True)
    for c in ("paper_id", "model", "run_ts"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return runs(records.select("paper_id", "model", "run_ts", "cond_idx", "record_id", *fields).join(last, same, "left_semi"), fields).drop("run_ts")


def by_row(df: DataFrame, fn: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """Each row as a dict to any number of rows, over Arrow batches."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema)) if hasattr(T.StructType, "fromDDL") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([o for r in b.to_pylist() for o in fn(r)], schema=arrow)

    return df.mapInArrow(run, schema)


def dedup_runs(records: DataFrame) -> DataFrame:
    """(paper_id, model, record_id, n_merged, analyte_polymer, mobile_phase_ratio): records merged within each latest run."""

    def fold(r: dict) -> list[dict]:
        return [
            {"paper_id": r["paper_id"], "model": r["model"], "record_id": r["items"][p[0]]["record_id"], "n_merged": len(p), "analyte_polymer": m.get("analyte_polymer"), "mobile_phase_ratio": m.get("mobile_phase_ratio")}
            for p, m in M.fold_merge(r["items"])
        ]

    return by_row(latest_runs(records), fold, "paper_id string, model string, record_id bigint, n_merged int, analyte_polymer string, mobile_phase_ratio string")


def keep_first(records: DataFrame) -> DataFrame:
    """(paper_id, model, record_id): first record of every set-up in each latest run."""
    return by_row(latest_runs(records), lambda r: [{"paper_id": r["paper_id"], "model": r["model"], "record_id": r["items"][k]["record_id"]} for k in M.fold_keep_first(r["items"], M.chromatographic_match)], "paper_id string, model string, record_id bigint")


def absorb(records: DataFrame) -> DataFrame:
    """(paper_id, model, record_id): latest runs without the records that a more specific one covers."""
    return by_row(latest_runs(records), lambda r: [{"paper_id": r["paper_id"], "model": r["model"], "record_id": r["items"][k]["record_id"]} for k in M.fold_absorb(r["items"])], "paper_id string, model string, record_id bigint")


def sides(records: DataFrame, first: str, second: str) -> DataFrame:
    """(paper_id, a, b): latest runs of two extractors side by side, driven by the first; b is empty where it is silent."""
    latest = latest_runs(records).where(F.col("model").isin(first, second))
    side = lambda m: F.max_by(F.when(F.col("model") == m, F.col("items")), F.when(F.col("model") == m, 1))
    both = latest.groupBy("paper_id").agg(side(first).alias("a"), side(second).alias("b")).where("a is not null")
    return both.withColumn("b", F.coalesce("b", F.slice("a", 1, 0)))


def pair_up(records: DataFrame, first: str = "qwen-27b", second: str = "mistral-24b") -> DataFrame:
    """(paper_id, a_id, b_id): greedy one-to-one matches."""
    return by_row(sides(records, first, second), lambda r: [{"paper_id": r["paper_id"], "a_id": r["a"][i]["record_id"], "b_id": r["b"][j]["record_id"]} for i, j in M.bipartite(r["a"], r["b"])], "paper_id string, a_id bigint, b_id bigint")


def consensus(records: DataFrame, first: str = "qwen-27b", second: str = "mistral-24b", validate: Callable[[dict], bool] = lambda r: True, resolve: Callable | None = None) -> DataFrame:
    """Final records of every paper with the confidence of either extractor: dedup, match, merge, append, dedup, trace, absorb."""

    def fold(r: dict) -> list[dict]:
        a, b = ([m for _, m in M.fold_merge(x)] for x in (r["a"], r["b"]))
        done = M.consensus(a, b, validate, resolve)
        keep = M.fold_absorb([d[0] for d in done])
        return [{"paper_id": r["paper_id"], "pos": p, "record_id": done[k][0]["record_id"], "analyte_polymer": done[k][0].get("analyte_polymer"), "critical_component": done[k][0].get("critical_component"), "mobile_phase_ratio": done[k][0].get("mobile_phase_ratio"), "qwen": done[k][1], "mistral": done[k][2]} for p, k in enumerate(keep)]

    return by_row(sides(records, first, second), fold, "paper_id string, pos int, record_id bigint, analyte_polymer string, critical_component string, mobile_phase_ratio string, qwen string, mistral string")


def programmatic(records: DataFrame, order: tuple[str, ...] = ("consensus", "qwen-27b", "mistral-24b")) -> DataFrame:
    """(paper_id, pos, record_id, n_sources, n_records): all extractors in a fixed order, simulations left out, similar set-ups united, records without any polymer dropped."""
    rank = F.lit(len(order))
    for k, m in enumerate(order):
        rank = F.when(F.col("model") == m, k).otherwise(rank)
    real = records.where(~simulation(records))
    latest = latest_runs(real).groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "model", "items"))).alias("all"))

    def fold(r: dict) -> list[dict]:
        items = [{**i, "model": m["model"]} for m in r["all"] for i in m["items"]]
        groups = [(p, m) for p, m in M.fold_merge(items, M.similar_setups, M.merge_first) if m.get("analyte_polymer") or m.get("critical_component")]
        return [{"paper_id": r["paper_id"], "pos": k, "record_id": items[p[0]]["record_id"], "n_sources": len({items[x]["model"] for x in p}), "n_records": len(p)} for k, (p, _) in enumerate(groups)]

    return by_row(latest, fold, "paper_id string, pos int, record_id bigint, n_sources int, n_records int")


def simulation(records: DataFrame) -> Column:
    """Records that come from a simulation by their basis, notes or quoted text."""
    said = lambda c: F.coalesce(F.lower(c).contains("simulation"), F.lit(False))
    out = said(F.col("critical_condition_basis")) | said(F.col("notes"))
    return out | said(F.col("evidence_text")) if "evidence_text" in records.columns else out


def position_consistency(records: DataFrame, first: str = "qwen-27b", second: str = "mistral-24b") -> DataFrame:
    """(n_papers, n_consistent, consistent): papers whose consensus is the same multiset of records whichever extractor is asked first."""
    latest = latest_runs(records).where(F.col("model").isin(first, second))
    side = lambda m: F.max_by(F.when(F.col("model") == m, F.col("items")), F.when(F.col("model") == m, 1))
    both = latest.groupBy("paper_id").agg(side(first).alias("a"), side(second).alias("b"))
    said = lambda a, b: sorted(json.dumps({k: v for k, v in r.items() if k not in ("cond_idx", "record_id")}, sort_keys=True, default=str) for r, *_ in M.consensus(a, b))

    def fold(r: dict) -> list[dict]:
        a, b = ([m for _, m in M.fold_merge(x or [])] for x in (r["a"], r["b"]))
        return [{"same": int(said(a, b) == said(b, a))}]

    got = by_row(both, fold, "same int")
    return got.agg(F.count("*").alias("n_papers"), F.coalesce(F.sum("same"), F.lit(0)).alias("n_consistent"), F.round(F.coalesce(F.avg("same"), F.lit(0.0)), 6).alias("consistent"))


def native_fold(records: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """(paper_id, model, run_ts, kept): the keep-first fold with an all-native test (ratio and temperature within tolerance), inside the JVM."""
    num = F.struct("cond_idx", "record_id", S.ratio_number(F.col("mobile_phase_ratio")).alias("r"), S.first_number(F.col("temperature_celsius")).alias("t"))
    lists = records.groupBy("paper_id", "model", "run_ts").agg(F.array_sort(F.collect_list(num)).alias("items"))
    near = lambda x, y: F.coalesce(F.abs(x - y) <= tolerance, F.lit(True))
    empty = F.slice("items", 1, 0)
    kept = F.aggregate("items", empty, lambda acc, i: F.when(F.exists(acc, lambda k: near(k["r"], i["r"]) & near(k["t"], i["t"])), acc).otherwise(F.concat(acc, F.array(i))))
    return lists.select("paper_id", "model", "run_ts", F.array_join(F.transform(kept, lambda x: x["record_id"].cast("string")), ",").alias("kept"))
