"""Scores of extracted records against values read by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.functions import scalars as S
from retentia.operators.matching import text_match
from retentia.operators.resolve import by_row

# Evaluated field -> (column of the annotations, columns of the records); fields without record columns are never found.
SCORED = {
    "polymer_names": ("polymer_names", ("analyte_polymer", "critical_component")),
    "detectors": ("detectors", ()),
    "stationary_phase": ("stationary_phase", ("column_name", "stationary_phase_chemistry")),
    "solvents_mobile_phase": ("solvents", ("mobile_phase_solvents",)),
    "temperature": ("temperature", ("temperature_celsius",)),
    "flow_rate": ("flow_rate", ()),
    "critical_range": ("critical_range", ()),
}


def field_scores(records: DataFrame, annotations: DataFrame, ratio: float = 0.78) -> DataFrame:
    """(paper_id, field, status, coverage, matched, expected): exact all found, partial some, missing none, out_of_scope nothing expected.

    Candidates of a paper are its distinct normalised values; no paper's values are gathered into one row.
    """
    values = []
    for field, (_, cols) in SCORED.items():
        for c in cols:
            arr = F.transform(c, S.normalize_text) if c == "mobile_phase_solvents" else F.array(S.normalize_text(F.col(c)))
            values.append(F.struct(F.lit(field).alias("field"), arr.alias("v")))
    long = records.select("paper_id", F.explode(F.array(*values)).alias("x")).select("paper_id", "x.field", F.explode("x.v").alias("v")).where("v is not null and v <> ''")
    wanted = []
    for field, (c, _) in SCORED.items():
        multi = c in ("polymer_names", "solvents", "detectors")
        wanted.append(F.struct(F.lit(field).alias("field"), (F.transform(c, S.normalize_text) if multi else F.array(S.normalize_text(F.col(c)))).alias("e")))
    gt = annotations.where("reference is not null").select(F.col("reference").alias("paper_id"), F.explode(F.array(*wanted)).alias("x")).select("paper_id", "x.field", F.filter("x.e", lambda v: v.isNotNull() & (v != "")).alias("e"))
    wanted = gt.withColumn("e", F.coalesce("e", F.array().cast("array<string>")))
    # candidates stay rows: each meets the few expected values of its paper and field, hits are united afterwards
    pairs = long.distinct().join(wanted.where(F.size("e") > 0), ["paper_id", "field"])

    def hits(r: dict) -> list[dict]:
        return [{"paper_id": r["paper_id"], "field": r["field"], "k": k} for k, e in enumerate(r["e"]) if text_match(e, r["v"], ratio)]

    matched = by_row(pairs, hits, "paper_id string, field string, k int").distinct().groupBy("paper_id", "field").agg(F.count("*").cast("int").alias("m"))
    n, m = F.size("e"), F.coalesce("m", F.lit(0))
    status = F.when(n == 0, "out_of_scope").when(m == n, "exact").when(m > 0, "partial").otherwise("missing")
    coverage = F.when(n == 0, 0.0).otherwise(F.round(m / F.nullif(n, F.lit(0)), 4))
    return wanted.join(matched, ["paper_id", "field"], "left").select("paper_id", "field", status.alias("status"), coverage.alias("coverage"), m.alias("matched"), n.alias("expected"))


def paper_scores(scores: DataFrame) -> DataFrame:
    """(paper_id, score): 1 for exact, a half for partial, over the fields in scope; 0 without any."""
    points = F.when(F.col("status") == "exact", 1.0).when(F.col("status") == "partial", 0.5).otherwise(0.0)
    scope = F.when(F.col("status") != "out_of_scope", 1)
    return scores.groupBy("paper_id").agg(F.round(F.coalesce(F.sum(F.when(scope == 1, points)) / F.nullif(F.count(scope), F.lit(0)), F.lit(0.0)), 4).alias("score"))


def summary(scores: DataFrame) -> DataFrame:
    """(status, n, mean_score): fields by status beside the mean score of the papers."""
    mean = paper_scores(scores).agg(F.round(F.avg("score"), 4).alias("mean_score"))
    return scores.groupBy("status").agg(F.count("*").alias("n")).join(F.broadcast(mean), F.lit(True))  # one row


def by_paper_name(annotations: DataFrame, names: DataFrame) -> DataFrame:
    """Annotations under the papers' own names: `names` (reference, paper_id) says which paper a reference means; one it does not know is a name itself."""
    known = names.where("reference is not null").groupBy("reference").agg(F.min("paper_id").alias("_paper"))
    return annotations.join(known, "reference", "left").withColumn("reference", F.coalesce("_paper", "reference")).drop("_paper")
