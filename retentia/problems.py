"""Queries of the core data problems: units, load profiles, packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.common import table
from retentia.operators import profile as prof
from retentia.operators.splitting import split_packed
from retentia.operators.units import standardize_quantities

PROFILED = ["column_name", "detector", "paper_doi", "column_mode"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Quantities written in another unit than the standard one."""
    return standardize_quantities(table(spark, d, "records")).where("differs").select(F.col("row_id").alias("record_id"), "field", "std_value")


def p3_standardized(spark: SparkSession, d: str) -> DataFrame:
    """Every single quantity and basis in the common unit, with where its unit was found."""
    return standardize_quantities(table(spark, d, "records")).select(F.col("row_id").alias("record_id"), "field", "std_value", "unit_from")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Loads that depart from the others."""
    found = prof.departures(
        table(spark, d, "records"), "load_id", PROFILED, patterns={"paper_doi": prof.DOI}, shift_columns=("detector", "column_mode"), concentration_columns=("column_name", "paper_doi")
    )
    return found.select(F.col("load").alias("load_id"), "field", "departure")


def p4_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profile of every load and column."""
    p = prof.profile(table(spark, d, "records"), "load_id", PROFILED, patterns={"paper_doi": prof.DOI})
    ints = ["n_rows", "n_missing", "n_violations", "n_distinct", "min_length", "max_length", "length_s1", "length_s2"]
    shown = ["missing_shift", "violation_shift", "length_shift", "distance", "lead"]
    return p.select(F.col("load").alias("load_id"), "field", "min_value", "max_value", *[F.col(c).cast("bigint").alias(c) for c in ints], *[F.round(c, 6).alias(c) for c in shown])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per value of the fields that hold several."""
    return split_packed(table(spark, d, "records")).withColumnRenamed("row_id", "record_id")


QUERIES = {"p3_found": p3_found, "p3_standardized": p3_standardized, "p4_found": p4_found, "p4_profile": p4_profile, "p5_found": p5_found}

_LONG = """
long AS (
  SELECT load_id, u.field AS field, CASE WHEN u.v IS NULL OR lower(trim(u.v, E' \\t\\n\\r\\f\\x0b')) IN ('', 'null', 'none', 'n/a') THEN NULL ELSE trim(u.v, E' \\t\\n\\r\\f\\x0b') END AS raw
  FROM (SELECT load_id, unnest([{'field': 'column_name', 'v': column_name}, {'field': 'detector', 'v': detector}, {'field': 'paper_doi', 'v': paper_doi}, {'field': 'column_mode', 'v': column_mode}]) AS u FROM records))
"""
SQL = {
    "p4_found": f"""
WITH {_LONG},
base AS (SELECT load_id, field, count(*)::DOUBLE n, sum((raw IS NULL)::INT)::DOUBLE miss,
           sum((field = 'paper_doi' AND raw IS NOT NULL AND NOT regexp_matches(raw, '^10\\.[0-9]{{4,9}}/[^\\s]+$'))::INT)::DOUBLE bad FROM long GROUP BY 1, 2),
tot AS (SELECT field, sum(n) nn, sum(miss) mm, sum(bad) bb FROM base GROUP BY 1),
l AS (SELECT load_id, field, n, miss, bad, nn - n AS n2, mm - miss AS miss2, bb - bad AS bad2 FROM base JOIN tot USING (field) WHERE nn > n),
vc AS (SELECT load_id, field, lower(raw) v, count(*)::DOUBLE c FROM long WHERE raw IS NOT NULL GROUP BY 1, 2, 3),
vt AS (SELECT field, v, sum(c) t FROM vc GROUP BY 1, 2),
pairs AS (SELECT l.load_id, l.field, vt.v, coalesce(vc.c, 0) c, coalesce(vc.c, 0) / (l.n - l.miss) p, (vt.t - coalesce(vc.c, 0)) / (l.n2 - l.miss2) q, vt.t
          FROM l JOIN vt USING (field) LEFT JOIN vc ON vc.load_id = l.load_id AND vc.field = l.field AND vc.v = vt.v WHERE l.n > l.miss AND l.n2 > l.miss2 AND l.field IN ('detector', 'column_mode')),
tops AS (SELECT l.load_id, l.field, vc.c / (l.n - l.miss) p, (vt.t - vc.c) / (l.n2 - l.miss2) q, row_number() OVER (PARTITION BY l.load_id, l.field ORDER BY vc.c DESC, vt.t, vc.v DESC) rn
         FROM l JOIN vc USING (load_id, field) JOIN vt USING (field, v) WHERE l.n2 > l.miss2 AND l.field IN ('column_name', 'paper_doi'))
SELECT load_id, field, 'missing' departure FROM l WHERE miss / n - miss2 / n2 >= 0.25 - 1e-9
UNION ALL SELECT load_id, field, 'pattern' FROM l WHERE field = 'paper_doi' AND n > miss AND n2 > miss2 AND bad / (n - miss) - bad2 / (n2 - miss2) >= 0.25 - 1e-9
UNION ALL SELECT load_id, field, 'shift' FROM pairs GROUP BY 1, 2 HAVING sum(abs(p - q)) / 2 >= 0.4 - 1e-9
UNION ALL SELECT load_id, field, 'concentration' FROM tops WHERE rn = 1 AND p - q >= 0.3 - 1e-9
""",
    "p4_profile": f"""
WITH {_LONG},
b AS (SELECT load_id, field, count(*) n_rows, sum((raw IS NULL)::INT)::BIGINT n_missing,
        sum((field = 'paper_doi' AND raw IS NOT NULL AND NOT regexp_matches(raw, '^10\\.[0-9]{{4,9}}/[^\\s]+$'))::INT)::BIGINT n_violations,
        count(DISTINCT raw) n_distinct, min(raw) min_value, max(raw) max_value, min(length(raw)) min_length, max(length(raw)) max_length,
        coalesce(sum(length(raw)), 0)::BIGINT length_s1, coalesce(sum(length(raw) * length(raw)), 0)::BIGINT length_s2 FROM long GROUP BY 1, 2),
o AS (SELECT b.*, n_rows::DOUBLE n, (n_rows - n_missing)::DOUBLE k, (sum(n_rows) OVER w - n_rows)::DOUBLE n2, (sum(n_rows - n_missing) OVER w - (n_rows - n_missing))::DOUBLE k2, (sum(n_missing) OVER w - n_missing)::DOUBLE miss2,
        (sum(n_violations) OVER w - n_violations)::DOUBLE bad2, (sum(length_s1) OVER w - length_s1)::DOUBLE t1, (sum(length_s2) OVER w - length_s2)::DOUBLE t2 FROM b WINDOW w AS (PARTITION BY field)),
vc AS (SELECT load_id, field, lower(raw) v, count(*)::DOUBLE c FROM long WHERE raw IS NOT NULL GROUP BY 1, 2, 3),
vt AS (SELECT field, v, sum(c) t FROM vc GROUP BY 1, 2),
pairs AS (SELECT o.load_id, o.field, coalesce(vc.c, 0) / o.k p, (vt.t - coalesce(vc.c, 0)) / o.k2 q FROM o JOIN vt USING (field) LEFT JOIN vc ON vc.load_id = o.load_id AND vc.field = o.field AND vc.v = vt.v WHERE o.k > 0 AND o.k2 > 0),
far AS (SELECT load_id, field, sum(abs(p - q)) / 2 distance FROM pairs GROUP BY 1, 2),
tops AS (SELECT o.load_id, o.field, vc.c / o.k - (vt.t - vc.c) / o.k2 AS "lead", row_number() OVER (PARTITION BY o.load_id, o.field ORDER BY vc.c DESC, vt.t, vc.v DESC) rn FROM o JOIN vc USING (load_id, field) JOIN vt USING (field, v) WHERE o.k > 0 AND o.k2 > 0),
m AS (SELECT o.*, distance, "lead", n_missing / n a1, miss2 / nullif(n2, 0) a2, n_violations / nullif(k, 0) b1, bad2 / nullif(k2, 0) b2, length_s1 / nullif(k, 0) m1, t1 / nullif(k2, 0) m2,
        length_s2 / nullif(k, 0) - (length_s1 / nullif(k, 0)) * (length_s1 / nullif(k, 0)) v1, t2 / nullif(k2, 0) - (t1 / nullif(k2, 0)) * (t1 / nullif(k2, 0)) v2
      FROM o LEFT JOIN far USING (load_id, field) LEFT JOIN (SELECT * FROM tops WHERE rn = 1) USING (load_id, field)),
d AS (SELECT *, sqrt(greatest((a1 * (1 - a1) + a2 * (1 - a2)) / 2, 0)) sa, sqrt(greatest((b1 * (1 - b1) + b2 * (1 - b2)) / 2, 0)) sb, sqrt(greatest((v1 + v2) / 2, 0)) sl FROM m)
SELECT load_id, field, min_value, max_value, n_rows, n_missing, n_violations, n_distinct, min_length::BIGINT min_length, max_length::BIGINT max_length, length_s1, length_s2, round(distance, 6) distance, round("lead", 6) AS "lead",
  round(CASE WHEN sa > 1e-9 THEN (a1 - a2) / sa WHEN abs(a1 - a2) < 1e-9 THEN 0.0 END, 6) missing_shift,
  round(CASE WHEN sb > 1e-9 THEN (b1 - b2) / sb WHEN abs(b1 - b2) < 1e-9 THEN 0.0 END, 6) violation_shift,
  round(CASE WHEN sl > 1e-9 THEN (m1 - m2) / sl WHEN abs(m1 - m2) < 1e-9 THEN 0.0 END, 6) length_shift FROM d
""",
}
