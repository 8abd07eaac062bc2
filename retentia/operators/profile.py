"""Column profiles of every load, and the loads that depart from the others.

Everything is built from mergeable parts. A measure of a value (is it missing, does it violate its pattern, how long is it) is
described by exact power sums: count, sum and sum of squares as decimals, so that any order of merging gives the same
digits. What all other loads hold is the total minus the load itself, and a measure is compared across loads by its difference of means
and by its standardised difference. Grouped distinct values give distinct counts, ranges, the distance between the value shares and the
lead of a load's most frequent value. `departures` is this profile held against thresholds: for the measures of 0 and 1 the
difference of means is the difference of shares.

Values are aggregated map-side before the one shuffle on (column, load, value), so a load or a value that holds a third of all
rows costs no more than any other; the counts are written once and read by every part of the profile.

Defined results: missing (null, blank, null/none/n/a) counts as missing in every column; a load without any
present value has null ranges, length, distance and lead; with a single load there is nothing to compare and no
departure; an empty table gives empty results; a column given twice is profiled once; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.common import materialize, present, strip

#: Fixed value: form of a well-formed DOI.
DOI = r"^10\.[0-9]{4,9}/\S+$"
EPS = 1e-9


def value_counts(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(field, load, raw, n): rows per trimmed value; raw is null for missing."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), strip(present(F.col(c))).alias("raw")) for c in dict.fromkeys(columns)]))
    long = df.select(F.col(by).alias("load"), pairs.alias("x")).select("load", "x.field", "x.raw")
    return long.groupBy("field", "load", "raw").agg(F.count("*").alias("n"))


def _measures(patterns: dict[str, str]) -> dict[str, tuple[Column, Column]]:
    """name -> (value of the measure, where it is defined)."""
    there = F.col("raw").isNotNull()
    bad: Column = F.lit(False)
    for f, p in patterns.items():
        bad = bad | ((F.col("field") == f) & ~F.coalesce(F.col("raw").rlike(p), F.lit(False)))
    return {"missing": ((~there).cast("int"), F.lit(True)), "violation": (bad.cast("int"), there), "length": (F.length("raw"), there)}


def _decimal(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("decimal(38,0)")


def _compared(name: str) -> list[Column]:
    """Mean of a measure, its difference to the mean of all other loads, and that difference in pooled standard deviations."""
    own = [F.col(f"{name}_s{p}") for p in range(3)]
    rest = [F.col(f"all_{name}_s{p}") - c for p, c in enumerate(own)]

    def moments(s: list[Column]) -> tuple[Column, Column]:
        n = F.nullif(s[0].cast("double"), F.lit(0.0))
        mean = s[1].cast("double") / n
        return mean, s[2].cast("double") / n - mean * mean

    (m, v), (mo, vo) = moments(own), moments(rest)
    spread = F.sqrt(F.greatest((v + vo) / 2, F.lit(0.0)))
    shift = F.when(spread > EPS, (m - mo) / spread).when(F.abs(m - mo) < EPS, F.lit(0.0))
    return [m.alias(f"{name}_mean"), (m - mo).alias(f"{name}_difference"), shift.alias(f"{name}_shift")]


def profile(df: DataFrame, by: str, columns: list[str], patterns: dict[str, str] | None = None) -> DataFrame:
    """One row per (field, load): counts, distinct values, ranges, and for every measure its power sums and cross-load differences.

    `distance`: half the sum of absolute differences of the value shares (any case) to all other loads. `lead`: share of the
    load's most frequent value above its share elsewhere; of values equally frequent in the load, the one rarest elsewhere.
    """
    measures = _measures(patterns or {})
    counts = materialize(value_counts(df, by, columns))
    n = F.col("n").cast("decimal(19,0)")
    sums = [_decimal(F.sum(F.when(there, (x.cast("decimal(9,0)") if p < 2 else (x * x).cast("decimal(19,0)")) * n if p else n))).alias(f"{name}_s{p}") for name, (x, there) in measures.items() for p in range(3)]
    size = F.length("raw")
    base = counts.groupBy("field", "load").agg(
        F.sum("n").alias("n_rows"), F.count("raw").alias("n_distinct"), F.min("raw").alias("min_value"), F.max("raw").alias("max_value"), F.min(size).alias("min_length"), F.max(size).alias("max_length"), *sums,
    )
    powers = [f"{name}_s{p}" for name in measures for p in range(3)]
    every = base.groupBy("field").agg(*[F.sum(c).cast("decimal(38,0)").alias(f"all_{c}") for c in powers])  # one row per profiled column
    loads = base.join(F.broadcast(every), "field")

    # grouped values: present rows of the load and of the others are the power sums of order 0 of any measure of present values
    own, rest = F.col("length_s0").cast("double"), (F.col("all_length_s0") - F.col("length_s0")).cast("double")
    values = counts.where("raw is not null").groupBy("field", "load", F.lower("raw").alias("value")).agg(F.sum("n").alias("n"))
    total = values.groupBy("field", "value").agg(F.sum("n").alias("t"))
    sizes = loads.select(F.col("load").alias("_load"), F.col("field").alias("_field"), own.alias("own"), rest.alias("rest")).where("own > 0 and rest > 0")
    same = (F.col("field") == F.col("_field")) & F.col("load").eqNullSafe(F.col("_load"))
    v = values.join(total, ["field", "value"]).join(sizes, same)
    p, q = F.col("n") / F.col("own"), (F.col("t") - F.col("n")) / F.col("rest")
    g = v.groupBy("_load", "_field").agg(F.sum(F.abs(p - q)).alias("d"), F.sum(q).alias("seen"), F.max_by(p - q, F.struct("n", (-F.col("t")).alias("t"), "value")).alias("lead"))
    g = g.select("_load", "_field", ((F.col("d") + F.greatest(1 - F.col("seen"), F.lit(0.0))) / 2).alias("distance"), "lead")  # values the load lacks add their share elsewhere
    out = loads.join(g, same, "left").drop("_load", "_field")
    counted = [F.col("missing_s1").cast("bigint").alias("n_missing"), F.col("violation_s1").cast("bigint").alias("n_violations")]
    return out.select("field", "load", "n_rows", *counted, "n_distinct", "min_value", "max_value", "min_length", "max_length", "distance", "lead", *powers, *[c for name in measures for c in _compared(name)])


def departures(
    df: DataFrame,
    by: str,
    columns: list[str],
    patterns: dict[str, str] | None = None,
    shift_columns: tuple[str, ...] = (),
    concentration_columns: tuple[str, ...] = (),
    missing_points: float = 0.25,
    pattern_points: float = 0.25,
    shift_distance: float = 0.4,
    concentration_points: float = 0.3,
) -> DataFrame:
    """(load, field, departure): loads that differ from all other loads taken together, by their profile.

    missing, pattern: the measure's mean, which is a share, is higher by the given points. shift: the distance of the value shares.
    concentration: the lead of the most frequent value.
    """
    among = lambda cols: F.col("field").isin(*cols) if cols else F.lit(False)
    signs = {
        "missing": F.col("missing_difference") >= missing_points - EPS,
        "pattern": among(patterns) & (F.col("violation_difference") >= pattern_points - EPS),
        "shift": among(shift_columns) & (F.col("distance") >= shift_distance - EPS),
        "concentration": among(concentration_columns) & (F.col("lead") >= concentration_points - EPS),
    }
    found = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in signs.items()])))
    return profile(df, by, columns, patterns).select("load", "field", found.alias("departure"))
