"""Audits, agreement and comparisons of record sets; one pass of conditional sums each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions import scalars as S

CRITICAL = ("analyte_polymer", "critical_component", "column_name", "mobile_phase_solvents", "mobile_phase_ratio", "temperature_celsius")
TEXTS = ("analyte_polymer", "critical_component", "architecture", "critical_condition_basis", "column_name", "stationary_phase_chemistry", "column_mode", "mobile_phase_ratio", "mobile_phase_ratio_units", "temperature_celsius", "flow_rate", "pore_size", "column_dimensions", "detector", "notes", "paper_doi", "publication_year")
NESTED = ("aqueous_parameters", "field_evidence", "model_confidences")
REPEATED = ("analyte_polymer", "critical_component", "column_name", "mobile_phase_ratio", "temperature_celsius")
# Words that tell of a preparative separation.
FRACTIONATION = r"fractionat|preparative|semipreparative|semi-preparative"


def _n(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))


def _empty(c: str) -> Column:
    return (F.col(c).isNull() | (F.size(c) == 0)) if c == "mobile_phase_solvents" else (F.col(c).isNull() | (F.lower(F.col(c)) == "null"))


def null_profile(records: DataFrame, columns: tuple[str, ...] = TEXTS) -> DataFrame:
    """(field, n_null, n_rows): one aggregation, unpivoted."""
    one = records.agg(F.count("*").alias("n_rows"), *[_n(F.col(c).isNull() | (F.col(c) == "")).alias(c) for c in columns])
    return one.unpivot(["n_rows"], list(columns), "field", "n_null").select("field", "n_null", "n_rows")


def null_strings(records: DataFrame, columns: tuple[str, ...] = TEXTS, nested: tuple[str, ...] = NESTED) -> DataFrame:
    """(field, n): values that spell null as a word, also one level down."""
    named = {c: F.col(c) for c in columns} | {f"{c}.{f.name}": F.col(c)[f.name] for c in nested for f in records.schema[c].dataType.fields if f.dataType.simpleString() == "string"}
    one = records.agg(*[_n(F.lower(v) == "null").alias(f"c{k}") for k, v in enumerate(named.values())])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"c{k}").alias("n")) for k, c in enumerate(named)]))
    return one.select(pairs.alias("x")).select("x.*").where("n > 0")


def null_heavy(records: DataFrame, threshold: int = 3) -> DataFrame:
    n = sum((F.when(_empty(c), 1).otherwise(0) for c in CRITICAL), F.lit(0))
    return records.select("record_id", n.alias("n_empty")).where(F.col("n_empty") >= threshold)


def flags(records: DataFrame, hot: float = 100.0) -> DataFrame:
    """(record_id, fractionation, high_temperature, comma_analyte, simulation, no_identity) of records with any of them."""
    ev = F.concat_ws(" ", *[F.col("field_evidence")[k] for k in ("critical_condition_basis", "critical_component", "column_name", "mobile_phase_solvents", "mobile_phase_ratio", "temperature_celsius", "pore_size", "flow_rate")])
    degrees = S.number(F.trim(F.replace(F.col("temperature_celsius"), F.lit("°C"), F.lit(""))))
    bare = F.regexp_replace("analyte_polymer", r"\([^)]*\)", "")
    many = F.col("analyte_polymer").contains(", ") & (F.size(F.filter(F.split(bare, ", "), lambda x: F.trim(x) != "")) >= 2)
    said = lambda c: F.coalesce(F.lower(c).contains("simulation"), F.lit(False))
    f = lambda c: F.coalesce(c, F.lit(False))
    none = (F.coalesce("analyte_polymer", F.lit("")) == "") & (F.coalesce("critical_component", F.lit("")) == "")
    out = records.select("record_id", f(F.lower(ev).rlike(FRACTIONATION)).alias("fractionation"), f(degrees > hot).alias("high_temperature"), f(many).alias("comma_analyte"), (said(F.col("critical_condition_basis")) | said(F.col("notes"))).alias("simulation"), none.alias("no_identity"))
    return out.where("fractionation or high_temperature or comma_analyte or simulation or no_identity")


def missing_setup(records: DataFrame) -> DataFrame:
    """Records that give neither column nor flow nor detector: likely cited from elsewhere."""
    return records.where(F.col("column_name").isNull() & F.col("flow_rate").isNull() & F.col("detector").isNull()).select("record_id")


def split_analytes(records: DataFrame) -> DataFrame:
    """(record_id, pos, analyte): one row per analyte named in one field, brackets kept together."""
    parts = F.filter(F.transform(F.split("analyte_polymer", r",\s+(?![^(]*\))"), S.strip), lambda x: x != "")
    return records.where("analyte_polymer is not null").select("record_id", F.posexplode(parts).alias("pos", "analyte"))


def counts_rollup(records: DataFrame) -> DataFrame:
    """Records per subfolder and model with subtotals."""
    return records.rollup("subfolder", "model").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(k)


def _found(c: Column, strict: bool) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return ~low.isin("missed", "unclear", "", "null") if strict else F.coalesce(c, F.lit("unclear")) != "missed"


def agreement(records: DataFrame, strict: bool = False) -> DataFrame:
    """(bucket, n, share): which extractors found the consensus records; strict also counts unclear and empty as missed."""
    mc = F.col("model_confidences")
    q, m = _found(mc["qwen"], strict), _found(mc["mistral"], strict)
    b = F.when(q & m, "both").when(q, "first only").when(m, "second only").otherwise("neither")
    counts = records.where(mc.isNotNull()).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), F.lit(True)).select("bucket", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("share"))  # one total row


def signature(columns: tuple[str, ...] = CRITICAL) -> Column:
    part = lambda c: F.coalesce(F.array_join(c, ",") if c == "mobile_phase_solvents" else F.lower(S.strip(F.col(c))), F.lit("none"))
    return F.struct(*[part(c).alias(f"s{k}") for k, c in enumerate(columns)])


def exact_duplicates(records: DataFrame) -> DataFrame:
    """(paper_id, extras): records beyond the first of every signature."""
    g = records.groupBy("paper_id", signature().alias("sig")).agg(F.count("*").alias("n"))
    return g.groupBy("paper_id").agg(F.sum(F.col("n") - 1).alias("extras")).where("extras > 0")


def repeated(records: DataFrame) -> DataFrame:
    """(subfolder, paper_id, extras): records beyond the first with the same five normalised fields."""
    g = records.groupBy("subfolder", "paper_id", *[S.norm(F.col(c)).alias(f"s{k}") for k, c in enumerate(REPEATED)]).agg(F.count("*").alias("n"))
    return g.groupBy("subfolder", "paper_id").agg(F.sum(F.col("n") - 1).alias("extras")).where("extras > 0")


def first_of_signature(records: DataFrame) -> DataFrame:
    """(record_id, first_id): every repeated record with the first of its signature; the whole signature is compared, the group side is aggregated before the join."""
    rows = records.select("record_id", F.struct("paper_id", signature()).alias("sig"), F.pmod("record_id", F.lit(16)).alias("salt"))
    part = rows.groupBy("sig", "salt").agg(F.min("record_id").alias("lo"), F.max("record_id").alias("hi"))
    g = part.groupBy("sig").agg(F.min("lo").alias("first_id"), F.max("hi").alias("hi"), F.collect_list("salt").alias("salts")).where("hi > first_id").select("sig", "first_id", F.explode("salts").alias("salt"))
    return rows.join(g, ["sig", "salt"]).where("record_id > first_id").select("record_id", "first_id")


def near_duplicates(records: DataFrame) -> DataFrame:
    """(subfolder, paper_id, column, ratio, temperature, component, n_records, n_analytes, n_pairs): same set-up and component, other analytes.

    The pairs are counted, not listed: all pairs of the group without those of one analyte.
    """
    setup = ("column_name", "mobile_phase_ratio", "temperature_celsius", "critical_component")
    k = records.select("subfolder", "paper_id", *[S.norm(F.col(c)).alias(c) for c in setup], S.norm(F.col("analyte_polymer")).alias("analyte")).where("column_name <> '' and mobile_phase_ratio <> '' and temperature_celsius <> ''")
    a = k.groupBy("subfolder", "paper_id", *setup, "analyte").agg(F.count("*").alias("n"))
    total = F.sum("n")
    g = a.groupBy("subfolder", "paper_id", *setup).agg(total.alias("n_records"), F.count("*").alias("n_analytes"), F.floor((total * total - F.sum(F.col("n") * F.col("n"))) / 2).cast("bigint").alias("n_pairs"))
    return g.where("n_analytes > 1")


def compare_sets(old: DataFrame, new: DataFrame) -> DataFrame:
    """(subfolder, paper_id, n_old, n_new, delta, arrow): records per paper in two sets, missing as 0."""
    count = lambda d, n: d.groupBy("subfolder", "paper_id").agg(F.count("*").alias(n))
    j = count(old, "n_old").join(count(new, "n_new"), ["subfolder", "paper_id"], "full_outer").na.fill(0, ["n_old", "n_new"])
    d = F.col("n_new") - F.col("n_old")
    return j.select("subfolder", "paper_id", "n_old", "n_new", d.alias("delta"), F.when(d > 0, "up").when(d < 0, "down").otherwise("same").alias("arrow"))


def model_grid(records: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """One row per paper, one column per extractor with its number of records."""
    return records.groupBy("paper_id").pivot("model", list(models)).agg(F.count(F.lit(1))).select("paper_id", *[F.coalesce(F.col(f"`{m}`"), F.lit(0)).alias("n_" + m.replace("-", "_")) for m in models])


def filled_per_model(records: DataFrame, columns: tuple[str, ...] = TEXTS) -> DataFrame:
    """(model, n_fields, n_empty)."""
    empty = sum((F.when(F.coalesce(F.col(c), F.lit("")) == "", 1).otherwise(0) for c in columns), F.lit(0))
    return records.groupBy("model").agg((F.count("*") * len(columns)).alias("n_fields"), F.sum(empty).cast("bigint").alias("n_empty"))


def ratio_spellings(records: DataFrame) -> DataFrame:
    """(n_ratios, n_colon, n_slash, n_dash): distinct ratio texts and those with each separator."""
    d = records.where(~S.null_token(F.col("mobile_phase_ratio"))).select(S.strip(F.col("mobile_phase_ratio")).alias("r")).distinct()
    return d.agg(F.count("*").alias("n_ratios"), *[_n(F.col("r").contains(s)).alias(n) for s, n in ((":", "n_colon"), ("/", "n_slash"), ("-", "n_dash"))])


def model_coverage(records: DataFrame, first: str, second: str) -> DataFrame:
    """(n_papers, n_with_second, n_records_first): papers of the first extractor and whether the second saw them."""
    a = records.where(F.col("model") == first).groupBy("paper_id").agg(F.count("*").alias("n"))
    b = records.where(F.col("model") == second).select("paper_id").distinct().withColumn("there", F.lit(1))
    return a.join(b, "paper_id", "left").agg(F.count("*").alias("n_papers"), F.count("there").alias("n_with_second"), F.sum("n").alias("n_records_first"))


METADATA = ("paper_doi", "corresponding_author_name", "corresponding_email_address", "physical_address", "publication_year")


def paper_metadata(records: DataFrame, order: tuple[str, ...] = ("consensus", "qwen-27b", "mistral-24b")) -> DataFrame:
    """(paper_id, bibliographic fields): first value that is there, extractors in order, then records by id."""
    rank = F.lit(len(order))
    for k, m in enumerate(order):
        rank = F.when(F.col("model") == m, k).otherwise(rank)
    key = rank.cast("bigint") * 10**15 + F.col("record_id")
    there = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", key)
    return records.groupBy("paper_id").agg(*[F.min_by(F.when(there(c).isNotNull(), F.col(c)), there(c)).alias(c) for c in METADATA])


def stamp_metadata(records: DataFrame, metadata: DataFrame) -> DataFrame:
    """Empty bibliographic fields filled from the paper's; fields that are there stay."""
    meta = metadata.select("paper_id", *[F.col(c).alias(f"_{c}") for c in METADATA])
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")) for c in METADATA}
    return records.join(meta, "paper_id", "left").withColumns(filled).select(*records.columns)


def judgements(first: DataFrame, second: DataFrame) -> DataFrame:
    """(paper_id, requires_retry, feedback) of two judge runs: either asks, first feedback that says something."""
    a, b = first.select("paper_id", F.col("requires_retry").alias("ra"), F.col("feedback").alias("fa")), second.select("paper_id", F.col("requires_retry").alias("rb"), F.col("feedback").alias("fb"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    return a.join(b, "paper_id", "full_outer").select("paper_id", (no("ra") | no("rb")).alias("requires_retry"), F.coalesce(F.nullif("fa", F.lit("")), F.nullif("fb", F.lit(""))).alias("feedback"))


def audit(records: DataFrame) -> DataFrame:
    """(name, n): how many records, values or pairs each check finds."""
    f = flags(records)
    counted = {
        "null_heavy": null_heavy(records),
        "fractionation": f.where("fractionation"),
        "high_temperature": f.where("high_temperature"),
        "comma_analyte": f.where("comma_analyte"),
        "simulation": f.where("simulation"),
        "missing_setup": missing_setup(records),
    }
    summed = {"near_duplicates": near_duplicates(records).select(F.col("n_pairs").alias("n")), "repeated": repeated(records).select(F.col("extras").alias("n"))}
    out = null_strings(records).agg(F.lit("null_strings").alias("name"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    for name, d in summed.items():
        out = out.unionByName(d.agg(F.lit(name).alias("name"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))
    for name, d in counted.items():
        out = out.unionByName(d.agg(F.lit(name).alias("name"), F.count("*").alias("n")))
    return out


def deep_dive(records: DataFrame) -> DataFrame:
    """Fifteen columns of every consensus record for reading by hand."""
    ev = F.concat_ws(" | ", *[F.col("field_evidence")[k] for k in ("critical_condition_basis", "critical_component", "column_name", "mobile_phase_solvents", "mobile_phase_ratio", "temperature_celsius", "pore_size", "flow_rate")])
    plain = ("subfolder", "critical_component", "analyte_polymer", "column_name", "stationary_phase_chemistry", "mobile_phase_ratio", "mobile_phase_ratio_units", "temperature_celsius", "flow_rate", "detector")
    return records.where("model = 'consensus'").select(F.replace("paper_id", F.lit(".pdf"), F.lit("")).alias("paper"), *plain, F.coalesce(F.array_join("mobile_phase_solvents", ", "), F.lit("")).alias("solvents"), F.col("model_confidences.qwen").alias("qwen"), F.col("model_confidences.mistral").alias("mistral"), ev.alias("evidence"))
