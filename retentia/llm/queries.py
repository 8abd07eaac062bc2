"""Queries of the problems on records and texts for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.common import table
from retentia.llm import canonical, leakage, mixing, reading, recordhash, survivor, unify


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return recordhash.copy_groups(table(spark, d, "records"))


def p1_conditions(spark: SparkSession, d: str) -> DataFrame:
    return recordhash.conditions(table(spark, d, "records"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.best_records(table(spark, d, "records"))


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(table(spark, d, "records"))


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_to_terms(table(spark, d, "records"), table(spark, d, "canonical_terms"), ("analyte_polymer", "architecture"), ("mobile_phase_solvents",))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).select(F.col("row_id").alias("record_id"), "field", "pos", "term_id")


def p6_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Report of the values without an entry, most frequent first by count."""
    return _mapped(spark, d).where("term_id = 0").groupBy("field", "value").agg(F.count("*").alias("n_values"))


def _departing(spark: SparkSession, d: str) -> DataFrame:
    r = unify.departing(table(spark, d, "records"), "records", "record_id", {"analyte_polymer": F.col("analyte_polymer"), "critical_component": F.col("critical_component")})
    e = unify.departing(table(spark, d, "extractions"), "extractions", "run_id", {"metadata.source_pdf": F.col("metadata.source_pdf")})
    return r.unionByName(e)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    kinds = ":(" + "|".join(unify.DEPARTING) + r")(\s|$)"
    return _departing(spark, d).where(F.col("places").rlike(kinds)).select("table_id", "row_id", "field")


def p7_unified(spark: SparkSession, d: str) -> DataFrame:
    return _departing(spark, d)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, and into how many documents."""
    return p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix: how often every chosen document appears."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares aimed at and reached."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).where("level >= 4").select("doc_id").distinct()


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d)


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """Corpus profile: documents per source and level."""
    src = table(spark, d, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "source")
    return _levels(spark, d).join(src, "doc_id").groupBy("source", "level").agg(F.count("*").alias("n_documents"), F.round(F.avg("difficulty"), 4).alias("mean_difficulty"))


QUERIES = {
    "p1_found": p1_found, "p1_conditions": p1_conditions, "p2_found": p2_found, "p2_survivors": p2_survivors, "p6_found": p6_found, "p6_unmatched": p6_unmatched, "p7_found": p7_found, "p7_unified": p7_unified,
    "p8_found": p8_found, "p8_items": p8_items, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_levels": p10_levels, "p10_profile": p10_profile,
}

_MISS = "({c} IS NULL OR lower(trim({c}, E' \\t\\n\\r\\f\\x0b')) IN ('', 'null', 'none', 'n/a'))"


def _m(c: str) -> str:
    return _MISS.format(c=c)


def _parts(c: str) -> str:
    keep = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(x), '([0-9])\\.([0-9])', '\\1§\\2', 'g'), '([0-9])\\.([0-9])', '\\1§\\2', 'g'), '[^\\p{L}\\p{N}§]', '', 'g'), '§', '.', 'g')"
    return f"CASE WHEN {_m(c)} THEN '-' ELSE '=' || array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array({c}, '[,;]'), lambda x: {keep}), lambda y: y <> '')), ',') END"


_RATIO = f"CASE WHEN {_m('mobile_phase_ratio')} THEN '-' ELSE '=' || array_to_string(regexp_extract_all(lower(mobile_phase_ratio), '\\p{{N}}+(\\.[0-9]+)*|\\p{{L}}+'), '|') END"
_KEYS = f"keyed AS (SELECT *, paper_id || E'\\x1e' || {_parts('critical_component')} || E'\\x1e' || {_parts('column_name')} || E'\\x1e' || {_parts('stationary_phase_chemistry')} || E'\\x1e' || {_RATIO} AS k FROM records)"
_EV = " + ".join(f"(NOT {_m('field_evidence.' + f)} AND lower(trim(field_evidence.{f})) <> 'missed')::INT" for f in survivor.EVIDENCE)
_MC = " + ".join(f"(model_confidences.{m} IS NOT NULL AND NOT {_m('model_confidences.' + m)} AND lower(trim(model_confidences.{m})) <> 'missed')::INT" for m in survivor.MODELS)
SQL = {
    "p1_found": f"WITH {_KEYS}, g AS (SELECT record_id, min(record_id) OVER (PARTITION BY k) f FROM keyed) SELECT f first_id, record_id copy_id FROM g WHERE record_id > f",
    "p1_conditions": f"WITH {_KEYS} SELECT min(record_id) record_id, count(*) copies FROM keyed GROUP BY k",
    "p2_found": f"""
WITH {_KEYS},
s AS (SELECT k, record_id, coalesce({_EV}, 0) + coalesce({_MC}, 0) nf, run_ts,
        CASE lower(trim(critical_condition_confidence)) WHEN 'explicit' THEN 3 WHEN 'strong_inference' THEN 2 WHEN 'unclear' THEN 1 ELSE 0 END sure FROM keyed),
g AS (SELECT *, min(record_id) OVER w f, count(*) OVER w n, max(nf) OVER w mf, max(run_ts) OVER w mt, max(sure) OVER w ms FROM s WINDOW w AS (PARTITION BY k))
SELECT f first_id, min(record_id) best_id FROM g WHERE n > 1 AND nf = mf AND run_ts = mt AND sure = ms GROUP BY k, f HAVING count(*) = 1
""",
}
_S = f"s AS (SELECT *, coalesce({_EV}, 0) + coalesce({_MC}, 0) nf, CASE lower(trim(critical_condition_confidence)) WHEN 'explicit' THEN 3 WHEN 'strong_inference' THEN 2 WHEN 'unclear' THEN 1 ELSE 0 END sure FROM keyed)"


def _latest(c: str, name: str, first: str = "") -> str:
    """The value of the latest record that has it (all records of the tables have a time)."""
    miss = "" if first else f" AND lower(trim({c})) <> 'missed'"
    return f"arg_max({c}, ROW({first}run_ts, sure, nf, -record_id)) FILTER (NOT {_m(c)}{miss}) AS {name}"


_picks = [_latest("critical_condition_confidence", "confidence", "sure, ")] + [_latest(f"model_confidences.{m}", m) for m in survivor.MODELS] + [_latest(f"field_evidence.{f}", f"evidence_{f}") for f in survivor.EVIDENCE]
SQL["p2_survivors"] = f"WITH {_KEYS}, {_S} SELECT min(record_id) first_id, count(DISTINCT record_id) copies, {', '.join(_picks)} FROM s GROUP BY k"
_code = "\\x{%x}"
_ALIKE = unify.ranges(unify.LOOKALIKES, _code)
# The classes of characters that the definition of the query names.
_NAMED = r"[\x{ff01}-\x{ff5e}\x{ffe0}-\x{ffe6}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{fff0}-\x{fffb}\x{e0000}-\x{e0fff}]|\p{Mn}"
_ODD = rf"len(list_filter(regexp_extract_all(v, '[\p{{L}}\p{{Mn}}]+'), lambda w: regexp_matches(w, '[{_ALIKE}]') AND (regexp_matches(w, '\p{{Latin}}') OR NOT regexp_matches(w, '[^{_ALIKE}\p{{Mn}}]')))) > 0"
SQL["p7_found"] = f"""
WITH t AS (SELECT 'records' table_id, record_id row_id, 'analyte_polymer' field, analyte_polymer v FROM records UNION ALL SELECT 'records', record_id, 'critical_component', critical_component FROM records
  UNION ALL SELECT 'extractions', run_id, 'metadata.source_pdf', metadata.source_pdf FROM extractions)
SELECT table_id, row_id, field FROM t WHERE v IS NOT NULL AND (regexp_matches(v, '{_NAMED}') OR {_ODD})
"""
