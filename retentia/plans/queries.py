"""Registered queries over the record model, each beside the SQL it is checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.common import table
from retentia.functions import scalars as S
from retentia.functions import vocab as V
from retentia.operators import documents as docs
from retentia.operators import evaluate, quality, resolve, standardize, telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FIRST, SECOND = "qwen-27b", "mistral-24b"


def query(name: str, sql: str | None = None, on: str | tuple[str, ...] = "records"):
    """Registers f(tables...) under a name."""
    names = (on,) if isinstance(on, str) else on

    def wrap(f):
        QUERIES[name] = lambda spark, d: f(*[table(spark, d, n) for n in names])
        if sql:
            SQL[name] = sql
        return f

    return wrap


_STRIP = "trim({c}, E' \\t\\n\\r\\f\\x0b')"
_st = lambda c: _STRIP.format(c=c)
_nt = lambda c: f"({c} IS NULL OR lower({_st(c)}) IN ('', 'null', 'none'))"
_num = lambda x: f"CASE WHEN regexp_matches({x}, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)\\s*$') THEN TRY_CAST(trim({x}) AS DOUBLE) END"
_norm = lambda c: f"coalesce(regexp_replace(lower({_st(c)}), '\\s+', ' ', 'g'), '')"
_alnum = lambda c: f"regexp_replace({c}, '[^a-z0-9]', '', 'g')"
_list = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
_first = lambda c: f"TRY_CAST(regexp_extract({c}, '(-?\\d+(?:\\.\\d+)?)', 1) AS DOUBLE)"
_ratio_num = lambda c: _first(f"regexp_replace(regexp_replace(lower({c}), '(vol\\s*\\.?\\s*%|wt\\s*\\.?\\s*%|v\\s*/\\s*v|w\\s*/\\s*w|%)', ' ', 'g'), '[/\\\\:–—-]', ' ', 'g')")
_POLY = V.sql_map(V.POLYMERS)


def _canon(c: str) -> str:
    v = _st(f"regexp_replace(lower({_st(c)}), '{V.COMPONENT_SUFFIX}', '')")
    bare = _st(f"regexp_replace({v}, '{V.ARCH_PREFIX}', '')")
    return f"coalesce(map_extract({_POLY}, {_alnum(v)})[1], CASE WHEN {bare} <> '' AND {bare} <> {v} THEN map_extract({_POLY}, {_alnum(bare)})[1] END, {v}, '')"


def _ends(a: str, pattern: str, flags: str = "") -> tuple[str, str, str]:
    p = ("(?i)" if flags else "") + pattern
    lo, hi = _num(f"regexp_extract({a}, '{p}', 1)"), _num(f"regexp_extract({a}, '{p}', 2)")
    return f"regexp_matches({a}, '{p}')", f"CASE WHEN ({hi}) IS NOT NULL THEN {lo} END", f"CASE WHEN ({lo}) IS NOT NULL THEN {hi} END"


# ---- standardisation ----

_low = f"trim(regexp_replace(lower({_st('u')}), '\\(.*?\\)', '', 'g'), E' \\t\\n\\r\\f\\x0b')"


@query(
    "standardize_units",
    f"""
WITH a AS (SELECT record_id, mobile_phase_ratio_units u FROM records), b AS (SELECT *, {_low} low FROM a),
c AS (SELECT *, CASE WHEN regexp_extract(low, '^\\S+\\s+([\\s\\S]*)$', 1) <> '' AND NOT regexp_matches(regexp_extract(low, '^\\S+\\s+([\\s\\S]*)$', 1), '[0-9%]') THEN regexp_extract(low, '^(\\S+)', 1) ELSE low END cut FROM b)
SELECT record_id, CASE WHEN {_nt('u')} THEN NULL WHEN regexp_replace(cut, '[ ,]', '', 'g') IN ({_list(V.BY_VOLUME)}) OR cut = '% by volume' THEN 'v/v' WHEN regexp_replace(cut, '[ ,]', '', 'g') IN ({_list(V.BY_WEIGHT)}) THEN 'w/w' END unit FROM c
""",
)
def standardize_units(r: DataFrame) -> DataFrame:
    return r.select("record_id", S.ratio_units(F.col("mobile_phase_ratio_units")).alias("unit"))


_f = lambda x: f"array_to_string(list_transform({x}, lambda q: round(q, 4)::VARCHAR), ',')"
_parts = lambda sep: f"list_transform(string_split(v, '{sep}'), lambda x: {_num('x')})"
_whole = lambda x: f"len(list_filter({x}, lambda y: y IS NULL)) = 0"


@query(
    "standardize_ratio",
    f"""
WITH a AS (SELECT record_id, mobile_phase_ratio raw, {_st('mobile_phase_ratio')} v FROM records),
b AS (SELECT *, {_parts(':')} pc, {_parts('/')} ps, {_parts('-')} pd, list_transform(regexp_extract_all(v, '([\\d.]+)', 1), lambda x: {_num('x')}) pl,
  {_num("regexp_extract(v, '(?i)([\\d.]+)\\s*(?:wt|vol|%|v/v|w/w|-)', 1)")} un, {_num("regexp_extract(v, '^([\\d.]+)', 1)")} ld, (contains(lower(v), 'and') OR contains(v, ',')) il FROM a),
c AS (SELECT record_id,
  CASE WHEN {_nt('raw')} THEN NULL
    WHEN regexp_matches(v, '^[\\d.]+$') THEN CASE WHEN ({_num('v')}) IS NOT NULL THEN [{_num('v')}, round(100.0 - ({_num('v')}), 2)] END
    WHEN contains(v, ':') THEN CASE WHEN {_whole('pc')} THEN pc END
    WHEN contains(v, '/') THEN CASE WHEN {_whole('ps')} THEN ps END
    WHEN contains(v, '-') AND {_whole('pd')} AND abs(list_sum(pd) - 100.0) <= 2.0 THEN pd
    WHEN contains(v, '-') AND {_whole('pd')} AND len(pd) = 2 THEN NULL
    WHEN il AND len(pl) >= 2 THEN CASE WHEN NOT {_whole('pl')} OR list_sum(pl) > 100.0 THEN NULL WHEN list_sum(pl) < 100.0 THEN list_append(pl, round(100.0 - list_sum(pl), 2)) ELSE pl END
    WHEN il AND NOT {_whole('pl')} THEN NULL
    WHEN regexp_matches(v, '(?i)[\\d.]+\\s*(?:wt|vol|%|v/v|w/w|-)') THEN CASE WHEN un IS NOT NULL THEN [un, round(100.0 - un, 2)] END
    WHEN regexp_matches(v, '^[\\d.]+') THEN CASE WHEN ld IS NOT NULL THEN [ld, round(100.0 - ld, 2)] END END comp,
  CASE WHEN NOT {_nt('raw')} AND NOT regexp_matches(v, '^[\\d.]+$') AND NOT contains(v, ':') AND NOT contains(v, '/') AND contains(v, '-') AND {_whole('pd')} AND len(pd) = 2 AND abs(list_sum(pd) - 100.0) > 2.0 THEN pd END rng FROM b)
SELECT record_id, {_f('comp')} components, rng[1] ratio_min, rng[2] ratio_max FROM c
""",
)
def standardize_ratio(r: DataFrame) -> DataFrame:
    x = r.select("record_id", S.ratio_parts(F.col("mobile_phase_ratio")).alias("x"))
    return x.select("record_id", F.array_join(F.transform("x.components", lambda q: F.round(q, 4).cast("string")), ",").alias("components"), F.col("x.lo").alias("ratio_min"), F.col("x.hi").alias("ratio_max"))


def _ranged(name: str, col: str, pattern: str, flags: str, fn) -> None:
    there, lo, hi = _ends("v", pattern, flags)
    sql = f"""WITH a AS (SELECT record_id, CASE WHEN NOT {_nt(col)} THEN {_st(col)} END v FROM records)
SELECT record_id, CASE WHEN NOT {there} THEN {_num("regexp_extract(v, '([\\d.]+)', 1)")} END val, CASE WHEN {there} THEN {lo} END lo, CASE WHEN {there} THEN {hi} END hi FROM a"""

    @query(name, sql)
    def ranged(r: DataFrame) -> DataFrame:
        x = r.select("record_id", fn(F.col(col)).alias("x"))
        return x.select("record_id", F.col("x.value").alias("val"), "x.lo", "x.hi")


_ranged("standardize_flow", "flow_rate", "([\\d.]+)\\s*(?:to|-|–)\\s*([\\d.]+)", "i", S.flow_rate)
_ranged("standardize_temperature", "temperature_celsius", "([\\d.]+)\\s*(?:-|–)\\s*([\\d.]+)", "", S.temperature)

_PP = "([\\d.]+)\\s*(?:-|–)\\s*([\\d.]+)\\s*(nm|Å|A|um|µm)?"
_there, _lo, _hi = _ends("v", _PP, "i")
_fac = lambda x: f"CASE WHEN contains({x}, 'nm') THEN 10.0::DOUBLE WHEN contains({x}, 'um') OR contains({x}, 'µm') THEN 10000.0::DOUBLE ELSE 1.0::DOUBLE END"


@query(
    "standardize_pore",
    f"""
WITH a AS (SELECT record_id, CASE WHEN NOT {_nt('pore_size')} THEN {_st('pore_size')} END v FROM records),
b AS (SELECT *, lower(v) low, {_there} there, ({_lo}) * {_fac(f"lower(regexp_extract(v, '(?i){_PP}', 3))")} lo, ({_hi}) * {_fac(f"lower(regexp_extract(v, '(?i){_PP}', 3))")} hi,
  NOT (contains(v, ';') OR contains(v, ':')) plain, (contains(lower(v), 'and') OR contains(v, ',')) il,
  list_transform(list_filter(list_transform(regexp_split_to_array(lower(v), 'and|,'), lambda x: regexp_extract(x, '([\\d.]+)', 1)), lambda x: x <> ''), lambda x: ({_num('x')}) * {_fac('lower(v)')}) vals FROM a)
SELECT record_id, CASE WHEN plain AND NOT there AND NOT il THEN ({_num("regexp_extract(v, '([\\d.]+)', 1)")}) * {_fac('low')} END val,
  {_f(f"CASE WHEN plain AND NOT there AND il AND {_whole('vals')} THEN vals END")} vals, CASE WHEN plain AND there THEN lo END lo, CASE WHEN plain AND there THEN hi END hi FROM b
""",
)
def standardize_pore(r: DataFrame) -> DataFrame:
    x = r.select("record_id", S.pore_size(F.col("pore_size")).alias("x"))
    return x.select("record_id", F.col("x.value").alias("val"), F.array_join(F.transform("x.list", lambda q: F.round(q, 4).cast("string")), ",").alias("vals"), "x.lo", "x.hi")


_modes = " ".join(f"WHEN lower({_st('column_mode')}) IN ({_list(s)}) THEN '{n}'" for n, s in V.COLUMN_MODES.items())
_q = lambda x: "NULL" if x is None else f"'{x}'"
_arch = " ".join(f"WHEN lower({_st('architecture')}) = '{k}' THEN {_q(v)}" for k, v in V.ARCHITECTURES.items()) + " " + " ".join(f"WHEN starts_with(lower({_st('architecture')}), '{k}') THEN {_q(v)}" for k, v in V.ARCHITECTURES.items())


@query(
    "standardize_vocabulary",
    f"""SELECT record_id, CASE WHEN {_nt('column_mode')} THEN NULL {_modes} ELSE column_mode END column_mode,
  CASE WHEN architecture IS NULL OR architecture = '' THEN architecture {_arch} WHEN contains(lower({_st('architecture')}), 'block') THEN 'block copolymer' ELSE architecture END architecture,
  CASE WHEN NOT {_nt('publication_year')} THEN TRY_CAST(regexp_extract(publication_year, '(\\d{{4}})', 1) AS INTEGER) END publication_year FROM records""",
)
def standardize_vocabulary(r: DataFrame) -> DataFrame:
    return r.select("record_id", S.column_mode(F.col("column_mode")).alias("column_mode"), S.architecture(F.col("architecture")).alias("architecture"), S.year(F.col("publication_year")).alias("publication_year"))




@query("summary_export")
def summary_export(r: DataFrame) -> DataFrame:
    """37-column layout of the fullest record of every fingerprint."""
    best = standardize.fingerprint_dedup(r).select("record_id")
    return standardize.summary_rows(r.join(best, "record_id", "left_semi"))


_n0 = lambda c: f"coalesce(round_even(TRY_CAST(regexp_extract({c}, '(\\d+\\.?\\d*)', 1) AS DOUBLE), 0)::VARCHAR, '')"
_cl = lambda c: f"CASE WHEN {c} IS NULL OR lower({c}) = 'null' THEN '' ELSE {c} END"
_EVS = ("critical_condition_basis", "critical_component", "column_name", "mobile_phase_solvents", "mobile_phase_ratio", "temperature_celsius", "pore_size", "flow_rate")
_cell_of = [
    "coalesce(paper_id, '')",
    *[_cl(c) for c in ("paper_doi", "publication_year", "corresponding_author_name", "corresponding_email_address", "physical_address", "analyte_polymer", "critical_component", "architecture", "critical_condition_basis", "column_name", "stationary_phase_chemistry", "column_mode", "pore_size", "column_dimensions")],
    _cl("array_to_string(mobile_phase_solvents, ', ')"), _cl("mobile_phase_ratio"), _cl("mobile_phase_ratio_units"), _cl("aqueous_parameters.pH"), "coalesce(aqueous_parameters.salt_added::VARCHAR, '')", _cl("aqueous_parameters.salt_type"), _cl("aqueous_parameters.salt_concentration"),
    *[_cl(c) for c in ("temperature_celsius", "flow_rate", "detector", "critical_condition_confidence", "model_confidences.qwen", "model_confidences.mistral")], *[_cl(f"field_evidence.{c}") for c in _EVS], _cl("notes"),
]
_CELLS = ", ".join(f'{c} AS "{h}"' for c, h in zip(_cell_of, standardize.SUMMARY_HEADER))
_filled = " + ".join(f"""("{h}" NOT IN ('', 'false'))::INT""" if h == "Aqueous Salt Added" else f"""("{h}" <> '')::INT""" for h in standardize.SUMMARY_HEADER)
_h = lambda h: _norm(f'"{h}"')
_BEST = f"""cells AS (SELECT record_id, {_CELLS} FROM records),
a AS (SELECT *, {_filled} filled, {_h('Paper')} p, {_h('Stationary Phase Chemistry')} s, {_h('Column Name')} c, {_canon(_h('Critical Component'))} cc, {_canon(_h('Analyte Polymer'))} ap, {_n0('"Mobile Phase Ratio"')} r, {_n0('"Temperature (°C)"')} t FROM cells),
b AS (SELECT *, row_number() OVER (PARTITION BY p, s, c, cc, ap, r, t ORDER BY filled DESC, record_id) rn, min(record_id) OVER (PARTITION BY p, s, c, cc, ap, r, t) first_pos, count(*) OVER (PARTITION BY p, s, c, cc, ap, r, t) n FROM a)"""
_HEADER = ", ".join(f'"{h}"' for h in standardize.SUMMARY_HEADER)
_plain = lambda name: SQL[name].replace("round(q, 4)::VARCHAR), ',')", "q::VARCHAR), ', ')")
_sh = lambda c: f"coalesce({c}::VARCHAR, '')"
_x = "list_transform(mobile_phase_solvents, lambda x: {})"
_standard = [
    "r.paper_id", _cl("paper_doi"), _sh("v.publication_year"), *[_cl(c) for c in ("corresponding_author_name", "corresponding_email_address", "physical_address", "analyte_polymer", "critical_component")],
    _cl("coalesce(CASE WHEN r.architecture IS DISTINCT FROM v.architecture THEN r.architecture END, v.architecture)"), _sh("v.architecture"), *[_cl(c) for c in ("critical_condition_basis", "column_name", "stationary_phase_chemistry")], _sh("v.column_mode"),
    _cl("r.pore_size"), f"CASE WHEN p.val IS NOT NULL THEN p.val::VARCHAR ELSE {_sh('p.vals')} END", _sh("p.lo"), _sh("p.hi"), _cl("column_dimensions"),
    f"coalesce(array_to_string({_x.format('CASE WHEN regexp_matches(x, ' + chr(39) + '(?is)water with (.+)' + chr(39) + ') THEN ' + chr(39) + 'water' + chr(39) + ' ELSE ' + _st('x') + ' END')}, ', '), '')",
    _cl("mobile_phase_ratio"), _sh("o.components"), _sh("o.ratio_min"), _sh("o.ratio_max"), _cl("mobile_phase_ratio_units"), _sh("u.unit"), _cl("aqueous_parameters.pH"),
    _cl(f"coalesce(list_filter({_x.format('regexp_extract(' + _st('x') + ', ' + chr(39) + '(?i)water with (.+)' + chr(39) + ', 1)')}, lambda y: y <> '')[-1], aqueous_parameters.pH_modifier)"),
    _sh("aqueous_parameters.salt_added"), _cl("aqueous_parameters.salt_type"), _cl("aqueous_parameters.salt_concentration"),
    f"CASE WHEN t.lo IS NOT NULL THEN {_cl('temperature_celsius')} ELSE {_sh('t.val')} END", _sh("t.val"), _sh("t.lo"), _sh("t.hi"), _cl("flow_rate"), _sh("f.val"), _sh("f.lo"), _sh("f.hi"),
    *[_cl(c) for c in ("detector", "critical_condition_confidence", "model_confidences.qwen", "model_confidences.mistral")], f"concat_ws(' | ', {', '.join(f'field_evidence.{c}' for c in _EVS)})", _cl("notes"),
]


@query(
    "standardized_layout",
    f"""SELECT {', '.join(f'{c} AS "{h}"' for c, h in zip(_standard, standardize.STANDARD_HEADER))} FROM records r
JOIN ({_plain('standardize_vocabulary')}) v USING (record_id) JOIN ({_plain('standardize_pore')}) p USING (record_id) JOIN ({_plain('standardize_ratio')}) o USING (record_id)
JOIN ({SQL['standardize_units']}) u USING (record_id) JOIN ({SQL['standardize_temperature']}) t USING (record_id) JOIN ({SQL['standardize_flow']}) f USING (record_id)""",
)
def standardized_layout(r: DataFrame) -> DataFrame:
    """45-column layout of every record."""
    return standardize.standard_rows(standardize.standardize(r))


SQL["summary_export"] = f"WITH {_BEST} SELECT {_HEADER} FROM b WHERE rn = 1"


@query("fingerprint_dedup", f"WITH {_BEST} SELECT record_id, filled, first_pos, n FROM b WHERE rn = 1")
def fingerprint_dedup(r: DataFrame) -> DataFrame:
    return standardize.fingerprint_dedup(r)


@query("canonical_polymers", f"SELECT record_id, {_canon('analyte_polymer')} analyte, {_canon('critical_component')} component FROM records")
def canonical_polymers(r: DataFrame) -> DataFrame:
    return r.select("record_id", S.canonical_polymer(F.col("analyte_polymer")).alias("analyte"), S.canonical_polymer(F.col("critical_component")).alias("component"))


_words = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '([a-z0-9]+)', 1))"


@query(
    "word_similarity",
    f"""
WITH a AS (SELECT record_id, {_words('column_name')} x, {_words('stationary_phase_chemistry')} y FROM records)
SELECT record_id, round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) ELSE 0.0 END, 6) similarity FROM a
""",
)
def word_similarity(r: DataFrame) -> DataFrame:
    return r.select("record_id", F.round(S.word_jaccard(F.col("column_name"), F.col("stationary_phase_chemistry")), 6).alias("similarity"))


_SOLV = V.sql_map(V.SOLVENTS)


@query(
    "solvent_sets",
    f"""SELECT record_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(mobile_phase_solvents, lambda x: x IS NOT NULL AND x <> ''), lambda x: coalesce(map_extract({_SOLV}, {_alnum(f"lower({_st('x')})")})[1], lower({_st('x')}))))), '|'), '') solvents FROM records""",
)
def solvent_sets(r: DataFrame) -> DataFrame:
    return r.select("record_id", F.array_join(S.solvent_set(F.col("mobile_phase_solvents")), "|").alias("solvents"))


# ---- audits and comparisons ----

_u = lambda expr: " UNION ALL ".join(f"SELECT '{c}' field, {expr.format(c=c)} FROM records" for c in quality.TEXTS)
query("null_profile", _u("coalesce(sum(({c} IS NULL OR {c} = '')::INT), 0)::BIGINT n_null, count(*) n_rows"))(quality.null_profile)
_NESTED = [*[f"aqueous_parameters.{k}" for k in ("pH", "salt_type", "salt_concentration", "pH_modifier")], *[f"field_evidence.{k}" for k in _EVS], "model_confidences.qwen", "model_confidences.mistral"]
_spelled = " UNION ALL ".join(f"SELECT '{c}' field, coalesce(sum((lower({c}) = 'null')::INT), 0)::BIGINT n FROM records" for c in (*quality.TEXTS, *_NESTED))
query("null_strings", f"SELECT * FROM ({_spelled}) WHERE n > 0")(quality.null_strings)
_e = " + ".join(f"({'mobile_phase_solvents IS NULL OR len(mobile_phase_solvents) = 0' if c == 'mobile_phase_solvents' else f'{c} IS NULL OR lower({c}) = {chr(39)}null{chr(39)}'})::INT" for c in quality.CRITICAL)
query("null_heavy", f"SELECT record_id, {_e} n_empty FROM records WHERE {_e} >= 3")(quality.null_heavy)
_evs = ", ".join(f"field_evidence.{k}" for k in ("critical_condition_basis", "critical_component", "column_name", "mobile_phase_solvents", "mobile_phase_ratio", "temperature_celsius", "pore_size", "flow_rate"))
_sim = "(coalesce(contains(lower(critical_condition_basis), 'simulation'), false) OR coalesce(contains(lower(notes), 'simulation'), false))"
query(
    "record_flags",
    f"""SELECT * FROM (SELECT record_id, coalesce(regexp_matches(lower(concat_ws(' ', {_evs})), '{quality.FRACTIONATION}'), false) fractionation,
  coalesce(({_num("trim(replace(temperature_celsius, '°C', ''))")}) > 100, false) high_temperature,
  coalesce(contains(analyte_polymer, ', ') AND len(list_filter(string_split(regexp_replace(analyte_polymer, '\\([^)]*\\)', '', 'g'), ', '), lambda x: trim(x) <> '')) >= 2, false) comma_analyte,
  {_sim} simulation, (coalesce(analyte_polymer, '') = '' AND coalesce(critical_component, '') = '') no_identity FROM records)
WHERE fractionation OR high_temperature OR comma_analyte OR simulation OR no_identity""",
)(quality.flags)
query("missing_setup", "SELECT record_id FROM records WHERE column_name IS NULL AND flow_rate IS NULL AND detector IS NULL")(quality.missing_setup)
query(
    "split_analytes",
    """WITH a AS (SELECT record_id, regexp_replace(analyte_polymer, '\\(([^()]*)\\)', '(\\1)', 'g') x FROM records WHERE analyte_polymer IS NOT NULL),
p AS (SELECT record_id, list_filter(list_transform(string_split(array_to_string(list_transform(regexp_extract_all(x, '\\([^()]*\\)|[^()]+|[()]'), lambda q: CASE WHEN q LIKE '(%)' THEN q ELSE regexp_replace(q, ',\\s+', chr(1), 'g') END), ''), chr(1)), lambda q: trim(q, E' \\t\\n\\r\\f\\x0b')), lambda q: q <> '') parts FROM a)
SELECT record_id, (unnest(generate_series(0, len(parts) - 1)))::INTEGER pos, unnest(parts) analyte FROM p WHERE len(parts) > 0""",
)(quality.split_analytes)
query("counts_rollup", "SELECT subfolder, model, count(*) n, (grouping(subfolder) * 2 + grouping(model))::BIGINT AS \"level\" FROM records GROUP BY ROLLUP (subfolder, model)")(quality.counts_rollup)
query("top_detectors", "SELECT detector AS \"value\", count(*) n FROM records GROUP BY 1 ORDER BY n DESC, 1 NULLS LAST LIMIT 10")(lambda r: quality.top_values(r, "detector"))


def _agree(strict: bool) -> str:
    f = (lambda c: f"lower(coalesce({c}, '')) NOT IN ('missed', 'unclear', '', 'null')") if strict else (lambda c: f"coalesce({c}, 'unclear') <> 'missed'")
    q, m = f("model_confidences.qwen"), f("model_confidences.mistral")
    return f"""WITH a AS (SELECT CASE WHEN {q} AND {m} THEN 'both' WHEN {q} THEN 'first only' WHEN {m} THEN 'second only' ELSE 'neither' END bucket FROM records WHERE model_confidences IS NOT NULL)
SELECT bucket, count(*) n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) share FROM a GROUP BY 1"""


query("agreement", _agree(False))(lambda r: quality.agreement(r))
query("strict_agreement", _agree(True))(lambda r: quality.agreement(r, strict=True))
_sig = ", ".join(f"coalesce({'array_to_string(mobile_phase_solvents, ' + chr(39) + ',' + chr(39) + ')' if c == 'mobile_phase_solvents' else f'lower({_st(c)})'}, 'none') s{k}" for k, c in enumerate(quality.CRITICAL))
query("exact_duplicates", f"WITH a AS (SELECT paper_id, {_sig} FROM records), g AS (SELECT paper_id, count(*) n FROM a GROUP BY ALL) SELECT paper_id, sum(n - 1)::BIGINT extras FROM (SELECT paper_id, count(*) n FROM a GROUP BY paper_id, s0, s1, s2, s3, s4, s5) GROUP BY 1 HAVING sum(n - 1) > 0")(quality.exact_duplicates)
query("first_of_signature", f"WITH a AS (SELECT record_id, paper_id, {_sig} FROM records), b AS (SELECT record_id, min(record_id) OVER (PARTITION BY paper_id, s0, s1, s2, s3, s4, s5) first_id FROM a) SELECT * FROM b WHERE record_id > first_id")(quality.first_of_signature)
query(
    "near_duplicates",
    f"""WITH a AS (SELECT subfolder, paper_id, {_norm('column_name')} column_name, {_norm('mobile_phase_ratio')} mobile_phase_ratio, {_norm('temperature_celsius')} temperature_celsius, {_norm('critical_component')} critical_component, {_norm('analyte_polymer')} an FROM records),
g AS (SELECT subfolder, paper_id, column_name, mobile_phase_ratio, temperature_celsius, critical_component, an, count(*) n FROM a WHERE column_name <> '' AND mobile_phase_ratio <> '' AND temperature_celsius <> '' GROUP BY ALL)
SELECT subfolder, paper_id, column_name, mobile_phase_ratio, temperature_celsius, critical_component, sum(n)::BIGINT n_records, count(*) n_analytes, ((sum(n) * sum(n) - sum(n * n)) // 2)::BIGINT n_pairs FROM g GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(*) > 1""",
)(quality.near_duplicates)
_five = ", ".join(f"{_norm(c)} s{k}" for k, c in enumerate(quality.REPEATED))
query("repeated_records", f"WITH a AS (SELECT subfolder, paper_id, {_five} FROM records) SELECT subfolder, paper_id, sum(n - 1)::BIGINT extras FROM (SELECT subfolder, paper_id, s0, s1, s2, s3, s4, count(*) n FROM a GROUP BY ALL) GROUP BY 1, 2 HAVING sum(n - 1) > 0")(quality.repeated)
query(
    "compare_extractors",
    f"""WITH o AS (SELECT subfolder, paper_id, count(*) n_old FROM records WHERE model = '{FIRST}' GROUP BY 1, 2), w AS (SELECT subfolder, paper_id, count(*) n_new FROM records WHERE model = '{SECOND}' GROUP BY 1, 2),
j AS (SELECT subfolder, paper_id, coalesce(n_old, 0) n_old, coalesce(n_new, 0) n_new FROM o FULL JOIN w USING (subfolder, paper_id))
SELECT *, n_new - n_old delta, CASE WHEN n_new > n_old THEN 'up' WHEN n_new < n_old THEN 'down' ELSE 'same' END arrow FROM j""",
)(lambda r: quality.compare_sets(r.where(F.col("model") == FIRST), r.where(F.col("model") == SECOND)))
query("model_grid", f"SELECT paper_id, count(*) FILTER (model = '{FIRST}') n_qwen_27b, count(*) FILTER (model = '{SECOND}') n_mistral_24b, count(*) FILTER (model = 'consensus') n_consensus FROM records GROUP BY 1")(lambda r: quality.model_grid(r, (FIRST, SECOND, "consensus")))
query("filled_per_model", f"SELECT model, count(*) * {len(quality.TEXTS)} n_fields, sum({' + '.join(f'(coalesce({c}, {chr(39)}{chr(39)}) = {chr(39)}{chr(39)})::INT' for c in quality.TEXTS)})::BIGINT n_empty FROM records GROUP BY 1")(quality.filled_per_model)
query("ratio_spellings", f"WITH d AS (SELECT DISTINCT {_st('mobile_phase_ratio')} r FROM records WHERE NOT {_nt('mobile_phase_ratio')}) SELECT count(*) n_ratios, count(*) FILTER (contains(r, ':')) n_colon, count(*) FILTER (contains(r, '/')) n_slash, count(*) FILTER (contains(r, '-')) n_dash FROM d")(quality.ratio_spellings)
query(
    "model_coverage",
    f"WITH a AS (SELECT paper_id, count(*) n FROM records WHERE model = '{FIRST}' GROUP BY 1), b AS (SELECT DISTINCT paper_id, 1 x FROM records WHERE model = '{SECOND}') SELECT count(*) n_papers, count(x) n_with_second, sum(n)::BIGINT n_records_first FROM a LEFT JOIN b USING (paper_id)",
)(lambda r: quality.model_coverage(r, FIRST, SECOND))
query("position_consistency")(lambda r: resolve.position_consistency(r, FIRST, SECOND))

# ---- resolution ----

_NEAR = "coalesce(abs(k.r - i.r) <= 2.0, true) AND coalesce(abs(k.t - i.t) <= 2.0, true)"
query(
    "native_fold",
    f"""WITH a AS (SELECT paper_id, model, run_ts, list({{'c': cond_idx, 'id': record_id, 'r': {_ratio_num('mobile_phase_ratio')}, 't': {_first('temperature_celsius')}}} ORDER BY cond_idx, record_id) items FROM records GROUP BY 1, 2, 3),
f AS (SELECT paper_id, model, run_ts, list_reduce(list_transform(items, lambda x: [x]), lambda acc, one: CASE WHEN len(list_filter(acc, lambda k: coalesce(abs(k.r - one[1].r) <= 2.0, true) AND coalesce(abs(k.t - one[1].t) <= 2.0, true))) > 0 THEN acc ELSE list_concat(acc, one) END) kept FROM a)
SELECT paper_id, model, epoch_us(run_ts) run_us, array_to_string(list_transform(kept, lambda x: x.id::VARCHAR), ',') kept FROM f""",
)(lambda r: resolve.native_fold(r).select("paper_id", "model", F.unix_micros("run_ts").alias("run_us"), "kept"))
query("dedup_runs")(resolve.dedup_runs)
query("keep_first")(resolve.keep_first)
query("absorb_vague")(resolve.absorb)
query("pair_up")(resolve.pair_up)
query("consensus")(resolve.consensus)
query("programmatic_consensus")(resolve.programmatic)
query(
    "latest_runs",
    "WITH r AS (SELECT paper_id, model, run_ts, count(*) n FROM records GROUP BY 1, 2, 3), m AS (SELECT *, row_number() OVER (PARTITION BY paper_id, model ORDER BY run_ts DESC) k FROM r) SELECT paper_id, model, n::INTEGER n FROM m WHERE k = 1",
)(lambda r: resolve.latest_runs(r, ("analyte_polymer",)).select("paper_id", "model", F.size("items").alias("n")))

# ---- scores, telemetry, documents ----

query("field_scores", on=("records", "manual_annotations"))(evaluate.field_scores)
query("paper_scores", on=("records", "manual_annotations"))(lambda r, a: evaluate.paper_scores(evaluate.field_scores(r, a)))
query("score_summary", on=("records", "manual_annotations"))(lambda r, a: evaluate.summary(evaluate.field_scores(r, a)))
query(
    "call_sums",
    """WITH d AS (SELECT DISTINCT * FROM telemetry), c AS (SELECT model, phase, unnest(call_log) c FROM d)
SELECT model, phase, count(*) n_calls, sum((c.call_type = 'initial')::INT)::BIGINT initial_calls, sum((c.call_type = 'retry')::INT)::BIGINT retry_calls, sum(c.input_tokens)::BIGINT input_tokens, sum(c.output_tokens)::BIGINT output_tokens, sum(coalesce(c.success, false)::INT)::BIGINT n_ok FROM c GROUP BY 1, 2""",
    "telemetry",
)(telemetry.call_sums)
query(
    "run_rates",
    "SELECT paper_name, model, phase, wall_start, round(conditions_extracted * 60.0::DOUBLE / wall_duration_s, 2) conditions_per_minute, round(total_output_tokens / wall_duration_s, 2) tokens_per_second FROM telemetry WHERE wall_duration_s > 0",
    "telemetry",
)(telemetry.rates)
query(
    "model_rollup",
    """WITH d AS (SELECT DISTINCT * FROM telemetry) SELECT model, count(*) n_runs, sum(conditions_extracted)::BIGINT n_conditions, sum(total_output_tokens)::BIGINT n_tokens, sum(coalesce(success, false)::INT)::BIGINT n_ok,
round(sum(wall_duration_s::DECIMAL(18, 6)), 2)::DOUBLE AS "seconds", round(sum(total_output_tokens) / nullif(sum(wall_duration_s::DECIMAL(18, 6))::DOUBLE, 0), 4) tokens_per_second FROM d GROUP BY 1""",
    "telemetry",
)(telemetry.model_rollup)
query(
    "running_tokens",
    """WITH d AS (SELECT paper_name, model, phase, wall_start, unnest(call_log) c, generate_subscripts(call_log, 1) k FROM telemetry), e AS (SELECT DISTINCT * FROM d)
SELECT paper_name, model, phase, wall_start, k::INTEGER call_no, sum(c.output_tokens) OVER (PARTITION BY paper_name, model, phase, wall_start ORDER BY k ROWS UNBOUNDED PRECEDING)::BIGINT running_output FROM e""",
    "telemetry",
)(telemetry.running_tokens)
query(
    "performance_log",
    f"""WITH s AS (SELECT model, paper_name paper, max(wall_duration_s) s, max(num_chunks) c FROM telemetry WHERE phase = 'extraction' GROUP BY 1, 2), k AS (SELECT DISTINCT paper_id paper, 1 x FROM records WHERE model = 'consensus')
SELECT a.paper, a.s first_seconds, a.c first_chunks, b.s second_seconds, b.c second_chunks, x IS NOT NULL has_consensus FROM (SELECT * FROM s WHERE model = '{FIRST}') a LEFT JOIN (SELECT * FROM s WHERE model = '{SECOND}') b ON a.paper = b.paper LEFT JOIN k ON k.paper = a.paper""",
    ("telemetry", "records"),
)(lambda t, r: telemetry.performance_log(t, r, FIRST, SECOND))
query("document_fingerprints", "SELECT doc_id, sha256(text) sha256, length(text)::INTEGER char_len FROM documents", "documents")(docs.fingerprints)
query("distinct_texts", "SELECT min(doc_id) first_id, count(*) n FROM documents WHERE text IS NOT NULL GROUP BY text", "documents")(docs.distinct_texts)
query("document_chunks", on="documents")(lambda d: docs.chunk(d, 300).select("doc_id", "chunk_index", "section", "token_count", F.sha2("text", 256).alias("sha256")))
query("token_estimates", "SELECT doc_id, len(regexp_extract_all(text, '(\\w+|[^\\w\\s])'))::INTEGER n_tokens FROM documents", "documents")(lambda d: d.select("doc_id", S.token_estimate(F.col("text")).alias("n_tokens")))
query("event_props", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) k FROM events", "events")(lambda e: e.select("event_id", F.get_json_object(S.parse_model_answer(F.col("props")), "$.k").cast("bigint").alias("k")))


# ---- streams, reports, extraction ----


def _stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts per event type, computed as a stream over the event table."""
    from retentia.streaming import streams

    events = streams.stream(spark, f"{d}/events.parquet", table(spark, d, "events").schema)
    out = streams.drain(streams.windowed(events, "ts", "event_type", "value"), "events", ("window_start", "event_type"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES["stream_event_windows"] = _stream_windows
SQL["stream_event_windows"] = "SELECT date_trunc('hour', ts) window_start, event_type, count(*) n, round(sum(\"value\"), 4) total FROM events GROUP BY 1, 2"


@query(
    "extract_with_stand_in",
    """WITH a AS (SELECT doc_id, len(regexp_extract_all(text, '(\\w+|[^\\w\\s])')) n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 1::BIGINT n_chunks, 1::BIGINT n_ok, n::BIGINT total_tokens FROM a WHERE n <= 25000""",
    on="documents",
)
def extract_with_stand_in(d: DataFrame) -> DataFrame:
    """Chunks, prompts, answers of the deterministic stand-in, assembled per document."""
    from retentia.operators import extractors as X

    chunks = docs.chunk(d, 25_000)
    asked = X.call(chunks.select("doc_id", "chunk_index", X.extraction_prompt(F.col("text"), "List every critical condition.").alias("prompt")), "prompt", X.EchoExtractor())
    return X.assemble(chunks, asked)


@query(
    "detail_lines",
    "SELECT record_id, concat_ws(' | ', coalesce(nullif(critical_component, ''), nullif(analyte_polymer, ''), 'N/A'), concat(coalesce(nullif(column_name, ''), 'N/A'), ' (', coalesce(nullif(stationary_phase_chemistry, ''), 'N/A'), ')'), coalesce(array_to_string(mobile_phase_solvents, '/'), 'N/A'), coalesce(nullif(mobile_phase_ratio, ''), 'N/A')) line FROM records",
)
def detail_lines(r: DataFrame) -> DataFrame:
    from retentia.sources import sinks

    return sinks.detail_lines(r)


_meta = ", ".join(f"arg_min({c}, k) FILTER (coalesce({c}, '') <> '') {c}" for c in quality.METADATA)
query("paper_metadata", f"WITH a AS (SELECT *, (CASE model WHEN 'consensus' THEN 0 WHEN 'qwen-27b' THEN 1 WHEN 'mistral-24b' THEN 2 ELSE 3 END)::BIGINT * 1000000000000000 + record_id k FROM records) SELECT paper_id, {_meta} FROM a GROUP BY 1")(quality.paper_metadata)
_stamp = ", ".join(f"coalesce(nullif(r.{c}, ''), m.{c}) {c}" for c in quality.METADATA)
query("stamped_metadata", f"WITH a AS (SELECT *, (CASE model WHEN 'consensus' THEN 0 WHEN 'qwen-27b' THEN 1 WHEN 'mistral-24b' THEN 2 ELSE 3 END)::BIGINT * 1000000000000000 + record_id k FROM records), m AS (SELECT paper_id, {_meta} FROM a GROUP BY 1) SELECT record_id, {_stamp} FROM records r LEFT JOIN m USING (paper_id)")(
    lambda r: quality.stamp_metadata(r, quality.paper_metadata(r)).select("record_id", *quality.METADATA)
)
query(
    "deep_dive",
    f"""SELECT replace(paper_id, '.pdf', '') paper, subfolder, critical_component, analyte_polymer, column_name, stationary_phase_chemistry, mobile_phase_ratio, mobile_phase_ratio_units, temperature_celsius, flow_rate, detector,
coalesce(array_to_string(mobile_phase_solvents, ', '), '') solvents, model_confidences.qwen qwen, model_confidences.mistral mistral, concat_ws(' | ', {_evs}) evidence FROM records WHERE model = 'consensus'""",
)(quality.deep_dive)
_checks = {"null_heavy": "null_heavy", "missing_setup": "missing_setup"}
_counted = [f"SELECT '{n}' name, count(*) n FROM ({SQL[q]})" for n, q in _checks.items()] + [f"SELECT '{n}' name, count(*) n FROM ({SQL['record_flags']}) WHERE {n}" for n in ("fractionation", "high_temperature", "comma_analyte", "simulation")]
_counted += [f"SELECT '{n}' name, coalesce(sum({c}), 0)::BIGINT n FROM ({SQL[q]})" for n, c, q in (("near_duplicates", "n_pairs", "near_duplicates"), ("repeated", "extras", "repeated_records"))]
query("audit", " UNION ALL ".join([*_counted, f"SELECT 'null_strings' name, coalesce(sum(n), 0)::BIGINT n FROM ({SQL['null_strings']})"]))(quality.audit)
