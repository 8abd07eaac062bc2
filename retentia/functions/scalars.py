"""Scalar functions over Columns; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from retentia.functions import vocab

BLANK = " \t\n\r\f\x0b"
NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANK))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def null_token(c: Column) -> Column:
    """Null, blank, `null` or `none` (not n/a): the standardizer's idea of missing."""
    return c.isNull() | F.lower(strip(c)).isin("", "null", "none")


def norm(c: Column) -> Column:
    """Lower case, trimmed, blanks collapsed; '' for null."""
    return F.coalesce(F.regexp_replace(F.lower(strip(c)), r"\s+", " "), F.lit(""))


def alnum(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-z0-9]", "")


def deplural(c: Column) -> Column:
    return F.when((F.length(c) > 3) & c.endswith("s") & ~c.endswith("ss"), F.substring(c, 1, F.length(c) - 1)).otherwise(c)


def number(c: Column) -> Column:
    """A text that is a number as a whole, else null (never an error)."""
    return F.when(c.rlike(NUMERIC), F.expr("1.0D") * strip(c).try_cast("double"))


def first_number(c: Column) -> Column:
    """First signed number in a text."""
    return F.regexp_extract(c, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def leading_number(c: Column) -> Column:
    """First number in a text without its sign."""
    return F.regexp_extract(c, r"(\d+\.?\d*)", 1).try_cast("double")


def ratio_number(c: Column) -> Column:
    """First number of a ratio, units and separators blanked out."""
    units = F.regexp_replace(F.lower(c), r"(vol\s*\.?\s*%|wt\s*\.?\s*%|v\s*/\s*v|w\s*/\s*w|%)", " ")
    return first_number(F.regexp_replace(units, r"[/\\:–—-]", " "))


def norm_ratio(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[/\\–—-]", ":"), r"\s+", ""), F.lit(""))


def words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays; 0 if one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def word_jaccard(a: Column, b: Column) -> Column:
    return jaccard(words(a), words(b))


def canonical_polymer(c: Column) -> Column:
    """Family of a polymer name: descriptor suffix dropped, looked up, then once more without a topology prefix; else the text."""
    def known(v: Column) -> Column:
        bare = strip(F.regexp_replace(v, vocab.ARCH_PREFIX, ""))
        return F.coalesce(vocab.lookup(vocab.POLYMERS, alnum(v)), let(bare, lambda b: F.when((b != "") & (b != v), vocab.lookup(vocab.POLYMERS, alnum(b)))), v, F.lit(""))

    return let(strip(F.regexp_replace(F.lower(strip(c)), vocab.COMPONENT_SUFFIX, "")), known)


def solvent_set(c: Column, extended: bool = False) -> Column:
    """Sorted distinct solvents, each under its main name."""
    table = vocab.SOLVENTS_EXTENDED if extended else vocab.SOLVENTS
    low = F.transform(F.filter(c, lambda x: x.isNotNull() & (x != "")), lambda x: F.lower(strip(x)))
    return F.coalesce(F.array_sort(F.array_distinct(F.transform(low, lambda x: F.coalesce(vocab.lookup(table, alnum(x)), x)))), F.array().cast("array<string>"))


def ratio_units(c: Column) -> Column:
    low = strip(F.regexp_replace(F.lower(strip(c)), r"\(.*?\)", ""))
    rest = F.regexp_extract(low, r"^\S+\s+([\s\S]*)$", 1)
    cut = F.when((rest != "") & ~rest.rlike("[0-9%]"), F.regexp_extract(low, r"^(\S+)", 1)).otherwise(low)
    clean = F.regexp_replace(cut, "[ ,]", "")
    return F.when(null_token(c), None).when(clean.isin(*vocab.BY_VOLUME) | (cut == "% by volume"), "v/v").when(clean.isin(*vocab.BY_WEIGHT), "w/w")


def ratio_parts(c: Column) -> Column:
    """struct(components, min, max): an unreadable part after `:` or `/` ends the reading, after `-` the next rule is tried."""
    v = strip(c)
    none, nothing = F.lit(None).cast("array<double>"), F.lit(None).cast("double")

    def res(comp: Column = none, lo: Column = nothing, hi: Column = nothing) -> Column:
        return F.struct(comp.alias("components"), lo.alias("lo"), hi.alias("hi"))

    def with_rest(x: Column) -> Column:
        return F.when(x.isNotNull(), F.array(x, F.round(100.0 - x, 2)))

    def parts(sep: str) -> Column:
        p = F.transform(F.split(v, sep), number)
        return F.when(F.forall(p, lambda x: x.isNotNull()), p)

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    dash = parts("-")
    listed = F.transform(F.regexp_extract_all(v, F.lit(r"([\d.]+)"), 1), number)
    readable = F.forall(listed, lambda x: x.isNotNull())
    lsum = total(listed)
    unit = number(F.regexp_extract(v, r"(?i)([\d.]+)\s*(?:wt|vol|%|v/v|w/w|-)", 1))
    lead = number(F.regexp_extract(v, r"^([\d.]+)", 1))
    is_list = F.lower(v).contains("and") | v.contains(",")
    return (
        F.when(null_token(c), res())
        .when(v.rlike(r"^[\d.]+$"), res(with_rest(number(v))))
        .when(v.contains(":"), res(parts(":")))
        .when(v.contains("/"), res(parts("/")))
        .when(v.contains("-") & dash.isNotNull() & (F.abs(total(dash) - 100.0) <= 2.0), res(dash))
        .when(v.contains("-") & dash.isNotNull() & (F.size(dash) == 2), res(none, F.get(dash, F.lit(0)), F.get(dash, F.lit(1))))
        .when(is_list & (F.size(listed) >= 2), F.when(~readable | (lsum > 100.0), res()).when(lsum < 100.0, res(F.concat(listed, F.array(F.round(100.0 - lsum, 2))))).otherwise(res(listed)))
        .when(is_list & ~readable, res())
        .when(v.rlike(r"(?i)[\d.]+\s*(?:wt|vol|%|v/v|w/w|-)"), res(with_rest(unit)))
        .when(v.rlike(r"^[\d.]+"), res(with_rest(lead)))
        .otherwise(res())
    )


def _range(v: Column, pattern: str) -> tuple[Column, Column, Column]:
    """(whether a range is there, its ends or null when unreadable)."""
    lo, hi = number(F.regexp_extract(v, pattern, 1)), number(F.regexp_extract(v, pattern, 2))
    ok = lo.isNotNull() & hi.isNotNull()
    return v.rlike(pattern), F.when(ok, lo), F.when(ok, hi)


def flow_rate(c: Column) -> Column:
    """struct(value, lo, hi): range, else the first number; units are not converted here."""
    v = F.when(~null_token(c), strip(c))
    there, lo, hi = _range(v, r"(?i)([\d.]+)\s*(?:to|-|–)\s*([\d.]+)")
    value = F.when(~there, number(F.regexp_extract(v, r"([\d.]+)", 1)))
    return F.struct(value.alias("value"), F.when(there, lo).alias("lo"), F.when(there, hi).alias("hi"))


def _factor(low: Column) -> Column:
    return F.when(low.contains("nm"), 10.0).when(low.contains("um") | low.contains("µm"), 10000.0).otherwise(1.0)


def pore_size(c: Column) -> Column:
    """struct(value, list, lo, hi) in ångström; a range is asked before a list."""
    v = F.when(~null_token(c), strip(c))
    pattern = r"(?i)([\d.]+)\s*(?:-|–)\s*([\d.]+)\s*(nm|Å|A|um|µm)?"
    there, lo, hi = _range(v, pattern)
    low = F.lower(v)
    rf = _factor(F.lower(F.regexp_extract(v, pattern, 3)))
    is_list = low.contains("and") | v.contains(",")
    items = F.filter(F.transform(F.split(low, "and|,"), lambda x: F.regexp_extract(x, r"([\d.]+)", 1)), lambda x: x != "")
    values = F.transform(items, lambda x: number(x) * _factor(low))
    plain = ~(v.contains(";") | v.contains(":"))
    return F.struct(
        F.when(plain & ~there & ~is_list, number(F.regexp_extract(v, r"([\d.]+)", 1)) * _factor(low)).alias("value"),
        F.when(plain & ~there & is_list & F.forall(values, lambda x: x.isNotNull()), values).alias("list"),
        F.when(plain & there, lo * rf).alias("lo"),
        F.when(plain & there, hi * rf).alias("hi"),
    )


def temperature(c: Column) -> Column:
    v = F.when(~null_token(c), strip(c))
    there, lo, hi = _range(v, r"([\d.]+)\s*(?:-|–)\s*([\d.]+)")
    return F.struct(F.when(~there, number(F.regexp_extract(v, r"([\d.]+)", 1))).alias("value"), F.when(there, lo).alias("lo"), F.when(there, hi).alias("hi"))


def column_mode(c: Column) -> Column:
    low = F.lower(strip(c))
    out = F.when(null_token(c), None)
    for name, spellings in vocab.COLUMN_MODES.items():
        out = out.when(low.isin(*spellings), name)
    return out.otherwise(c)


def architecture(c: Column) -> Column:
    """Exact spelling, else the first known one it begins with, else block copolymer where it says so, else unchanged."""

    def mapped(low: Column) -> Column:
        out = F.when(low.isin(*vocab.ARCHITECTURES), vocab.lookup(vocab.ARCHITECTURES, low))
        for key, target in vocab.ARCHITECTURES.items():
            out = out.when(low.startswith(key), target)
        return out.when(low.contains("block"), "block copolymer").otherwise(c)

    return F.when(c.isNull() | (c == ""), c).otherwise(let(F.lower(strip(c)), mapped))


def year(c: Column) -> Column:
    return F.when(~null_token(c), F.regexp_extract(c, r"(\d{4})", 1).try_cast("int"))


def solvents_and_modifier(c: Column) -> tuple[Column, Column]:
    """(solvents with `water with X` cut to water, the last X)."""
    pattern = r"(?is)water with (.+)"
    cut = F.transform(c, lambda x: F.when(x.rlike(pattern), "water").otherwise(strip(x)))
    found = F.filter(F.transform(c, lambda x: F.regexp_extract(strip(x), r"(?i)water with (.+)", 1)), lambda x: x != "")
    return cut, F.try_element_at(found, F.lit(-1))


def clean_text(c: Column) -> Column:
    """'' for null and any spelling of `null`."""
    return F.when(c.isNull() | (F.lower(c) == "null"), "").otherwise(c)


def shown(c: Column) -> Column:
    """A typed value as text, '' for null."""
    return F.coalesce(c.cast("string"), F.lit(""))


def normalize_text(c: Column) -> Column:
    """Text for scoring: lower case, degree sign blanked, micro sign u, blanks collapsed, only letters, digits and a few signs."""
    t = F.regexp_replace(F.regexp_replace(F.lower(c), "°", " "), "μ", "u")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"[^a-z0-9./+\- ]", ""))


def split_multi(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"(?i),|;|/|\band\b"), normalize_text), lambda x: x != "")


def parse_model_answer(c: Column) -> Column:
    """JSON object of a model's answer as text: thoughts and fences dropped, else the text between the first { and the last }; null without one."""
    t = strip(F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", ""))
    inner = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    ok = lambda x: F.when(x.startswith("{") & F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(ok(t), ok(inner))


def token_estimate(c: Column) -> Column:
    """Words and signs: an offline stand-in for a subword count."""
    return F.size(F.regexp_extract_all(c, F.lit(r"(\w+|[^\w\s])"), 1))
