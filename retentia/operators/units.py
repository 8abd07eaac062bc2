"""Quantities in different units: segment the unit text, convert to one unit per field.

A unit text is segmented by dynamic programming over tries of prefixes, roots and exponents. Every decomposition has a cost
(wrong letter case, short prefix on long root, bare exponent) to which the field's prior adds how unlikely its dimension is
there; the cheapest wins, and it is the field's unit if it has the field's dimension. So `A` at a pore size is an angstrom, `C` at a
temperature a degree, `ul min-1` a flow and `NM` a length. The basis of a ratio is read the same way, word by word: prefix and
root from tries, words that name a basis before units that only imply one.

Numbers may have an exponent; at temperatures and flow rates a comma before three digits parts thousands, any other comma is
a decimal one. At pore sizes a comma parts a list. A remark in brackets without digits is passed over.

Defined results: a missing field gives no row; a range, a list, a word or an unknown unit gives no row; a bare number
takes the unit its evidence gives right after the same number, however long the quotation, without one it gives no row; repeated rows are
converted alike and each keeps its row; extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.common import is_missing, missing_text

LENGTH, TIME, HEAT, VOLUME_PART, MASS_PART, MOLE_PART = range(6)
_E = Fraction(1)

# SI prefixes.
SHORT_PREFIXES = {"p": Fraction(1, 10**12), "n": Fraction(1, 10**9), "u": Fraction(1, 10**6), "m": Fraction(1, 1000), "c": Fraction(1, 100), "d": Fraction(1, 10), "k": Fraction(1000)}
LONG_PREFIXES = {"pico": Fraction(1, 10**12), "nano": Fraction(1, 10**9), "micro": Fraction(1, 10**6), "milli": Fraction(1, 1000), "centi": Fraction(1, 100), "deci": Fraction(1, 10), "kilo": Fraction(1000)}
# Spelling -> (dimension, exponent of it, factor to SI, takes prefixes, zero point and step for temperatures).
_SHORT, _LONG, _NONE = "short", "long", ""
ROOTS: dict[str, tuple[int, int, Fraction, str]] = {
    "m": (LENGTH, 1, _E, _SHORT), "meter": (LENGTH, 1, _E, _LONG), "metre": (LENGTH, 1, _E, _LONG), "meters": (LENGTH, 1, _E, _LONG), "metres": (LENGTH, 1, _E, _LONG),
    "micron": (LENGTH, 1, Fraction(1, 10**6), _NONE), "microns": (LENGTH, 1, Fraction(1, 10**6), _NONE),
    "å": (LENGTH, 1, Fraction(1, 10**10), _NONE), "a": (LENGTH, 1, Fraction(1, 10**10), _NONE), "angstrom": (LENGTH, 1, Fraction(1, 10**10), _NONE), "angstroms": (LENGTH, 1, Fraction(1, 10**10), _NONE),
    "ångström": (LENGTH, 1, Fraction(1, 10**10), _NONE), "ångstrom": (LENGTH, 1, Fraction(1, 10**10), _NONE), "angström": (LENGTH, 1, Fraction(1, 10**10), _NONE),
    "l": (LENGTH, 3, Fraction(1, 1000), _SHORT), "liter": (LENGTH, 3, Fraction(1, 1000), _LONG), "litre": (LENGTH, 3, Fraction(1, 1000), _LONG), "liters": (LENGTH, 3, Fraction(1, 1000), _LONG), "litres": (LENGTH, 3, Fraction(1, 1000), _LONG), "cc": (LENGTH, 3, Fraction(1, 10**6), _NONE),
    "s": (TIME, 1, _E, _NONE), "sec": (TIME, 1, _E, _NONE), "second": (TIME, 1, _E, _NONE), "seconds": (TIME, 1, _E, _NONE),
    "min": (TIME, 1, Fraction(60), _NONE), "mins": (TIME, 1, Fraction(60), _NONE), "minute": (TIME, 1, Fraction(60), _NONE), "minutes": (TIME, 1, Fraction(60), _NONE),
    "h": (TIME, 1, Fraction(3600), _NONE), "hr": (TIME, 1, Fraction(3600), _NONE), "hrs": (TIME, 1, Fraction(3600), _NONE), "hour": (TIME, 1, Fraction(3600), _NONE), "hours": (TIME, 1, Fraction(3600), _NONE), "day": (TIME, 1, Fraction(86400), _NONE), "days": (TIME, 1, Fraction(86400), _NONE),
    "k": (HEAT, 1, _E, _SHORT), "kelvin": (HEAT, 1, _E, _NONE), "kelvins": (HEAT, 1, _E, _NONE),
    "c": (HEAT, 2, _E, _NONE), "°c": (HEAT, 2, _E, _NONE), "celsius": (HEAT, 2, _E, _NONE), "°celsius": (HEAT, 2, _E, _NONE),
    "f": (HEAT, 3, _E, _NONE), "°f": (HEAT, 3, _E, _NONE), "fahrenheit": (HEAT, 3, _E, _NONE), "°fahrenheit": (HEAT, 3, _E, _NONE),
}
# Words of a ratio's basis -> (basis, prefixes they take, cost: 0 for a word that names it, 1 for one that implies it).
BASIS_ROOTS = {
    "v": ("v/v", "", 0.0), "vol": ("v/v", "", 0.0), "volume": ("v/v", "", 0.0), "volumes": ("v/v", "", 1.0), "l": ("v/v", "mu", 1.0),
    "wt": ("w/w", "", 0.0), "weight": ("w/w", "", 0.0), "mass": ("w/w", "", 0.0), "masses": ("w/w", "", 1.0), "w": ("w/w", "", 1.0), "m": ("w/w", "", 1.0), "g": ("w/w", "mk", 1.0),
    "mol": ("mol/mol", "m", 0.0), "mole": ("mol/mol", "", 0.0), "molar": ("mol/mol", "", 0.0), "moles": ("mol/mol", "", 1.0),
}
#: Exponents beyond this belong to no unit.
HIGHEST = 6
# Dimension (length, time, heat) -> scale.
SCALES = {(1, 0, 0): "length", (3, -1, 0): "flow", (0, 0, 1): "kelvin", (0, 0, 2): "celsius", (0, 0, 3): "fahrenheit"}
#: How unlikely a scale is in a field, beside the cost of its spelling; scales that are not named cost `UNLIKELY`.
PRIORS = {"length": {"length": 0.0}, "flow": {"flow": 0.0}, "temperature": {"celsius": 0.0, "kelvin": 0.0, "fahrenheit": 0.0}}
UNLIKELY = 3.0


class Trie:
    """Finds every entry that begins at a place of a text."""

    def __init__(self, entries: dict[str, object]):
        self.root: dict = {}
        for word, what in entries.items():
            node = self.root
            for ch in word:
                node = node.setdefault(ch, {})
            node[""] = what

    def at(self, text: str, i: int) -> Iterator[tuple[int, object]]:
        node = self.root
        while True:
            if "" in node:
                yield i, node[""]
            if i >= len(text) or text[i] not in node:
                return
            node = node[text[i]]
            i += 1


_PREFIX_TRIE = Trie({k: (v, _SHORT) for k, v in SHORT_PREFIXES.items()} | {k: (v, _LONG) for k, v in LONG_PREFIXES.items()})
_ROOT_TRIE = Trie(ROOTS)
_EXPONENT_TRIE = Trie({lead + sign + n: int(sign + n) for lead in ("", "^", "**") for sign in ("", "-", "+") for n in "123"})
_SEPARATOR = re.compile(r" ?([/*·.]|(?<= )per ) ?| ()")


def clean(text: str) -> str:
    """Compatibility forms, minus signs, micro signs and bracketed exponents in one spelling."""
    t = unicodedata.normalize("NFKC", text).replace("−", "-").replace("–", "-").replace("μ", "u").replace("⋅", "·").replace("∙", "·")
    t = re.sub(r"\[\s*-\s*\]\s*\[?\s*(\d)\s*\]?", r"-\1", t)
    t = re.sub(r"\^\{\s*([+-]?\d)\s*\}", r"^\1", t)
    t = re.sub(r"\bdeg(?:ree|rees|\.)?\s*", "°", t, flags=re.I)
    t = re.sub(r"°\s+", "°", t)
    return re.sub(r"\s+", " ", t).strip()


def _ends(raw: str) -> dict[int, dict[tuple, float]]:
    """For every place at which a unit text may end: (sign, length, time, heat, factor) -> cost of the cheapest decomposition up to there."""
    low = raw.lower()
    n = len(low)
    if n != len(raw):
        raw = low
    starts: dict[int, dict[tuple, float]] = {0: {(1, 0, 0, 0, _E): 0.0}}
    ends: dict[int, dict[tuple, float]] = {}

    def put(where: dict[int, dict[tuple, float]], at: int, key: tuple, cost: float) -> None:
        if max(map(abs, key[1:3])) <= HIGHEST and cost < where.setdefault(at, {}).get(key, 1e9):
            where[at][key] = cost

    i = 0
    while i <= max(max(starts), max(ends, default=0)):
        for (sign, dl, dt, dh, f), cost in list(starts.get(i, {}).items()):
            for at, (pf, psize) in [(i, (_E, _NONE)), *((e, w) for e, w in _PREFIX_TRIE.at(low, i) if e > i)]:
                for end, (dim, power, rf, takes) in _ROOT_TRIE.at(low, at):
                    if psize and not takes:
                        continue
                    if end < n and low[end].isalpha() and low[end - 1].isalpha() and not low.startswith("per", end) and takes != _SHORT:
                        continue
                    c = cost + (0.5 if psize and psize != takes else 0) + (0.25 if psize else 0) + sum(0.05 for a, b in zip(raw[i:end], low[i:end]) if a != b and b not in "lcfkåa")
                    for stop, exp in [(end, 1), *((e, x) for e, x in _EXPONENT_TRIE.at(low, end) if e > end)]:
                        if stop < n and low[stop].isdigit():
                            continue
                        x = exp * sign
                        if dim == HEAT:
                            if exp != 1 or (dl, dt, dh) != (0, 0, 0):
                                continue
                            key = (sign, 0, 0, power, pf * rf)
                        else:
                            d = power * x
                            key = (sign, dl + d * (dim == LENGTH), dt + d * (dim == TIME), dh, f * (pf**x if power != 1 else pf**d) * rf**x)
                        put(ends, stop, key, c + 0.1 * (stop > end and low[end] not in "^*-"))
        for (sign, dl, dt, dh, f), cost in list(ends.get(i, {}).items()):
            if m := _SEPARATOR.match(low, i):
                put(starts, m.end(), (-1 if m[1] in ("/", "per ") else sign, dl, dt, dh, f), cost + 0.1)
        i += 1
    return ends


def _best(states: dict[tuple, float], kind: str) -> tuple[str, Fraction] | None:
    """The cheapest decomposition under the field's prior, if it has the field's dimension."""
    prior = PRIORS[kind]
    ranked = [(cost + prior.get(scale, UNLIKELY), scale, f) for (_, dl, dt, dh, f), cost in states.items() if (scale := SCALES.get((dl, dt, dh)))]
    if not ranked:
        return None
    _, scale, f = min(ranked, key=lambda r: (r[0], r[1] not in prior))
    return (scale, f) if scale in prior else None


@lru_cache(maxsize=65536)
def segment_unit(text: str, kind: str) -> tuple[str, Fraction] | None:
    """Scale and factor to SI of a whole unit text at a field of the given kind (length, temperature, flow), or None."""
    raw = clean(text).strip(" .,;")
    return _best(_ends(raw).get(len(raw), {}), kind) if raw else None


_LABELS = r"(?:(?:ca|approx|approximately|about|around|circa|roughly|nominal|nominally|t|temp|temperature|flow|rate|pore|pores|size|of|at|is|was)\b\.?|[=:~≈\"'(])"
_PLAIN = r"\d+(?:\.\d+)?|\.\d+"
_COMMA = r"[1-9]\d{0,2}(?:,\d{3})+(?:\.\d+)?|\d+,\d+"
_POWER = r"(?:e[+-]?\d+(?![\w.])|\s*[x×·*]\s*10\s*\^?\s*[+-]?\d+)?"
_QUANTITY = {c: re.compile(rf"^(?:\s*{_LABELS})*\s*([+-]?(?:{number}){_POWER})(?![\d])\s*-?\s*(.*?)[\s\"']*$", re.I | re.S) for c, number in ((False, _PLAIN), (True, f"{_COMMA}|{_PLAIN}"))}
_REMARK = re.compile(r"\s*[(\[]([^()\[\]\d]*)[)\]]?$")


def number_of(spelled: str) -> Fraction:
    """A number as written: with an exponent, thousands or a decimal comma."""
    t = spelled.lower()
    mantissa, _, power = re.sub(r"\s*[x×·*]\s*10\s*\^?\s*", "e", t).partition("e")
    thousands = re.fullmatch(r"[+-]?[1-9]\d{0,2}(?:,\d{3})+(?:\.\d+)?", mantissa)
    return Fraction(mantissa.replace(",", "" if thousands else ".")) * Fraction(10) ** min(99, max(-99, int(power or 0)))


FIELDS = {"pore_size": "length", "temperature_celsius": "temperature", "flow_rate": "flow"}
STANDARD = {"pore_size": ("length", Fraction(1, 10**10)), "temperature_celsius": ("celsius", _E), "flow_rate": ("flow", Fraction(1, 60 * 10**6))}


@lru_cache(maxsize=65536)
def read_quantity(text: str, comma: bool = False) -> tuple[str, str] | None:
    """(number as written, unit text) of a text that is one single quantity; a list or a range leaves an unreadable unit text."""
    if not (m := _QUANTITY[comma].match(clean(text))):
        return None
    rest = m[2]
    if remark := _REMARK.search(rest):
        rest = rest[: remark.start()] or remark[1]
    return m[1], rest.strip(" \"')")


@lru_cache(maxsize=65536)
def _leading_unit(rest: str, kind: str) -> tuple[str, Fraction] | None:
    """The unit of the longest run of words at the beginning that is one."""
    ends = _ends(rest)
    for stop in sorted(ends, reverse=True):
        if (stop == len(rest) or not rest[stop].isalnum()) and (unit := _best(ends[stop], kind)):
            return unit
    return None


def unit_in_evidence(number: str, evidence: str, kind: str) -> tuple[str, Fraction] | None:
    """The unit that a quotation gives right after the number itself."""
    if missing_text(evidence):
        return None
    value, text = number_of(number), clean(evidence)
    for m in re.finditer(rf"(?<![\d.,\w])(?:{_COMMA}|{_PLAIN})(?![\d])", text):
        if number_of(m[0]) == value:
            rest = re.split(r"[(\[;,]", text[m.end() :], maxsplit=1)[0].strip().rstrip(" .;")
            if unit := _leading_unit(rest[1:].strip() if rest.startswith("-") else rest, kind):
                return unit
    return None


def to_standard(field: str, number: Fraction, unit: tuple[str, Fraction]) -> int:
    """Å, hundredths of °C, µL/min, rounded half up."""
    scale, factor = unit
    if field == "pore_size":
        x = number * factor * 10**10
    elif field == "flow_rate":
        x = number * factor * 60 * 10**9
    else:
        x = {"celsius": number, "kelvin": number * factor - Fraction(27315, 100), "fahrenheit": (number - 32) * Fraction(5, 9)}[scale] * 100
    return (2 * x + 1).__floor__() // 2


def convert(field: str, text: str, evidence: str | None) -> tuple[str, str, bool] | None:
    """(standard value, where the unit was found, whether it was in another unit than the standard one)."""
    if not (q := _converted(field, text)):
        return None
    if isinstance(q, str):
        kind = FIELDS[field]
        if not isinstance(evidence, str) or not (unit := unit_in_evidence(q, evidence, kind)):
            return None
        return str(to_standard(field, number_of(q), unit)), "evidence", unit != STANDARD[field]
    return q


@lru_cache(maxsize=262144)
def _converted(field: str, text: str) -> tuple[str, str, bool] | str | None:
    q = read_quantity(text, comma=field != "pore_size")
    if not q:
        return None
    spelled, rest = q
    if not rest:
        return spelled
    unit = segment_unit(rest, FIELDS[field])
    return unit and (str(to_standard(field, number_of(spelled), unit)), "field", unit != STANDARD[field])


_BASIS_TRIE = Trie(BASIS_ROOTS)


@lru_cache(maxsize=65536)
def _basis_of(word: str) -> tuple[float, str] | None:
    """(cost, basis) of a word that is a root of a basis, with or without a prefix."""
    prefixes = [(0, ""), *((e, word[:e]) for e, _ in _PREFIX_TRIE.at(word, 0) if e)]
    found = [(cost + 0.25 * bool(p), basis) for i, p in prefixes for end, (basis, takes, cost) in _BASIS_TRIE.at(word, i) if end == len(word) and (not p or (len(p) == 1 and p in takes))]
    return min(found, default=None)


@lru_cache(maxsize=262144)
def ratio_basis(text: str) -> str | None:
    """The one basis (v/v, w/w, mol/mol) that a text names; None for none or for two that are named equally well.

    Words are cut at everything but letters and segmented as a whole. Words with digits (formulas) and unknown words (solvents) are skipped.
    """
    best: dict[str, float] = {}
    for w in re.findall(r"(?<![\w°])[^\W\d_]+(?![\w])", clean(text).lower()):
        if hit := _basis_of(w):
            best[hit[1]] = min(hit[0] >= 1, best.get(hit[1], 1))
    least = [b for b, cost in best.items() if cost == min(best.values())]
    return least[0] if len(least) == 1 else None


_OUT = "row_id bigint, field string, raw string, std_value string, unit_from string, differs boolean"


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out: list[tuple] = []
        for f in FIELDS:
            for i, v, e in zip(b["row_id"], b[f], b[f"e_{f}"]):
                if isinstance(v, str) and not missing_text(v) and (r := convert(f, v, e)):
                    out.append((i, f, v, *r))
        for i, v, e in zip(b["row_id"], b["units"], b["ratio"]):
            if missing_text(v):
                if not missing_text(e) and (r := ratio_basis(e)):
                    out.append((i, "mobile_phase_ratio_units", e, r, "ratio", True))
            elif r := ratio_basis(v):
                out.append((i, "mobile_phase_ratio_units", v, r, "field", v not in ("v/v", "w/w", "mol/mol")))
        yield pd.DataFrame(out, columns=["row_id", "field", "raw", "std_value", "unit_from", "differs"])


def standardize_quantities(records: DataFrame, id_col: str = "record_id") -> DataFrame:
    """One row per field that holds a single quantity or names a basis: its value in the field's unit, and whether it was written in another one.

    One map over the needed columns, no shuffle; rows without any of the fields are filtered before Python sees them.
    """
    ev = F.col("field_evidence")
    cols = [F.col(id_col).cast("bigint").alias("row_id")]
    for f in FIELDS:
        cols += [F.when(~is_missing(F.col(f)), F.col(f)).alias(f), ev[f].alias(f"e_{f}")]
    units = F.col("mobile_phase_ratio_units")
    cols += [F.when(~is_missing(units), units).alias("units"), F.when(is_missing(units), F.col("mobile_phase_ratio")).alias("ratio")]
    return records.select(*cols).where(F.coalesce(*FIELDS, "units", "ratio").isNotNull()).mapInPandas(_batches, _OUT)
