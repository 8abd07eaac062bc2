"""Several values packed in one field: segmentation guided by a dictionary of known whole values.

Known whole values are those that fill a field alone, with or without commas, `and` and other weak delimiters inside, and pieces with
such delimiters that stand in quotes or between strong delimiters (`;`, `|`, line breaks) of two texts. Every piece of a packed text
between two places where a value may begin or end is looked up among all of them (just the matches an automaton over the
dictionary would give there, without holding it in memory); dynamic programming over these places then
picks the cheapest cover of the text by values and delimiters. A known value costs least, a value that the field's
grammar accepts more, an unknown one most; a delimiter inside a known value, in quotes, or inside what the grammar takes as one
value (`Last, First`, an address with its commas, a range) is protected because the cover without the cut is cheaper.

The dictionary has no bound and never leaves the executors: the pieces of the distinct packed texts are joined with the distinct
values, a frequent piece or text over `SALTS` places. A text is no evidence that its own whole is one value: for that it has
to be found between strong delimiters elsewhere. A value is not protected where it falls into pieces that are values themselves
(`80, 100`, or two full names): there, and for values found nowhere else, the grammar alone decides, by postcodes and the forms of names.

Defined results: missing fields and fields with a single value give no row; empty pieces do not count; repeated rows
are split alike; very long texts are cut by the same rules, a value may hold any number of delimiters: pieces are looked up as far as
the longest value of the dictionary that is one value reaches, what is longer is an unknown value or an address, and of these the
cheapest one that ends at a place is found from the costs alone; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.common import materialize, missing_text, present, strip

FIELDS = ("corresponding_author_name", "corresponding_email_address", "physical_address", "pore_size")
SALTS, WELL_FORMED, PER_DELIMITER = 32, 1.2, 1.4
# What may stand between two values.
DELIMITER = re.compile(r"\s*(?:\|\||[;|\n\r]|,|\s/\s|/|\s&\s|&|\s\+\s|\+|\s(?:and|or|und|oder)\s)(?:\s*(?:\|\||[;|\n\r,]|(?:and|or|und)\s))*\s*|\s+")
STRONG = re.compile(r"\|\||[;|\n\r]")
_NAME_WORD = r"[^\W\d_][\w.’'\-]*\*?"
_FULL = re.compile(rf"(?:{_NAME_WORD}\s+){{1,4}}{_NAME_WORD}$")
_LAST_FIRST = re.compile(rf"{_NAME_WORD}(?:\s+{_NAME_WORD}){{0,2}},\s*{_NAME_WORD}(?:\s+{_NAME_WORD}){{0,2}}$")
_MAIL = re.compile(r"[^\s@,;|/\"<>]+@[^\s@,;|/\"<>]+$")
_PORE_UNIT = r"(?:å|a|nm|um|µm|μm|angstroms?|ångströms?|nanomet(?:er|re)s?|microns?)"
_PORE = re.compile(rf"(?:ca\.?\s*)?\d+(?:\.\d+)?(?:\s*-?\s*{_PORE_UNIT}\.?)?$", re.I)
_PORE_RANGE = re.compile(rf"\d+(?:\.\d+)?\s*(?:-|–|—|to)\s*\d+(?:\.\d+)?(?:\s*{_PORE_UNIT}\.?)?$", re.I)


def may_be_packed(field: str) -> Column:
    """JVM-side filter: only texts that hold a possible delimiter reach Python."""
    c = F.col(field)
    if field == "corresponding_email_address":
        return c.rlike(r"@[\s\S]*@")
    if field == "physical_address":
        return c.rlike(r"[;|\n\r\"&+]|\s/\s|\s(?:and|or|und)\s|[0-9]{4,6} [^,]*,[^,]*,[^,]*,")
    if field == "pore_size":
        return c.rlike(r"[0-9][\s\S]*(?:[;|\n\r\"&+,/]|\s(?:and|or|und)\s)[\s\S]*[0-9]")
    return c.rlike(r"[;|\n\r\"&+,/]|\s(?:and|or|und)\s")


def _alone(field: str) -> Column:
    """The field's value if nothing strong parts it, else null."""
    v = strip(present(F.col(field)))
    # blanks may part mails
    return F.when(~v.rlike(r"[;|\"“”\s]|@.*@" if field == "corresponding_email_address" else r"[;|\n\r\"“”]"), v)


def known_values(records: DataFrame, delimited: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(field, piece, part, whole): whether a value is known as part of a text, and as the whole of one.

    `delimited` (field, key, piece): what stands in quotes or between strong delimiters of the text `key`.
    """
    long = records.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), _alone(f).alias("piece")) for f in fields])).alias("x"))
    alone = long.select("x.field", "x.piece", F.lit(True).alias("alone"), F.lit(None).cast("binary").alias("key")).where(F.col("piece").isNotNull())
    g = alone.unionByName(delimited.select("field", "piece", F.lit(False).alias("alone"), "key")).groupBy("field", "piece")
    g = g.agg(F.max("alone").alias("alone"), F.min("key").alias("k1"), F.max("key").alias("k2"))
    return g.select("field", "piece", (F.col("alone") | F.coalesce(F.col("k1") != F.col("k2"), F.lit(False))).alias("part"), F.col("k1").isNotNull().alias("whole"))


def _grammar(field: str, s: str) -> float | None:
    """Cost of taking `s` as one value: 1 well formed, None not a value; anything between is doubtful."""
    if field == "corresponding_email_address":
        return 1.0 if _MAIL.match(s) else 8.0 + s.count("@") * 20
    if field == "pore_size":
        if _PORE.match(s):
            return 1.0
        # 100-5, 300-3: pore size and particle size in a list; alone it reads as a range
        return 1.0 if _PORE_RANGE.match(s) else 6.0
    if field == "corresponding_author_name":
        if _LAST_FIRST.match(s) and not re.search(r"\s(?:and|or|und)\s", s):
            words = s.split(",")
            # "First Last, First Last" reads as two full names
            return 1.2 if len(words[0].split()) == 1 or len(words[1].split()) == 1 else 2.6
        if _FULL.match(s) and not re.search(r"\s(?:and|or|und)\s", s):
            return 1.0
        return 4.2 if re.match(rf"{_NAME_WORD}$", s) else 7.0
    # address: parts by comma, ends in a country after a part with a postcode
    if STRONG.search(s):
        return 20.0
    parts = [p.strip() for p in s.split(",")]
    codes = sum(1 for p in parts if re.match(r"\d{4,6}\s+\S", p) or re.search(r"\b\d{5}\b", p))
    if codes > 1:
        return 12.0 * codes
    if len(parts) < 3 or codes != 1:
        return 5.0 if len(parts) >= 2 else 6.0
    at = next(i for i, p in enumerate(parts) if re.search(r"\b\d{4,6}\b", p) and re.match(r"\d{4,6}\s+\S", p) or re.search(r"\b\d{5}\b", p))
    return 1.0 if at == len(parts) - 2 and not re.search(r"\s(?:and|or|und)\s", parts[-1]) else 4.0


def _delimiter_cost(d: str, field: str) -> float:
    t = d.strip()
    if "|" in t or ";" in t or "\n" in d or "\r" in d:
        return 0.1
    if not t:  # blanks alone part only quoted values and addresses of mail
        return 0.3 if field == "corresponding_email_address" else 30.0
    if t.lower() in ("and", "or", "und", "oder") and field == "physical_address":
        return 1.0
    return 0.4 if field != "physical_address" else 0.8 if t != "," else 1.5


_WEAK = re.compile(r"[,/&+]|\s(?:and|or|und|oder)\s")
_QUOTED = re.compile(r"\"([^\"]*)\"|“([^”]*)”")


def _quoted_values(s: str) -> list[str] | None:
    """The values of a text in which everything is in quotes."""
    quoted = [q for q in _QUOTED.finditer(s) if (q[1] or q[2] or "").strip()]
    if quoted and not re.sub(r"(?i)\b(?:and|or|und)\b|[\s;,|/&+.]", "", _QUOTED.sub("", s)):
        return [(q[1] or q[2]).strip() for q in quoted]
    return None


def _cuts(field: str, s: str) -> list[tuple[int, int]]:
    """The delimiters at which a value may end and the next one begin."""
    protected = [(q.start(), q.end()) for q in _QUOTED.finditer(s) if (q[1] or q[2] or "").strip()]
    cuts = [(m.start(), m.end()) for m in DELIMITER.finditer(s) if m.end() > m.start() and not any(a <= m.start() < b for a, b in protected)]
    if field not in ("corresponding_email_address",):
        cuts = [(a, b) for a, b in cuts if s[a:b].strip() or "\n" in s[a:b] or "\r" in s[a:b]]
    if field == "physical_address" and any(STRONG.search(s[a:b]) or s[a:b].strip() in ("/", "&", "+") for a, b in cuts):
        cuts = [(a, b) for a, b in cuts if s[a:b].strip() not in (",", "and", "or", "und")]
    return cuts


def _spans(s: str, cuts: list[tuple[int, int]], reach: int | None = None) -> Iterator[tuple[int, int, str]]:
    """(i, j, piece): what stands between cut i and cut j, by j; no piece runs over a strong delimiter, nor over more than `reach` others unless it stands between strong ones."""
    begins, ends = [0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(s)]
    n = len(begins)
    strong = [0, *(k for k, (a, b) in enumerate(cuts, 1) if STRONG.search(s[a:b])), n]
    for first, last in zip(strong, strong[1:]):
        for j in range(first + 1, last + 1):
            near = first if reach is None else max(first, j - 1 - reach)
            for i in (*range(j - 1, near - 1, -1), *([first] if j == last and near > first else [])):
                yield i, j, s[begins[i] : ends[j - 1]].strip().strip('"“”').strip()


def inner(field: str, text: str, most: int = 0) -> int:
    """`most`, or more delimiters inside what may be one value in a text of its own, or in a piece of it between strong delimiters."""
    s = text.strip()
    if not missing_text(s):
        for p in _quoted_values(s) or [p for p in STRONG.split(s) if p.strip()]:
            n = len(_cuts(field, p.strip()))
            if n > most and len(split_values(field, p)) < 2:  # only what is longer than all before is split
                most = n
    return most


def candidates(field: str, text: str, reach: int | None = None) -> set[tuple[str, str]]:
    """(kind, piece): what may be a value in a text (`part`, or `whole` if nothing else is in it), and what is `delimited`: in quotes or between strong delimiters."""
    s = text.strip()
    if missing_text(s):
        return set()
    if quoted := _quoted_values(s):
        return {("delimited", q) for q in quoted if _WEAK.search(q)}
    cuts = _cuts(field, s)
    n = len(cuts) + 1
    strong = [0, *(k for k, (a, b) in enumerate(cuts, 1) if STRONG.search(s[a:b])), n]
    spans = list(_spans(s, cuts, reach))
    full = [i for i, j, piece in spans if piece and j - i == 1]
    out = {("whole" if full and i <= full[0] and j > full[-1] else "part", piece) for i, j, piece in spans if piece} if n > 1 else set()
    if len(strong) > 2:
        ends = set(zip(strong, strong[1:]))
        out |= {("delimited", piece) for i, j, piece in spans if (i, j) in ends and _WEAK.search(piece)}
    return out


def _cost(field: str, piece: str, delimiters: int) -> float:
    """Grammar's cost of a piece; an unknown one costs more with every delimiter it swallows, but for the commas of an address."""
    c = _grammar(field, piece)
    return c if c <= 4.2 or field == "physical_address" else c + PER_DELIMITER * delimiters


def split_values(field: str, text: str, known: frozenset[str] = frozenset(), reach: int = 16) -> list[str]:
    """The values in `text`, in order; `reach`: the most delimiters inside a known value."""
    s = text.strip()
    if missing_text(s):
        return []
    if quoted := _quoted_values(s):
        return quoted
    cuts = _cuts(field, s)
    if not cuts:
        return [s.strip('"“” ')]
    begins, ends = [0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(s)]
    gap = [0.0, *(_delimiter_cost(s[a:b], field) for a, b in cuts)]
    n, reach = len(gap), max(reach, 2)  # the grammar of names, mails and sizes takes at most one delimiter in a value
    best = [0.0] + [1e18] * n
    came: list[tuple[int, str]] = [(0, "")] * (n + 1)
    at = {(i, j): piece for i, j, piece in _spans(s, cuts, reach)}
    starts = [0, *(k for k, (a, b) in enumerate(cuts, 1) if STRONG.search(s[a:b]))]
    # what an unknown piece pays per delimiter, and where the last two postcodes before a place begin
    pays = [0.0 if field == "physical_address" else -PER_DELIMITER * k - (20.0 * s.count("@", 0, b) if field == "corresponding_email_address" else 0.0) for k, b in enumerate(begins)]
    codes = [k for k, (a, b) in enumerate(zip(begins, ends)) for part in s[a:b].split(",") if re.match(r"\s*\d{4,6}\s+\S", part) or re.search(r"\b\d{5}\b", part)] if field == "physical_address" else []

    @lru_cache(maxsize=None)
    def value(i: int, j: int) -> bool:
        return not at[i, j] or at[i, j] in known or _grammar(field, at[i, j]) <= WELL_FORMED

    @lru_cache(maxsize=None)
    def parted(i: int, j: int) -> bool:  # into pieces that are values themselves
        return any(value(k, j) and (value(i, k) or parted(i, k)) for k in range(i + 1, j) if (i, k) in at and (k, j) in at)

    def take(i: int, j: int, piece: str) -> None:
        cost = 0.0 if not piece else 0.5 if piece in known and not parted(i, j) else _cost(field, piece, j - i - 1)
        if (c := best[i] + cost + gap[i]) < best[j]:
            best[j], came[j] = c, (i, piece)

    by_end: dict[int, list[int]] = {}
    for i, j in at:
        by_end.setdefault(j, []).append(i)
    paid: list[float] = []  # cost of all before a place, and of what follows as far as it grows with the length
    first = 0
    for j in range(1, n + 1):
        paid.append(best[j - 1] + gap[j - 1] + pays[j - 1])
        if j - 1 in starts:
            first = j - 1
        for i in by_end[j]:
            take(i, j, at[i, j])
        far = j - 1 - reach
        ranges = [(first, far)]
        if field == "physical_address":  # with one postcode inside, or with none; with two it is never one value
            behind = [k for k in codes[-2:] if k < j] if not codes or codes[-1] < j else [k for k in codes if k < j][-2:]
            one, two = (behind[-1] + 1 if behind else first), (behind[-2] + 1 if len(behind) > 1 else first)
            ranges = [(max(first, one), far), (max(first, two), min(far, one))]
        for lo, hi in ranges:
            if lo < hi:
                i = paid.index(min(paid[lo:hi]), lo, hi)
                take(i, j, s[begins[i] : ends[j - 1]].strip().strip('"“”').strip())
    out, j = [], n
    while j:
        j, piece = came[j]
        if piece:
            out.append(piece)
    return out[::-1]


def _inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    most: dict[str, int] = {}
    for b in batches:
        for f, t in zip(b["field"], b["text"]):
            most[f] = inner(f, t, most.get(f, 0))
    yield pd.DataFrame({"field": list(most), "n": list(most.values())}).astype({"field": "object", "n": "int32"})


def _with(reach: dict[str, int]) -> tuple:
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(f, k, *x) for f, k, t in zip(b["field"], b["key"], b["text"]) for x in candidates(f, t, reach[f])], columns=["field", "key", "kind", "piece"])

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(f, k, split_values(f, t, frozenset(() if w is None else w), reach[f])) for f, k, t, w in zip(b["field"], b["key"], b["text"], b["known"])]
            yield pd.DataFrame([x for x in out if len(x[2]) > 1], columns=["field", "key", "items"])

    return pieces, split


def split_packed(records: DataFrame, id_col: str = "record_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(row_id, field, pos, item): one row per value of every field that holds two or more, pos from 1.

    Texts that may be packed are split once each and come back to their rows by digest.
    """
    packed = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.when(may_be_packed(f), present(F.col(f))).alias("text")) for f in fields]))
    rows = records.select(F.col(id_col).cast("bigint").alias("row_id"), packed.alias("x")).select("row_id", "x.field", "x.text").where(F.col("text").isNotNull())
    rows = materialize(rows.withColumn("key", F.unhex(F.md5("text"))))
    texts = materialize(rows.select("field", "key", "text").dropDuplicates(["field", "key"]))
    longest = texts.mapInPandas(_inner, "field string, n int").groupBy("field").agg(F.max("n").alias("n")).collect()  # one row a field
    split_pieces, split_texts = _with({r["field"]: r["n"] for r in longest})

    pieces = texts.mapInPandas(split_pieces, "field string, key binary, kind string, piece string").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    pieces = materialize(pieces)
    asked = pieces.where("kind <> 'delimited'")
    values = known_values(records, pieces.where("kind = 'delimited'"), fields)
    found = asked.select("field", "piece", "salt").distinct().join(values, ["field", "piece"])
    hits = asked.join(found, ["field", "piece", "salt"]).where(F.when(F.col("kind") == "whole", F.col("whole")).otherwise(F.col("part")))
    known = hits.groupBy("field", "key").agg(F.collect_list("piece").alias("known"))  # at most the pieces of one text

    split = texts.join(known, ["field", "key"], "left").select("field", "key", "text", "known").mapInPandas(split_texts, "field string, key binary, items array<string>")
    salted = rows.select("row_id", "field", "key", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).alias("salt"))
    items = split.join(salted.select("field", "key", "salt").distinct(), ["field", "key"])
    out = salted.join(items, ["field", "key", "salt"]).select("row_id", "field", F.posexplode("items").alias("pos", "item"))
    return out.select("row_id", "field", (F.col("pos") + 1).cast("bigint").alias("pos"), "item")
