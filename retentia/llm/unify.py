"""Visually identical text: one consistent form, touching only the unstable places.

The properties of the Unicode tables decide which characters are unstable: those whose normalization quick check (NFC) is No or
Maybe, combining marks, those that a compatibility form folds without changing their look (width, font, ligature and presentation forms, no-break
forms; not superscripts, fractions or circled signs), blanks other than the plain one, and characters without a look of their own.
A maximal run of unstable characters together with the stable one before it is a segment: nothing outside can
combine with it, so it is normalised alone and spliced into the unchanged rest. This is repeated until the text is stable.
Texts that pass the quick check in the JVM never reach Python.

Letters of another script count where they stand for a Latin letter: in a word that also has Latin letters, or in a word
made of look-alikes only. A word of another script with a letter that no Latin letter looks like is really written in
that script; Greek letters of chemical names (alpha, epsilon and so on) have no look-alike here.

Defined results: null stays null; tabs, line breaks and composed accents are left; a mark that no composed character takes up
belongs to the consistent form; empty and very long texts, ties and repeated rows are handled row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look like a Latin letter.
LOOKALIKES = {
    **dict(zip("АВЕЅІЈКМНОРСТУХ", "ABESIJKMHOPCTYX")),  # Cyrillic
    **dict(zip("аеіјорсѕухԁһԛԝ", "aeijopcsyxdhqw")),
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX")),  # Greek
    **dict(zip("οινρυϲϳ", "oivpucj")),
    **dict(zip("ՏՕՍԼհոսօցզ", "SOULhnuogq")),  # Armenian
    **dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏒᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZRSLCPKB")),  # Cherokee
    **dict(zip("ⲞⲢⲤⲎⲔⲘⲚⲦⲬ", "OPCHKMNTX")),  # Coptic
}
#: Kinds of places that are listed as departing; `compatibility`, `equivalent` and `separator` are put right as well.
DEPARTING = ("full-width", "blank", "invisible", "mark", "look-alike")
_BREAKS = "\t\n\x0b\x0c\r"
# Default-ignorable characters that are not format characters, and format characters that show.
_IGNORABLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x2065, 0x3164, *range(0xFE00, 0xFE10), 0xFFA0, *range(0xFFF0, 0xFFF9), *range(0xE0000, 0xE1000)}
_SHOWN = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD, *range(0x13430, 0x13440), *range(0x1BCA0, 0x1BCA4), *range(0x1D173, 0x1D17B)}
# All assigned characters but ideographs, syllables and private ones, which the standard keeps stable.
_LOOKED_AT = (range(0x3400), range(0xA000, 0xAC00), range(0xD7A4, 0xD800), range(0xF900, 0x20000), range(0x2F800, 0x2FA20), range(0xE0000, 0xE1000))
_FOLDED = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>", "<small>", "<square>", "<vertical>")


class Tables:
    """What the Unicode tables say: `fold` maps a character to (kind, text), `joining` may change with what stands before."""

    def __init__(self) -> None:
        self.fold: dict[str, tuple[str, str]] = {"‐": ("compatibility", "-"), "‑": ("compatibility", "-"), "\x85": ("separator", "\n"), " ": ("separator", "\n"), " ": ("separator", "\n")}
        self.joining: set[str] = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}  # vowels and finals of conjoining syllables
        for code in chain(*_LOOKED_AT):
            c = chr(code)
            category = unicodedata.category(c)
            if category in ("Cn", "Cs", "Co") and code not in _IGNORABLE:
                continue
            if code in _IGNORABLE or (category == "Cf" and code not in _SHOWN) or (category == "Cc" and c not in _BREAKS + "\x85"):
                self.fold[c] = "invisible", ""
            elif category == "Zs" and c != " ":
                self.fold[c] = "blank", " "
            elif c in self.fold:
                continue
            elif not unicodedata.is_normalized("NFC", c):
                self.fold[c] = "equivalent", unicodedata.normalize("NFC", c)
            elif unicodedata.combining(c):
                self.joining.add(c)
            elif (tag := unicodedata.decomposition(c).partition(" ")[0]) in _FOLDED and not 0x3131 <= code <= 0x318E:
                if " " not in (text := unicodedata.normalize("NFKC", c)):  # accents that stand alone fold to a blank and a mark
                    self.fold[c] = "full-width" if tag == "<wide>" else "compatibility", text
            elif (name := unicodedata.name(c, "")).startswith("LATIN LETTER SMALL CAPITAL ") and len(name) == 28:
                self.fold[c] = "compatibility", name[-1]
            if len(parts := unicodedata.decomposition(c).split()) == 2 and "<" not in parts[0]:
                second = chr(int(parts[1], 16))
                if unicodedata.normalize("NFC", chr(int(parts[0], 16)) + second) == c:
                    self.joining.add(second)
        for c in [k for k in self.joining if k in self.fold]:
            self.joining.discard(c)


def ranges(chars: Iterable[str], code: str) -> str:
    """A character class; `code` writes one code point."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join((code % a) + ("-" + code % b if b > a else "") for a, b in out)


@lru_cache(maxsize=1)
def tables() -> tuple[Tables, frozenset[str], frozenset[str]]:
    """The tables, the characters of a segment, and all that can make a text unstable."""
    t = Tables()
    unstable = frozenset({*t.fold, *t.joining})
    return t, unstable, unstable | set(LOOKALIKES)


def quick_check(c: Column) -> Column:
    """JVM side: false only for stable texts. Plain ASCII is asked first, the class of all unstable characters only for the rest."""
    t = tables()[0]
    every = ranges({*t.fold, *t.joining, *LOOKALIKES}, r"\x{%x}")
    return c.rlike(r"[^\x09-\x0d\x20-\x7e]") & c.rlike(f"[{every}]")


@lru_cache(maxsize=4096)
def _latin(c: str) -> bool:
    return unicodedata.name(c, "").startswith(("LATIN", "FULLWIDTH LATIN", "FEMININE", "MASCULINE"))


def _spliced(text: str, swaps: list[tuple[int, int, str]], origin: list[int]) -> tuple[str, list[int]]:
    out, new, at = [], [], 0
    for a, b, s in swaps:
        out += [text[at:a], s]
        new += origin[at:a] + [origin[a]] * len(s)
        at = b
    return "".join([*out, text[at:]]), new + origin[at:]


def _segments(text: str, origin: list[int], places: dict[int, str]) -> tuple[str, list[int]]:
    """Every segment in its normal form."""
    t, unstable, _ = tables()
    swaps = []
    runs: list[list[int]] = []
    for i, c in enumerate(text):
        if c in unstable:
            if runs and runs[-1][1] == i:
                runs[-1][1] = i + 1
            else:
                runs.append([max(0, i - 1), i + 1])  # with the stable character before it
    for a, b in runs:
        old = text[a:b]
        folded = "".join(t.fold[c][1] if c in t.fold else c for c in old)
        whole = unicodedata.normalize("NFC", folded)
        if whole != old:
            for k, c in enumerate(old, a):
                if c in t.fold:
                    places.setdefault(origin[k], t.fold[c][0])
                elif c in t.joining and whole != folded:
                    places.setdefault(origin[k], "mark")
            swaps.append((a, b, whole))
    return _spliced(text, swaps, origin)


_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")
_ANY_LOOKALIKE = re.compile(f"[{''.join(LOOKALIKES)}]")


def _letters(text: str, origin: list[int], places: dict[int, str]) -> tuple[str, list[int]]:
    """Letters that stand for Latin ones."""
    swaps = []
    for w in _WORD.finditer(text):
        if not _ANY_LOOKALIKE.search(w[0]):
            continue
        foreign = [(w.start() + k, c) for k, c in enumerate(w[0]) if c.isalpha() and not _latin(c)]
        stands = [(i, c) for i, c in foreign if c in LOOKALIKES]
        if len(foreign) < sum(map(str.isalpha, w[0])) or len(stands) == len(foreign):
            for i, c in stands:
                places.setdefault(origin[i], "look-alike")
                swaps.append((i, i + 1, LOOKALIKES[c]))
    return _spliced(text, swaps, origin)


@lru_cache(maxsize=65536)
def unify(text: str) -> tuple[str, tuple[tuple[int, str], ...]]:
    """(consistent form, places (index, kind) that departed from it)."""
    if tables()[2].isdisjoint(text):
        return text, ()
    places: dict[int, str] = {}
    done, origin = text, list(range(len(text)))
    while True:
        new, origin = _letters(*_segments(done, origin, places), places)
        if new == done:
            return done, tuple(sorted(places.items()))
        done = new


_OUT = "table_id string, row_id bigint, field string, canonical string, places string, n_places int"


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for t, i, f, v in zip(b["table_id"], b["row_id"], b["field"], b["value"]):
            new, places = unify(v)
            if places:
                out.append((t, i, f, new, " ".join(f"{p}:{k}" for p, k in places), len(places)))
        yield pd.DataFrame(out, columns=["table_id", "row_id", "field", "canonical", "places", "n_places"]).astype({"n_places": "int32"})


def departing(df: DataFrame, table_id: str, id_col: str, fields: dict[str, Column]) -> DataFrame:
    """(table_id, row_id, field, canonical, places, n_places): the values that are not in the consistent form."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.when(quick_check(c), c).alias("value")) for n, c in fields.items()]))
    long = df.select(F.col(id_col).cast("bigint").alias("row_id"), pairs.alias("x")).select(F.lit(table_id).alias("table_id"), "row_id", "x.field", "x.value").where("value is not null")
    return long.mapInPandas(_batches, _OUT)
