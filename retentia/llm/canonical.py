"""Free-entered values to a canonical list: prefix-filter set-similarity join.

Both sides are sets of letter pairs of the squashed text (letters and digits only, consistent characters). Tokens are ordered by
their rarity in the list, only the rare prefixes of both sides meet in an inverted index, length and position filters
cut pairs that cannot reach the threshold, the Jaccard similarity of the rest is computed exactly and the best is kept; an
edit distance relative to the length decides at last whether a typing error can explain the difference. A value is probed with its runs
of words, so sizes, grades, topologies and other additions stay out of the comparison; a run ends where it is longer than any
form of the list with all the typing errors it may have, so no entry is out of reach.

A list of at most `LIMIT` rows travels to the tasks as an index and the values never move: no shuffle, so a value that a third of
all rows share costs one probe per task. A longer list is taken in blocks of that size, and the best of all blocks is kept for every distinct value.

Defined results: missing values give no row, nor do values that are literally an entry; 0 where no entry is meant; the run
with the most explained letters wins, ties go to the longer run, then the smaller term_id; null array elements are skipped but keep their place; an empty table or list
gives no matches.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.common import materialize, missing_text
from retentia.llm.unify import unify

THRESHOLD, LIMIT, SHORT, SALTS = 0.25, 100_000, 4, 16
Match = tuple[int, float, float, int]  # term_id or 0, similarity, letters explained, length of the run


def squash(text: str) -> str:
    return re.sub(r"[\W_]+", "", text.lower())


def pairs_of(word: str) -> frozenset[str]:
    padded = f"^{word}$"
    seen: Counter = Counter()
    out = set()
    for a, b in zip(padded, padded[1:]):
        seen[a + b] += 1
        out.add(f"{a}{b}{seen[a + b]}")  # the second "ol" is another token than the first
    return frozenset(out)


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours."""
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before[j - 2] + 1)
        before, last = last, row
    return last[-1]


def errors(form: str) -> int:
    """Typing errors that a form of the list may have."""
    return max(1, round(len(form) / 4))


class Terms:
    """Inverted index over the rare prefixes of one field's entries and aliases."""

    def __init__(self, terms: list[tuple[int, str, str | None]], threshold: float = THRESHOLD):
        self.t = threshold
        forms: dict[str, int] = {}
        for term_id, name, alias in sorted(terms):
            for text in (name, alias):
                if isinstance(text, str) and (w := squash(unify(text)[0])):
                    forms.setdefault(w, term_id)
        self.exact = forms
        self.literal = {name for _, name, _ in terms}
        self.reach = max((len(w) + errors(w) for w in forms), default=0)
        long = [(w, k, pairs_of(w)) for w, k in forms.items() if len(w) >= SHORT]  # shorter ones are abbreviations: exact only
        self.rarity = Counter(t for *_, s in long for t in s)
        self.entries = [(w, k, self._ordered(s), s) for w, k, s in long]
        self.index: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for e, (_, _, tokens, _) in enumerate(self.entries):
            for pos, tok in enumerate(tokens[: self._prefix(len(tokens))]):
                self.index[tok].append((e, pos))

    def _ordered(self, s: frozenset[str]) -> list[str]:
        return sorted(s, key=lambda x: (self.rarity[x], x))

    def _prefix(self, n: int) -> int:
        return n - math.ceil(self.t * n) + 1

    def best_of(self, word: str, floor: float = 0.0) -> tuple[float, int] | None:
        """(similarity, term) of the most similar form above the threshold and not below `floor`, or None."""
        t = max(self.t, floor)
        s = pairs_of(word)
        n = len(s)
        tokens = self._ordered(s)
        overlap: dict[int, int] = {}
        for i, tok in enumerate(tokens[: n - math.ceil(t * n - 1e-9) + 1]):
            for e, j in self.index.get(tok, ()):
                m = len(self.entries[e][2])
                if m < t * n or n < t * m:
                    continue
                got = overlap.get(e, 0)
                if got >= 0:
                    need = math.ceil(t / (1 + t) * (n + m) - 1e-9)
                    overlap[e] = got + 1 if got + 1 + min(n - i - 1, m - j - 1) >= need else -1
        near = []
        for e, got in overlap.items():
            if got > 0:
                w, k, _, es = self.entries[e]
                common = len(s & es)
                if (sim := common / (n + len(es) - common)) >= t:
                    near.append((-sim, k, w))
        for sim, k, w in sorted(near):
            if edit_distance(word, w) <= errors(w):
                return -sim, k
        return None

    def runs(self, value: str) -> list[str]:
        """Squashed runs of neighbouring words that are not longer than anything the list can mean, longest first."""
        words = [q for w in re.split(r"[\s=,;()\[\]{}/\-]+", unify(value)[0]) if (q := squash(w))]
        out = set()
        for i in range(len(words)):
            run = ""
            for w in words[i:]:
                run += w
                if len(run) > self.reach:
                    break
                out.add(run)
        return sorted(out, key=lambda w: (-len(w), w))

    def match(self, value: str) -> Match:
        """The entry meant by a whole value."""
        runs = self.runs(value)
        best = (0.0, 0, 0.0, 0)  # weight of what is explained (similarity times length), term, similarity, length
        for w in runs:
            if len(w) > best[0] and (k := self.exact.get(w)) is not None:
                best = float(len(w)), k, 1.0, len(w)
        for w in runs:  # a longer run with an error may mean more than a shorter one without
            if len(w) >= SHORT - 1 and len(w) > best[0] and (b := self.best_of(w, best[0] / len(w))) and b[0] * len(w) > best[0]:
                best = b[0] * len(w), b[1], b[0], len(w)
        return best[1], best[2], best[0], best[3]


_OUT = "row_id bigint, field string, pos bigint, value string, term_id bigint, similarity double, weight double, run int"


def _map(values: DataFrame, rows: list, fields: tuple[str, ...]) -> DataFrame:
    """(..., term_id, similarity, weight, run) for rows of (row_id, one column per field, texts or arrays), by one block of the list. Literal entries give term_id null."""
    by_field: dict[str, list] = defaultdict(list)
    for r in rows:
        by_field[r["field"]].append((r["term_id"], r["entry_name"], r["alias"]))
    shared = values.sparkSession.sparkContext.broadcast(dict(by_field))
    ready: dict[str, Terms] = {}
    memo: dict[tuple[str, str], Match] = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in fields:
            if f not in ready:
                ready[f] = Terms(shared.value.get(f, []))
        for b in batches:
            out = []
            for f in fields:
                known, literal = ready[f], ready[f].literal
                for i, v in zip(b["row_id"], b[f]):
                    if v is None:
                        continue
                    for pos, x in enumerate([v] if isinstance(v, str) else v, 1):
                        if not isinstance(x, str) or missing_text(x):
                            continue
                        if x in literal:
                            out.append((i, f, pos, x, None, 1.0, 0.0, 0))
                            continue
                        hit = memo.get((f, x))
                        if hit is None:
                            if len(memo) > 200_000:
                                memo.clear()
                            hit = memo[(f, x)] = known.match(x)
                        out.append((i, f, pos, x, *hit))
            yield pd.DataFrame(out, columns=["row_id", "field", "pos", "value", "term_id", "similarity", "weight", "run"]).astype({"term_id": "Int64", "run": "int32"})

    return values.mapInPandas(run, _OUT)


def map_to_terms(records: DataFrame, terms: DataFrame, fields: tuple[str, ...], array_fields: tuple[str, ...] = (), id_col: str = "record_id", limit: int = LIMIT) -> DataFrame:
    """(row_id, field, pos, value, term_id, similarity): the entry of the list meant by every value that is not literally one."""
    listed = terms.select("field", "term_id", "entry_name", "alias").where(F.col("term_id").isNotNull() & F.col("entry_name").isNotNull())
    blocks = -(-listed.count() // limit)
    wide = records.select(F.col(id_col).cast("bigint").alias("row_id"), *fields, *array_fields)
    if blocks <= 1:
        return _map(wide, listed.collect(), (*fields, *array_fields)).where("term_id is not null").drop("weight", "run")
    # the distinct values meet every block; both sides of the way back are salted, a frequent value is no task of its own
    one = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.array(F.col(f)).alias("v")) for f in fields], *[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in array_fields])).alias("x")
    each = wide.select("row_id", one).select("row_id", "x.field", F.posexplode("x.v").alias("pos", "value")).where("value is not null")
    each = materialize(each.select("row_id", "field", (F.col("pos") + 1).cast("bigint").alias("pos"), "value", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).alias("salt")))
    asked = each.select("field", "value").distinct()
    pivot = materialize(asked.select(F.lit(0).cast("bigint").alias("row_id"), *[F.when(F.col("field") == f, F.col("value")).alias(f) for f in (*fields, *array_fields)]))
    got = None
    for n in range(blocks):
        part = listed.where(F.pmod(F.xxhash64("field", "term_id", "entry_name"), F.lit(blocks)) == n).collect()  # about `limit` rows
        m = _map(pivot, part, (*fields, *array_fields)).drop("row_id", "pos")
        got = m if got is None else got.unionByName(m)
    better = F.struct("weight", "run", (-F.col("term_id")).alias("t"), "similarity")
    best = got.groupBy("field", "value").agg(F.max(better).alias("b"), F.max(F.col("term_id").isNull()).alias("literal")).where("not literal")
    best = best.select("field", "value", F.when(F.col("b.weight") > 0, -F.col("b.t")).otherwise(0).cast("bigint").alias("term_id"), F.col("b.similarity").alias("similarity"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    return each.join(best, ["field", "value", "salt"]).select("row_id", "field", "pos", "value", "term_id", "similarity")
