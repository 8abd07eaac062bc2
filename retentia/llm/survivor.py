"""Best representative of each duplicate group, by currency reasoning.

Every field of a record is in one of a few states (missing, missed, filled, or how sure a confidence is). Transitions between
the states are learned from the timestamped records: within a group a state precedes another when it is first seen earlier, every group
votes, the majority direction of a pair is an edge, and an edge that would close a cycle loses against the heavier ones. The
transitive closure is a partial order per field; states without a path between them stay unordered.

A record without a time gets one per field: the latest time at which a dated record of its group shows a state that precedes or equals its
own. As a whole it is as late as the earliest of these, the time all its fields bear out; without one it counts as older than
any dated record. The best record is at least as full, as late and as sure as every other one. The survivor takes every field
from the latest record that has it, ties by the surer, then the fuller record, then the smaller id; its confidence is the surest.

Groups are never gathered: everything is max/min of small values over (group, state) and then over the group, so a group
with a third of all rows is merged map-side. What reaches the driver is one count per pair of states of a field.

Defined results: `missed` and missing entries are not filled; several rows with one id are one record if they say the same; equal
records (ties in all three) make no best one; groups of one give no row; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.common import is_missing, materialize, present, strip
from retentia.llm.recordhash import SALTS, canonical, digests

# Surety of a record, surest first.
SURETY = ("explicit", "strong_inference", "unclear")
EVIDENCE = ("critical_condition_basis", "critical_component", "column_name", "mobile_phase_solvents", "mobile_phase_ratio", "temperature_celsius", "pore_size", "flow_rate")
MODELS = ("qwen", "mistral")
MISSING, MISSED, FILLED = 0, 1, 2  # states; a confidence that is filled may be in a surer one
STATES = (6, 6, 6, *[3] * len(EVIDENCE))  # of the record's confidence, the models' confidences, the evidence entries


def surety(c: Column) -> Column:
    low = F.lower(strip(c))
    rank = F.lit(0)
    for k, v in enumerate(reversed(SURETY), 1):
        rank = F.when(low == v, k).otherwise(rank)
    return F.when(is_missing(c), 0).otherwise(rank)


def filled(c: Column) -> Column:
    return F.when(~is_missing(c) & (F.lower(strip(c)) != "missed"), c)


def state(c: Column, confidence: bool) -> Column:
    low = F.lower(strip(c))
    s = F.when(is_missing(c), MISSING).when(low == "missed", MISSED)
    if confidence:
        for k, v in enumerate(reversed(SURETY), FILLED + 1):
            s = s.when(low == v, k)
    return s.otherwise(FILLED)


def states(records: DataFrame, values: bool = False) -> DataFrame:
    """(root, form, id, ts, n_filled, sure, vec): the scores of every record beside its group; `vec` holds one digit per field, its state. With the filled values on request."""
    fields = [F.col("critical_condition_confidence"), *[F.col("model_confidences")[m] for m in MODELS], *[F.col("field_evidence")[f] for f in EVIDENCE]]
    keep = [F.concat(*[state(c, n == 6).cast("string") for c, n in zip(fields, STATES)]).alias("vec"), F.col("run_ts").alias("ts")]
    if values:
        keep += [(present(c) if k == 0 else filled(c)).alias(f"e{k}") for k, c in enumerate(fields)]
    entries = F.substring("vec", 2, len(STATES) - 1)
    n_filled, sure = F.length(F.translate(entries, "01", "")), F.substring("vec", 1, 1).cast("int") - FILLED
    out = digests(records, keep=tuple(keep))
    return out.select("root", canonical().alias("form"), "id", "ts", n_filled.alias("n_filled"), F.greatest(sure, F.lit(0)).alias("sure"), "vec", *[f"e{k}" for k in range(len(STATES)) if values])


def _state(k: int) -> Column:
    return F.substring("vec", k + 1, 1)


Order = list[set[tuple[int, int]]]


def learn_precedence(scored: DataFrame) -> Order:
    """For every field the pairs (a, b) of states with a before b, learned from the dated records of all groups."""
    dated = scored.where(F.col("ts").isNotNull())
    seen = [F.min(F.when(_state(k) == str(v), F.col("ts"))).alias(f"f{k}_{v}") for k, n in enumerate(STATES) for v in range(n)]
    first = dated.groupBy("root", F.xxhash64("form").alias("h")).agg(F.min("vec").alias("v0"), F.max("vec").alias("v1"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), *seen).where("v0 <> v1 and t0 < t1")
    each = F.array(*[F.struct(F.lit(k).alias("field"), F.array(*[F.struct(F.lit(v).alias("v"), F.col(f"f{k}_{v}").alias("t")) for v in range(n)]).alias("s")) for k, n in enumerate(STATES)])
    s = first.select(F.explode(each).alias("x")).select("x.field", "x.s")
    later = lambda a: F.transform(F.filter("s", lambda b: a["t"] < b["t"]), lambda b: F.struct(a["v"].alias("a"), b["v"].alias("b")))
    pairs = s.select("field", F.explode(F.flatten(F.transform("s", later))).alias("p"))
    counts: list[dict[tuple[int, int], int]] = [{} for _ in STATES]
    for r in pairs.groupBy("field", "p.a", "p.b").agg(F.count("*").alias("n")).collect():
        counts[r["field"]][r["a"], r["b"]] = r["n"]
    return [precedence(c) for c in counts]


def precedence(counts: dict[tuple[int, int], int]) -> set[tuple[int, int]]:
    """Transitive closure of the majority edges, heaviest first, without those that would close a cycle."""
    before: set[tuple[int, int]] = set()
    edges = []
    for a, b in combinations(sorted({v for ab in counts for v in ab}), 2):
        ab, ba = counts.get((a, b), 0), counts.get((b, a), 0)
        if ab != ba:
            edges.append((abs(ab - ba), *((a, b) if ab > ba else (b, a))))
    for _, a, b in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        if (b, a) not in before:
            up, down = {a, *(x for x, y in before if y == a)}, {b, *(y for x, y in before if x == b)}
            before |= {(x, y) for x in up for y in down}
    return before


def placed(scored: DataFrame, order: Order) -> DataFrame:
    """Adds the time of every field (t0, t1, ...) and of the record (`at`): its own where it has one, else as the partial order of its group has it."""
    fields = range(len(STATES))
    dated = scored.where(F.col("ts").isNotNull())
    known = dated.select("*", *[F.col("ts").alias(f"t{k}") for k in fields], F.col("ts").alias("at"))
    undated = scored.where(F.col("ts").isNull())
    if undated.isEmpty():
        return known
    groups = undated.select("root", "form").distinct()
    last = [F.max(F.when(_state(k) == str(v), F.col("ts"))).alias(f"l{k}_{v}") for k in fields for v in range(STATES[k])]
    seen = dated.select("root", "form", "ts", "vec").join(groups, ["root", "form"], "left_semi").groupBy("root", "form").agg(*last)
    seen = seen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # many undated records of one group meet it in as many places
    there = undated.withColumn("salt", F.pmod(F.xxhash64("vec", "n_filled", *([c for c in ("id", "lo") if c in scored.columns])), F.lit(SALTS)).cast("int")).join(seen, ["root", "form", "salt"], "left")
    none = F.lit(None).cast("timestamp")

    def latest(k: int) -> Column:
        t = none
        for v in range(STATES[k]):
            t = F.when(_state(k) == str(v), F.greatest(none, none, *[F.col(f"l{k}_{w}") for w in range(STATES[k]) if w == v or (w, v) in order[k]])).otherwise(t)
        return t

    there = there.withColumns({f"t{k}": latest(k).cast(scored.schema["ts"].dataType) for k in fields})
    every = F.when(sum((F.col(f"t{k}").isNull().cast("int") for k in fields), F.lit(0)) == 0, F.least(*[f"t{k}" for k in fields]))
    return known.unionByName(there.withColumn("at", every).select(*known.columns))


def best_records(records: DataFrame) -> DataFrame:
    """(first_id, best_id): groups in which one record is at least as full, as late and as sure as every other one and better than each in something.

    One shuffle on (group, state), written once; the order is learned from it, undated states are placed by it, and it is merged per group.
    """
    combos = materialize(states(records).groupBy("root", "form", "ts", "n_filled", "sure", "vec").agg(F.min("id").alias("lo"), F.max("id").alias("hi")))
    p = placed(combos, learn_precedence(combos)).select("root", "form", "at", "n_filled", "sure", "lo", "hi")
    # per group the greatest of each score, and the greatest state by all of them; a second record in that state would tie
    p = p.groupBy("root", "form", "n_filled", "at", "sure").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    top = F.struct(F.col("n_filled"), F.col("at").isNotNull().alias("timed"), "at", "sure", "lo", "hi")
    g = p.groupBy("root", "form").agg(F.min("lo").alias("first_id"), F.max("hi").alias("last_id"), F.max("at").alias("t"), F.max("sure").alias("s"), F.max(top).alias("top"))
    best = g.where("last_id > first_id and top.at <=> t and top.sure = s and top.lo = top.hi")
    return best.select("first_id", F.col("top.lo").alias("best_id"))


def survivors(records: DataFrame) -> DataFrame:
    """(first_id, copies, confidence, qwen, mistral, one column per evidence entry): each group's record built field by field."""
    full = states(records, values=True)
    names = ["confidence", *MODELS, *(f"evidence_{f}" for f in EVIDENCE)]
    p = placed(full, learn_precedence(full.select("root", "form", "ts", "vec")))

    def pick(k: int) -> Column:
        key = [F.col(f"t{k}").alias("at"), F.col("sure"), F.col("n_filled"), (-F.col("id")).alias("k")]
        surest = [F.col("sure").alias("first")] if k == 0 else []
        return F.max(F.when(F.col(f"e{k}").isNotNull(), F.struct(*surest, *key, F.col(f"e{k}").alias("v"))))["v"].alias(names[k])

    return p.groupBy("root", "form").agg(F.min("id").alias("first_id"), F.count_distinct("id").alias("copies"), *[pick(k) for k in range(len(STATES))]).drop("root", "form")
