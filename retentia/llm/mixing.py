"""Mixing sources to target weights: Efraimidis-Spirakis sampling against token budgets.

Every document gets an exponential key -ln(u)/w, u a hash of its id, text and the seed, w its quality weight; ascending keys are a
weighted sample without replacement. A source's budget is first met by complete epochs; what is left is filled in key
order up to the last document that fits a prefix sum of tokens. `max_repeats` is how often a document may appear at most.

The prefix sum is distributed: keys are mapped to [0, 1), token sums per (source, bin) are aggregated and the bin in which the
budget ends is split again until every source has few rows in it; rows whose keys are equal are split by a second random number
that each row got when it was written. Only the rows of that last bin are ever sorted together, whatever the size of a source. The
state of the search is a table with one row a source, joined over `SALTS` places, so the number of sources has no bound and no source is a
task of its own. Token counts are made once and written to the shared folder; the vocabulary travels with the job.

Defined results: documents without text have 0 tokens and are taken with their epoch; documents of no target source
(null too) are left out; targets without documents are reported with what was reached (0), a source named twice counts with
its first target; repeated rows are documents of their own; with no documents all reached shares are 0.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from retentia.common import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern of that public byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BINS, FEW, SALTS, ROUNDS = 1024, 20_000, 16, 5  # 1024^5 bins part any two keys; powers of two, so that no edge is rounded


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text_col: str, path: str = TOKENIZER, name: str = "tokens") -> DataFrame:
    """Adds the number of tokens of the whole text; 0 for none."""

    name_of_file = os.path.basename(path)
    df.sparkSession.sparkContext.addFile(path)

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(SparkFiles.get(name_of_file))
        for t in texts:
            yield t.map(lambda x: len(enc.encode_ordinary(x)) if isinstance(x, str) else 0).astype("int64")

    return df.withColumn(name, count(F.col(text_col)))


def quality_weight(text: Column) -> Column:
    """Between 0.05 and 1: share of letters and blanks, less for very short texts."""
    n = F.length(text).cast("double")
    letters = F.length(F.regexp_replace(text, r"[^\p{L} ]", "")).cast("double")
    return F.coalesce(F.greatest(F.lit(0.05), letters / F.nullif(n, F.lit(0.0)) * (0.5 + 0.5 * F.least(F.lit(1.0), n / 1000))), F.lit(0.05))


def uniform(seed: int, *c: Column) -> Column:
    """(0, 1) from a hash: the same for every run and every retried task."""
    return (F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(2**52)) + 0.5) / float(2**52)


def _salt(*c: str) -> Column:
    return F.pmod(F.xxhash64(*c), F.lit(SALTS)).cast("int")


def _with_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Rows beside the columns of their source; rows of other sources fall out."""
    every = per_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(every, ["source", "salt"])


def sized(documents: DataFrame, sources: DataFrame, seed: int, path: str) -> DataFrame:
    """(doc_id, source, tokens, x, y, salt): token count, the key mapped to [0, 1) and the second number, written once; the largest keys (some 740) stay below 1 and apart."""
    key = -F.log(uniform(seed, F.col("doc_id"), F.col("text"))) / quality_weight(F.col("text"))
    d = documents.where("source is not null").select("doc_id", "source", "text", (key / (key + 1)).alias("x"), uniform(seed + 1, F.monotonically_increasing_id()).alias("y"))
    d = _with_source(d.withColumn("salt", _salt("y")), sources.select("source"))
    return materialize(with_tokens(d, "text", path).select("doc_id", "source", "tokens", "x", "y", "salt"))


def plan(available: DataFrame, targets: DataFrame, total: int) -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, epochs, left): complete epochs and the tokens left for a fraction of every source."""
    t = targets.where("source is not null").groupBy("source").agg(F.min(F.struct(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("s"), F.coalesce(F.col("max_repeats"), F.lit(1)).cast("int").alias("m"))).alias("t"))
    t = t.join(available, "source", "left").select("source", F.col("t.s").alias("target_share"), F.col("t.m").alias("max_repeats"), F.coalesce("available_tokens", F.lit(0)).cast("bigint").alias("available_tokens"))
    want, have = F.floor(F.col("target_share") * total), F.nullif(F.col("available_tokens"), F.lit(0))
    t = t.withColumn("epochs", F.coalesce(F.least(F.col("max_repeats"), F.floor(want / have)), F.lit(0)).cast("int"))
    left = F.when((F.col("available_tokens") > 0) & (F.col("epochs") < F.col("max_repeats")), want - F.col("epochs") * F.col("available_tokens")).otherwise(0)
    return t.withColumn("left", left.cast("bigint"))


def _inside() -> Column:
    """Rows of the box in which the budget of their source ends."""
    return (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))


def _narrow(s: DataFrame, state: DataFrame, v: str, few: int) -> tuple[DataFrame, bool]:
    """The box of every source cut to the bin of `v` in which its budget ends; and whether every box holds few rows already."""
    width = F.col(f"{v}1") - F.col(f"{v}0")
    rows = _with_source(s, state.where("left > 0")).where(_inside())
    bins = materialize(rows.groupBy("source", F.floor((F.col(v) - F.col(f"{v}0")) / width * BINS).alias("b")).agg(F.sum("tokens").alias("t"), F.count("*").alias("n")))
    most = bins.groupBy("source").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= few:
        return state, True
    up_to = F.sum("t").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))  # at most BINS rows a source
    w = bins.withColumn("upto", up_to).join(state.select("source", "left"), "source")
    end = w.groupBy("source").agg(F.min(F.when(F.col("upto") > F.col("left"), F.struct("b", (F.col("upto") - F.col("t")).alias("used")))).alias("e"), F.max("upto").alias("all"))
    j = state.join(end, "source", "left")
    lo = F.when(F.col("all").isNull(), F.col(f"{v}0")).when(F.col("e").isNull(), F.col(f"{v}1")).otherwise(F.col(f"{v}0") + F.col("e.b") * width / BINS)
    hi = F.when(F.col("e").isNull(), F.col(f"{v}1")).otherwise(F.col(f"{v}0") + (F.col("e.b") + 1) * width / BINS)
    left = F.col("left") - F.coalesce(F.col("e.used"), F.when(F.col("e").isNull(), F.col("all")), F.lit(0))
    return materialize(j.withColumns({f"{v}0": lo, f"{v}1": hi, "left": left, "by_y": F.lit(v == "y")}).select(*state.columns)), False


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 11, tokenizer: str = TOKENIZER, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """(mix, shares): doc_id, source, tokens, copies of every chosen document; and target, available and reached tokens and shares per source."""
    s = sized(documents, targets.where("source is not null").select("source").distinct(), seed, tokenizer)
    available = s.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    total = total_tokens if total_tokens is not None else int(available.agg(F.sum("available_tokens")).first()[0] or 0)
    todo = materialize(plan(available, targets, total))

    # the box in which the budget ends: everything below it is chosen; without a budget it is empty
    corner = F.when(F.col("left") > 0, 1.0).otherwise(0.0)
    state = todo.select("source", "epochs", "left", F.lit(0.0).alias("x0"), corner.alias("x1"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("y1"), F.lit(False).alias("by_y"))
    for v in "x" * ROUNDS + "y" * ROUNDS:
        state, done = _narrow(s, state, v, few)
        if done:
            break

    rows = _with_source(s, state)
    below = (F.col("x") < F.col("x0")) | ((F.col("x") < F.col("x1")) & (F.col("y") < F.col("y0")))
    order = F.when(F.col("by_y"), F.col("y")).otherwise(F.col("x"))
    run = F.sum("tokens").over(Window.partitionBy("source").orderBy(order, "doc_id", "y").rowsBetween(Window.unboundedPreceding, 0))
    fill = rows.where(_inside()).withColumn("run", run).select("doc_id", "source", "tokens", (F.col("epochs") + (F.col("run") <= F.col("left")).cast("int")).alias("copies"))
    rest = rows.where(~_inside()).select("doc_id", "source", "tokens", (F.col("epochs") + below.cast("int")).alias("copies"))
    chosen = rest.unionByName(fill).where("copies > 0")
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached_tokens"), F.max("copies").alias("most_copies"))
    j = todo.select("source", "target_share", "max_repeats", "available_tokens").join(got, "source", "left").na.fill(0, ["reached_tokens", "most_copies"])
    whole = j.agg(F.sum("reached_tokens").alias("whole"))  # one row
    shares = j.join(F.broadcast(whole), F.lit(True)).withColumn("reached_share", F.coalesce(F.col("reached_tokens") / F.nullif(F.col("whole"), F.lit(0)), F.lit(0.0))).drop("whole")
    return chosen, shares
