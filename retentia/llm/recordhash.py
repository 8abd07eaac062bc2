"""Duplicates hidden by formatting: Merkle-style hashing of nested records.

Every field of a record is a leaf or a node. Leaves are normalised (case, blanks and punctuation dropped, a decimal point kept
inside its number); where order does not matter the parts between commas or semicolons are children whose digests are
sorted before they are hashed, in a ratio the numbers are children in order, so their limits count. The digest of a record
is the hash of its field digests. Records are grouped by root digest, and a group is confirmed by comparing the whole normalised
structure, so two different records that collide stay apart.

A third of all rows may be copies of one record: the structure is grouped together with a salt of the record's id first,
merged per group after that, and handed back per (root, salt), so no task ever holds a whole group.

Defined results: missing (null, blank, null/none/n/a) equals missing; a value of punctuation alone is an empty value, not a
missing one; null ids are ignored (a copy needs an id to be named); repeated rows with one id are one record; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.common import is_missing

UNORDERED = ("critical_component", "column_name", "stationary_phase_chemistry")
RATIO = "mobile_phase_ratio"
SALTS = 32


def _letters(c: Column) -> Column:
    """Letters and digits in lower case; a point between two digits stays."""
    low = F.lower(c)
    return F.regexp_replace(low, r"(?<![0-9])\.|\.(?![0-9])|[^\p{L}\p{N}.]", "")


def unordered_leaf(c: Column) -> Column:
    """Sorted normalised parts, joined: equal exactly for the same parts in any order."""
    parts = F.filter(F.transform(F.split(c, "[,;]"), _letters), lambda x: x != "")
    return F.when(~is_missing(c), F.array_join(F.array_sort(parts), ","))


def ratio_leaf(c: Column) -> Column:
    """Numbers and words in order; between two numbers the limit stays visible."""
    low = F.regexp_replace(F.lower(c), r"(?<![0-9])\.|\.(?![0-9])", "")
    marked = F.regexp_replace(low, r"(?<=[\p{N}])[^\p{L}\p{N}.]+(?=[\p{N}])", ":")
    return F.when(~is_missing(c), F.regexp_replace(marked, r"[^\p{L}\p{N}.:]|:(?![\p{N}])|(?<![\p{N}]):", ""))


def structure(fields: tuple[str, ...] = UNORDERED, ratio: str = RATIO) -> list[Column]:
    return [*[unordered_leaf(F.col(f)).alias(f"c{k}") for k, f in enumerate(fields)], ratio_leaf(F.col(ratio)).alias(f"c{len(fields)}")]


def _children(c: Column) -> Column:
    """Digest of a node from the digests of its sorted children."""
    return F.when(c.isNull(), F.lit(0).cast("bigint")).otherwise(F.aggregate(F.array_sort(F.transform(F.split(c, ","), lambda x: F.xxhash64(x))), F.lit(17).cast("bigint"), lambda a, x: F.xxhash64(a, x)))


def digests(df: DataFrame, scope: str = "paper_id", id_col: str = "record_id", keep: tuple[Column, ...] = ()) -> DataFrame:
    """(id, scope, c0.., root): the normalised structure of every record and its root digest."""
    n = len(UNORDERED)
    base = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(scope).alias("scope"), *structure(), *keep)
    leaves = [_children(F.col(f"c{k}")) for k in range(n)] + [F.xxhash64(F.lit(n), f"c{n}")]
    return base.withColumn("root", F.xxhash64("scope", *leaves))


def canonical(n: int = len(UNORDERED) + 1) -> Column:
    """The whole structure as one text that differs wherever the structure does (fields hold no control characters)."""
    return F.concat_ws("\x1e", F.coalesce(F.concat(F.lit("="), F.col("scope")), F.lit("-")), *[F.coalesce(F.concat(F.lit("="), F.col(f"c{k}")), F.lit("-")) for k in range(n)])


def copy_groups(df: DataFrame, scope: str = "paper_id", id_col: str = "record_id", salts: int = SALTS) -> DataFrame:
    """(first_id, copy_id): every record of a group but the one with the smallest id."""
    rows = digests(df, scope, id_col).select("id", "root", canonical().alias("form")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    part = rows.groupBy("root", "form", "salt").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    group = (
        part.groupBy("root", "form")  # grouping on the form is the full comparison of structures behind one digest
        .agg(F.min("lo").alias("first_id"), F.max("hi").alias("last_id"), F.collect_list("salt").alias("salts"))
        .where("last_id > first_id")
        .select("root", "form", "first_id", F.explode("salts").alias("salt"))  # at most `salts` rows a group, only those that exist
    )
    found = rows.join(group, ["root", "salt", "form"]).where("id > first_id")
    return found.select("first_id", F.col("id").alias("copy_id")).distinct()


def conditions(df: DataFrame, scope: str = "paper_id", id_col: str = "record_id") -> DataFrame:
    """(record_id, copies): the first record of every distinct condition and how many records it stands for."""
    rows = digests(df, scope, id_col).select("id", "root", canonical().alias("form"))
    return rows.groupBy("root", "form").agg(F.min("id").alias("record_id"), F.count_distinct("id").alias("copies")).select("record_id", "copies")
