"""Session helpers and the null vocabulary shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as a missing text (any case, after trimming).
MISSING_WORDS = ("", "null", "none", "n/a")
BLANKS = " \t\n\r\f\x0b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strip(c: Column) -> Column:
    """Trim blanks, tabs and line breaks at both ends."""
    return F.trim(c, F.lit(BLANKS))


def is_missing(c: Column) -> Column:
    """True for null and for every spelling of a missing text; never null."""
    return c.isNull() | F.lower(strip(c)).isin(*MISSING_WORDS)


def present(c: Column) -> Column:
    """The text as it is, or null where it is missing."""
    return F.when(~is_missing(c), c)


def missing_text(s: object) -> bool:
    """Python twin of `is_missing`."""
    return not isinstance(s, str) or s.strip().lower() in MISSING_WORDS


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Only a local session may do without: it gets a folder of its own."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="retentia-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        d = "file://" + d
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that is deleted when the driver's process ends; until then a frame that was returned may read it."""
    path = f"{shared_dir(spark)}/retentia/{name}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def materialize(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives the loss of executors, prunes columns later."""
    spark = df.sparkSession
    path = scratch(spark, "table")
    w = df.write.mode("error")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
