"""Readers: nested record files, tables, logs, documents."""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.sources import schema


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Composed form of every text."""
    return s.map(lambda x: unicodedata.normalize("NFC", x) if isinstance(x, str) else None)


def _file() -> Column:
    """Plain file name: the metadata column is percent-encoded, `+` is not a blank there."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def envelopes(spark: SparkSession, path: str, pattern: str = "*.json", strict: bool = False, subfolders: tuple[str, ...] | None = None) -> DataFrame:
    """One row per file below `path`, with file name and subfolder; unreadable files give a row without data, or an error if strict."""
    r = spark.read.schema(schema.ENVELOPE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    r = r.option("mode", "FAILFAST") if strict else r.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    parent = F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"([^/]+)/[^/]+$", 1)
    df = r.json(path).select("*", _file().alias("file_name"), parent.alias("subfolder"))
    return df.where(F.col("subfolder").isin(*subfolders)) if subfolders else df


def base_name(file_name: Column) -> Column:
    """File name without the endings a run adds, in the order in which they are added last."""
    return F.regexp_replace(file_name, r"(_extracted_\d{8}_\d{6})?(_consensus)?(_latest)?\.json$", "")


def latest_files(files: DataFrame) -> DataFrame:
    """Per subfolder: the `_latest` files if there are any (first of composed/decomposed twins), else the last name of every base."""
    f = files.withColumn("base", nfc(base_name(F.col("file_name")))).withColumn("is_latest", F.col("file_name").endswith("_latest.json"))
    any_latest = f.groupBy("subfolder").agg(F.max("is_latest").alias("has_latest"))
    names = f.join(any_latest, "subfolder").where("is_latest = has_latest").groupBy("subfolder", "base", "is_latest").agg(F.min("file_name").alias("lo"), F.max("file_name").alias("hi"))
    chosen = names.select("subfolder", F.when(F.col("is_latest"), F.col("lo")).otherwise(F.col("hi")).alias("file_name"))
    return files.join(chosen, ["subfolder", "file_name"], "left_semi")


def conditions(envs: DataFrame, when_key_exists: bool = True) -> DataFrame:
    """One row per record with its place: the judge's list where that key exists (or, if asked, where it is not empty), else the extracted one."""
    judged, own = F.col("final_consensus.extracted_conditions"), F.col("extracted_data.conditions")
    use = judged.isNotNull() if when_key_exists else F.size(judged) > 0
    chosen = F.when(use, judged).otherwise(own)
    return envs.select("file_name", "subfolder", F.col("metadata.model").alias("model"), F.posexplode(F.coalesce(chosen, F.array().cast(f"array<{schema.RECORD}>"))).alias("cond_idx", "r")).select("file_name", "subfolder", "model", "cond_idx", "r.*")


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet of a workbook as text, cells in their columns."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        texts = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        for row in ElementTree.fromstring(z.read(first)).iter(f"{_SHEET}row"):
            cells: dict[int, str | None] = {}
            for c in row.iter(f"{_SHEET}c"):
                column = 0
                for letter in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                    column = column * 26 + ord(letter) - 64
                value, inline = c.find(f"{_SHEET}v"), c.find(f"{_SHEET}is")
                text = "".join(t.text or "" for t in inline.iter(f"{_SHEET}t")) if inline is not None else None if value is None else value.text
                cells[column - 1 if column else len(cells)] = texts[int(text)] if c.get("t") == "s" and text is not None else text
            yield [cells.get(k) for k in range(max(cells) + 1)] if cells else []


def xlsx_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(path, row, the named columns as text) of the first sheet of every workbook; the first row names the columns, one that is absent is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                rows = sheet_rows(bytes(content))
                head = {(h or "").strip(): k for k, h in enumerate(next(rows, []))}
                at = [head.get(c) for c in columns]
                yield pd.DataFrame([(p, n, *[r[k] if k is not None and k < len(r) else None for k in at]) for n, r in enumerate(rows, 2)], columns=["path", "row", *columns])

    fields = [T.StructField("path", T.StringType()), T.StructField("row", T.LongType()), *[T.StructField(c, T.StringType()) for c in columns]]
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, T.StructType(fields))


def parser_ready(parsers: list[Callable[[bytes], str]]) -> bool:
    """Whether any document parser is plugged in."""
    return bool(parsers)


def telemetry_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.TELEMETRY).json(path)


def ground_truth(table: DataFrame, order: str) -> DataFrame:
    """Last row per reference wins; rows without one are skipped."""
    return table.where("reference is not null").groupBy(F.col("reference")).agg(F.max_by(F.struct(*[c for c in table.columns if c not in ("reference", order)]), order).alias("r")).select("reference", "r.*")


def papers(files: DataFrame) -> DataFrame:
    """Distinct papers: names cut where the run part begins."""
    return files.select(F.split("file_name", "_extracted_|_latest|_consensus")[0].alias("paper")).distinct()


def pdf_texts(spark: SparkSession, path: str, parsers: list[Callable[[bytes], str]]) -> DataFrame:
    """(path, markdown, parser, error): every document by the first parser that does not fail; none is bundled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"]):
                error = "no parser"
                for k, parse in enumerate(parsers):
                    try:
                        rows.append((p, parse(bytes(content)), k, None))
                        break
                    except Exception as e:
                        error = str(e)
                else:
                    rows.append((p, None, None, error))
            yield pd.DataFrame(rows, columns=["path", "markdown", "parser", "error"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(run, "path string, markdown string, parser int, error string")
