import pytest
from pyspark.sql import functions as F

from retentia.functions import scalars as S
from retentia.operators.standardize import standardize, standard_rows, summary_rows
from tests.data import records


def apply(spark, fn, value, ddl="string"):
    return spark.createDataFrame([(value,)], f"v {ddl}").select(fn(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(("v", "want"), [("wt-% methanol", "w/w"), ("v/v (THF/water)", "v/v"), ("% by volume", "v/v"), ("vol.%", "v/v"), ("wt.-%", "w/w"), ("null", None), (None, None)])
def test_ratio_units(spark, v, want):
    assert apply(spark, S.ratio_units, v) == want


@pytest.mark.parametrize(("v", "want"), [("85:15", [85, 15]), ("83/17", [83, 17]), ("84.55", [84.55, 15.45]), ("92", [92, 8]), ("64-35-1", [64, 35, 1]), ("60/40", [60, 40]), ("69.12 wt-% acetonitrile", [69.12, 30.88]), ("85:15 v/v", None), ("null", None), ("1.2.3", None)])
def test_ratio_parts(spark, v, want):
    assert apply(spark, S.ratio_parts, v)["components"] == want


def test_ratio_range(spark):
    r = apply(spark, S.ratio_parts, "20-30")
    assert (r["components"], r["lo"], r["hi"]) == (None, 20.0, 30.0)


@pytest.mark.parametrize(("v", "want"), [("0.5 mL min⁻¹", 0.5), ("0.5 ml/min", 0.5), ("0.5 mL min[-][1]", 0.5), ("1.0 mL/min", 1.0), ("20 µL/min", 20.0), ("null", None), (None, None)])
def test_flow(spark, v, want):
    assert apply(spark, S.flow_rate, v)["value"] == want


@pytest.mark.parametrize(("v", "want"), [("100 Å", 100), ("100-Å", 100), ("300A", 300), ("30 nm", 300), ("300", 300), ("null", None), ("5; 6", None)])
def test_pore(spark, v, want):
    assert apply(spark, S.pore_size, v)["value"] == want


def test_pore_list_and_range(spark):
    assert apply(spark, S.pore_size, "100 A and 300 A")["list"] == [100, 300]
    r = apply(spark, S.pore_size, "100-5, 300-5, 1000-7")
    assert (r["lo"], r["hi"], r["list"]) == (100, 5, None)


def test_temperature(spark):
    assert apply(spark, S.temperature, "25.0")["value"] == 25
    r = apply(spark, S.temperature, "15.0–35.0")
    assert (r["value"], r["lo"], r["hi"]) == (None, 15, 35)


@pytest.mark.parametrize(("v", "want"), [("Reverse Phase", "Reversed Phase"), ("Normal Phase", "Normal Phase"), (None, None), ("Mixed", "Mixed")])
def test_mode(spark, v, want):
    assert apply(spark, S.column_mode, v) == want


@pytest.mark.parametrize(("v", "want"), [("Linear homopolymer", "linear"), ("ring", "cyclic"), ("triblock copolymer", "triblock"), ("AB block copolymer", "diblock"), ("difunktionell", None), ("other block thing", "block copolymer")])
def test_architecture(spark, v, want):
    assert apply(spark, S.architecture, v) == want


@pytest.mark.parametrize(("v", "want"), [("Ring-PS", "polystyrene"), ("Ls-PS", "polystyrene"), ("it-PP", "polypropylene"), ("BO block", "poly(butene oxide)"), ("EO repeat unit", "poly(ethylene glycol)"), ("Star-PMMA", "poly(methyl methacrylate)"), ("foo", "foo"), (None, "")])
def test_canonical(spark, v, want):
    assert apply(spark, S.canonical_polymer, v) == want


@pytest.mark.parametrize(("v", "want"), [('<think>x</think>```json\n{"a": 1}\n```', '{"a": 1}'), ('so: {"a": 2} done', '{"a": 2}'), ("none", None), (None, None), ("[1]", None)])
def test_model_answer(spark, v, want):
    assert apply(spark, S.parse_model_answer, v) == want


def test_whole_record(spark):
    r = standardize(records(spark, [{"record_id": 1, "mobile_phase_solvents": ["water with 0.1% formic acid", "methanol"], "publication_year": "ca. 1995", "architecture": "Ring"}, {}])).orderBy("record_id").collect()
    assert r[1]["mobile_phase_solvents"] == ["water", "methanol"] and r[1]["aqueous_parameters"]["pH_modifier"] == "0.1% formic acid"
    assert r[1]["publication_year"] == 1995 and (r[1]["architecture_raw"], r[1]["architecture"]) == ("Ring", "cyclic") and r[0]["aqueous_parameters"] is None


def test_layouts(spark):
    df = records(spark, [{"record_id": 1, "notes": "NULL", "mobile_phase_solvents": ["a", "b"]}])
    assert len(summary_rows(df).columns) == 37 and len(standard_rows(standardize(df)).columns) == 45
    assert summary_rows(df).first()["Notes"] == "" and summary_rows(df).first()["Mobile Phase Solvents"] == "a, b"
