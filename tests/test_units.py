from fractions import Fraction

import pytest

from retentia.operators.units import convert, ratio_basis, segment_unit, standardize_quantities
from tests.data import records, rows, with_clashes


@pytest.mark.parametrize(
    ("field", "text", "evidence", "want"),
    [
        ("pore_size", "30 nm", None, "300"),
        ("pore_size", "5 NM", None, "50"),
        ("pore_size", "0.1 µm", None, "1000"),
        ("pore_size", "ca. 12.5 nm", None, "125"),
        ("pore_size", "12", "as stated, 12 nanometre; p. 12", "120"),
        ("temperature_celsius", "298.15 K", None, "2500"),
        ("temperature_celsius", "T = 77 °F", None, "2500"),
        ("temperature_celsius", "298", "Experimental: 298K was used, p. 4", "2485"),
        ("flow_rate", "500 ul min-1", None, "500"),
        ("flow_rate", "20 mL h⁻¹", None, "333"),
        ("flow_rate", "8.3 µL/s", None, "498"),
        ("flow_rate", "30", "Table lists 30 ml per hour [p. 3]", "500"),
        ("flow_rate", "1 cm3/h", None, "17"),
        ("flow_rate", "1,000 µL/min", None, "1000"),
        ("temperature_celsius", "298,15 K", None, "2500"),
        ("pore_size", "1e2 nm", None, "1000"),
        ("pore_size", "1 x 10^2 nm", None, "1000"),
        ("pore_size", "30 (nm)", None, "300"),
        ("flow_rate", "30 mL/h (isocratic)", None, "500"),
        ("flow_rate", "30 " + " ".join(["millilitres", "per", "hour"]), None, "500"),
        ("flow_rate", "30 " + " " * 100 + "mL · h^{-1}", None, "500"),
        ("pore_size", "12", "as stated, 12 " + " " * 90 + "nanometres wide; p. 12", "120"),
        ("flow_rate", "0.5", "a flow of 0.5 ml s-1 was kept for every one of the runs", "30000"),
    ],
)
def test_other_units(field, text, evidence, want):
    value, _, differs = convert(field, text, evidence)
    assert (value, differs) == (want, True)


@pytest.mark.parametrize(("field", "text"), [("pore_size", "100-Å"), ("pore_size", "100 angstrom"), ("temperature_celsius", "25 ℃"), ("temperature_celsius", "25 deg C"), ("flow_rate", "0.5 mL·min-1"), ("flow_rate", "0.5 mL min[-][1]"), ("flow_rate", "0,5 mL/min"), ("flow_rate", "1,000 mL/min"), ("flow_rate", "1 mL/min (isocratic)"), ("flow_rate", "1 milliliters per minute")])
def test_standard_units_in_any_spelling(field, text):
    assert convert(field, text, None)[2] is False


@pytest.mark.parametrize(("field", "text", "evidence"), [("pore_size", "6-8 nm", None), ("pore_size", "100 and 300 A", None), ("pore_size", "wide pore", None), ("pore_size", "100,300 nm", None), ("pore_size", "m" * 100_000, None), ("flow_rate", "5 " + "m/s " * 20_000, None), ("flow_rate", "5 mL/min (9 mL/min)", None), ("temperature_celsius", "between 293 and 303 K", None), ("flow_rate", "0.2 to 1.0 mL/min", None), ("flow_rate", "12", "Table lists 12 [p. 3]"), ("flow_rate", "12", "the value 13 mL/h was kept (p. 12)"), ("pore_size", "8", "the value 8 was kept throughout (p. 24)")])
def test_no_single_quantity(field, text, evidence):
    assert convert(field, text, evidence) is None


def test_ambiguous_letters_follow_the_field():
    assert segment_unit("A", "length")[1] == Fraction(1, 10**10)
    assert segment_unit("C", "temperature")[0] == "celsius" and segment_unit("C", "length") is None
    assert segment_unit("min", "length") is None


@pytest.mark.parametrize(("text", "want"), [("vol. % ACN", "v/v"), ("wt-% methanol", "w/w"), ("mole fraction", "mol/mol"), ("percent", None), ("%", None), ("v/v (THF/water)", "v/v"), ("85/15", None), ("44 vol.% H2O", "v/v"), ("g/g", "w/w"), ("mL water / mL THF", "v/v"), ("mmol", "mol/mol"), ("mg per mL", None), ("vol (ml) of 3 g", "v/v"), ("pg", None)])
def test_basis(text, want):
    assert ratio_basis(text) == want


def test_operator_with_nulls_repeats_long_texts_and_clashes(spark):
    ev = (None, None, None, None, None, None, "as stated, 12 nm; p. 12", None)
    data = [
        {"record_id": 1, "pore_size": "12", "field_evidence": ev, "mobile_phase_ratio": "40 wt.% THF"},
        {"record_id": 1, "pore_size": "12", "field_evidence": ev, "mobile_phase_ratio": "40 wt.% THF"},
        {"record_id": 2, "pore_size": "n/a", "temperature_celsius": "", "flow_rate": "x" * 100_000, "mobile_phase_ratio_units": "%"},
        {},
    ]
    got = rows(standardize_quantities(with_clashes(records(spark, data))).where("differs").select("row_id", "field", "std_value"))
    assert got == [(1, "mobile_phase_ratio_units", "w/w")] * 2 + [(1, "pore_size", "120")] * 2
    assert standardize_quantities(records(spark, [])).count() == 0
