import pytest

from retentia.operators.splitting import split_packed, split_values
from tests.data import records, rows, with_clashes

A, E, P, Q = "corresponding_author_name", "corresponding_email_address", "physical_address", "pore_size"
ONE, TWO = "Unit 4, Polymer Group, Rue Verte 1, 89612 Ostertal, Caldonia", "Faculty of Chemistry and Physics, Mill Lane 6, 60840 Lanfield, Estoria"


@pytest.mark.parametrize(
    ("field", "text", "want"),
    [
        (A, "Linello, Orla", ["Linello, Orla"]),
        (A, "Linello, Orla; Hartmund, Chidi", ["Linello, Orla", "Hartmund, Chidi"]),
        (A, "Linello, Orla and Hartmund, Chidi", ["Linello, Orla", "Hartmund, Chidi"]),
        (A, "Orla Linello, Chidi Hartmund, and M. Pelquist", ["Orla Linello", "Chidi Hartmund", "M. Pelquist"]),
        (A, "Orla Linello\nM. Pelquist ", ["Orla Linello", "M. Pelquist"]),
        (A, '"Linello, Orla" "Hartmund, Chidi"', ["Linello, Orla", "Hartmund, Chidi"]),
        (A, "Andrea Korander; Kaito Korberk;", ["Andrea Korander", "Kaito Korberk"]),
        (E, "a.b@c.test or d@e.test,", ["a.b@c.test", "d@e.test"]),
        (E, "a@b.test c@d.test", ["a@b.test", "c@d.test"]),
        (P, ONE, [ONE]),
        (P, f"{ONE}; \n{TWO};", [ONE, TWO]),
        (P, f"{ONE} / {TWO}", [ONE, TWO]),
        (P, f"{ONE} and {TWO}", [ONE, TWO]),
        (P, f"{ONE}, {TWO}", [ONE, TWO]),
        (Q, "20-28 nm", ["20-28 nm"]),
        (Q, "60 to 100 A", ["60 to 100 A"]),
        (Q, "100-5, 300-5, 1000-7", ["100-5", "300-5", "1000-7"]),
        (Q, "50, 120 and 4000Å", ["50", "120", "4000Å"]),
        (Q, "80/120 A", ["80", "120 A"]),
        (Q, "100;;300", ["100", "300"]),
        (Q, "50, 80, 100, 120, 300, 500, 1000, 4000 A", ["50", "80", "100", "120", "300", "500", "1000", "4000 A"]),
        (A, "Orla Linello, Chidi Hartmund, M. Pelquist, A. Baker, C. Dent, E. Fox, and G. Hill", ["Orla Linello", "Chidi Hartmund", "M. Pelquist", "A. Baker", "C. Dent", "E. Fox", "G. Hill"]),
        (P, "Lab 1, " + "Wing x, " * 20 + "89612 Ostertal, Caldonia", ["Lab 1, " + "Wing x, " * 20 + "89612 Ostertal, Caldonia"]),
        (P, "Lab 1, " + "Wing x, " * 20 + f"89612 Ostertal, Caldonia, {TWO}", ["Lab 1, " + "Wing x, " * 20 + "89612 Ostertal, Caldonia", TWO]),
    ],
)
def test_split(field, text, want):
    assert split_values(field, text) == want


def test_known_values_protect_their_delimiters():
    assert split_values(A, "Smith and Sons and Orla Linello", frozenset({"Smith and Sons"})) == ["Smith and Sons", "Orla Linello"]


@pytest.mark.parametrize(("field", "text", "n"), [(A, ", ".join(["Orla Linello", "M. Pelquist"] * 1000), 2000), (E, ", ".join(["a@b.test"] * 2000), 2000), (P, ", ".join([ONE] * 500), 500), (P, ", ".join(["no code"] * 2000), 1), (Q, " and ".join(["80", "100-5"] * 1000), 2000), (A, "x" * 100_001 + ", y", 1)])
def test_very_long_texts(field, text, n):
    assert len(split_values(field, text)) == n


def test_operator(spark):
    data = [{"record_id": 1, A: "Orla Linello; Chidi Hartmund", Q: "80|100"}, {"record_id": 2, A: "Orla Linello"}, {"record_id": 3, A: "; ".join(["Orla Linello"] * 3000)}, {"record_id": 4, A: "null", E: ""}, {}]
    got = rows(split_packed(with_clashes(records(spark, data))).where("row_id < 3"))
    assert got == [(1, A, 1, "Orla Linello"), (1, A, 2, "Chidi Hartmund"), (1, Q, 1, "80"), (1, Q, 2, "100")]
    assert split_packed(records(spark, data)).where("row_id = 3").count() == 3000
    assert split_packed(records(spark, [])).count() == 0


def test_rare_values_are_known_in_large_tables(spark):
    one, two = "Dept Y, High St, Leeds LS2 9JT, UK", "Dept Z, Low Rd, York YO1 7EP, UK"
    many = spark.range(44_000).selectExpr("id AS record_id", "concat('Dept A', lpad(id div 2, 6, '0'), ', Old Rd, Bath, UK') AS physical_address")
    few = spark.createDataFrame([(-1, one), (-2, two), (-3, f"{one} / {two}")], "record_id bigint, physical_address string")
    df = many.unionByName(few).selectExpr("*", *[f"CAST(null AS string) AS {c}" for c in (A, E, Q)])
    assert rows(split_packed(df)) == [(-3, P, 1, one), (-3, P, 2, two)]


def test_a_packed_text_is_no_evidence_for_itself(spark):
    got = split_packed(records(spark, [{"record_id": 1, E: "a@b.test c@d.test"}, {"record_id": 2, E: "a@b.test c@d.test,"}]))
    assert rows(got) == [(i, E, k, x) for i in (1, 2) for k, x in ((1, "a@b.test"), (2, "c@d.test"))]


def test_whole_values_with_delimiters_are_known(spark):
    data = [
        {"record_id": 1, A: "Smith and Sons and Orla Linello"},
        {"record_id": 2, A: "Smith and Sons"},
        {"record_id": 3, A: "Orla Linello, Chidi Hartmund, M. Pelquist"},
        {"record_id": 4, A: "Orla Linello, Chidi Hartmund"},  # two values: no protection for record 3
        {"record_id": 5, Q: "80, 100, 300"},
        {"record_id": 6, Q: "80, 100"},
        {"record_id": 7, Q: "80 mixed, narrow / 300"},
        {"record_id": 8, Q: "80 mixed, narrow"},
    ]
    got = [r for r in rows(split_packed(records(spark, data))) if r[0] in (1, 3, 5, 7)]
    want = {1: (A, ["Smith and Sons", "Orla Linello"]), 3: (A, ["Orla Linello", "Chidi Hartmund", "M. Pelquist"]), 5: (Q, ["80", "100", "300"]), 7: (Q, ["80 mixed, narrow", "300"])}
    assert got == [(i, f, k, x) for i, (f, v) in want.items() for k, x in enumerate(v, 1)]
