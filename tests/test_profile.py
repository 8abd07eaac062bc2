from retentia.operators import profile as P
from tests.data import records, rows, with_clashes

COLS = ["column_name", "detector", "paper_doi", "column_mode"]


def found(df):
    return rows(P.departures(df, "load_id", COLS, {"paper_doi": P.DOI}, ("detector", "column_mode"), ("column_name", "paper_doi")))


def test_departures(spark):
    data = []
    for load in (1, 2, 3):
        for k in range(20):
            data.append({"record_id": 100 * load + k, "load_id": load, "detector": " uv " if k % 2 else "RI", "column_name": f"c{k}" if load != 3 or k < 8 else "same", "paper_doi": "10.5555/x.1" if load != 2 or k < 14 else f"doi {k}", "column_mode": None if load == 1 and k < 10 else "RP"})
    assert found(with_clashes(records(spark, data))) == [(1, "column_mode", "missing"), (2, "paper_doi", "pattern"), (3, "column_name", "concentration")]


def test_shift_and_singles(spark):
    data = [{"record_id": k, "load_id": 1 + k // 10, "detector": "a" if k < 10 else "b" if k % 10 < 5 else "A"} for k in range(20)]
    assert (1, "detector", "shift") in found(records(spark, data)) and (2, "detector", "shift") in found(records(spark, data))
    assert found(records(spark, data[:10])) == []
    assert found(records(spark, [])) == []
    assert found(records(spark, [{"load_id": 1}, {"load_id": 2}, {}])) == []


def test_profile_counts_and_power_sums(spark):
    data = [{"load_id": 1, "detector": "ab"}, {"load_id": 1, "detector": "abcd"}, {"load_id": 1, "detector": "N/A"}, {"load_id": 2, "detector": "abc"}]
    got = {(r["field"], r["load"]): r for r in P.profile(records(spark, data), "load_id", ["detector", "detector"], {"detector": "^a"}).collect()}
    r = got["detector", 1]
    assert (r["n_rows"], r["n_missing"], r["n_distinct"], r["n_violations"], int(r["length_s1"]), int(r["length_s2"])) == (3, 1, 2, 0, 6, 20)
    assert r["min_value"] == "ab" and r["max_length"] == 4 and r["length_shift"] == 0.0 and len(got) == 2
    assert (int(r["missing_s0"]), int(r["missing_s1"]), int(r["missing_s2"])) == (3, 1, 1) and abs(r["missing_difference"] - 1 / 3) < 1e-9
    assert r["distance"] == 1.0 and r["lead"] == 0.5


def test_a_load_without_id_is_a_load(spark):
    data = [{"load_id": None, "detector": "a"}] * 4 + [{"load_id": 1, "detector": "b"}] * 4
    assert (None, "detector", "shift") in found(records(spark, data))
