from datetime import datetime, timedelta

from pyspark.sql import functions as F

from retentia.llm import recordhash, survivor
from tests.data import records, rows, with_clashes

T = datetime(2024, 1, 1)


def rec(i, **k):
    return {"record_id": i, "paper_id": "P", "critical_component": "PS, PMMA", "column_name": "Nucleosil C18, 100 Å", "stationary_phase_chemistry": "octyl-bonded silica; monolayer", "mobile_phase_ratio": "49.5/50.5", **k}


def test_formats_that_hide_copies(spark):
    data = [
        rec(1),
        rec(2, critical_component="pmma; ps", column_name="NUCLEOSIL-C18,100Å.", stationary_phase_chemistry="monolayer , octyl_bonded silica*"),
        rec(3, mobile_phase_ratio=" (49.5 : 50.5) "),
        rec(4, mobile_phase_ratio="495/505"),
        rec(5, mobile_phase_ratio="49.55/0.5"),
        rec(6, paper_id="Q"),
        rec(7, column_name=None),
        rec(8, column_name=" n/A "),
        rec(9, column_name="?"),
        rec(10, column_name="Nucleosil C181, 00 Å"),
    ]
    assert rows(recordhash.copy_groups(with_clashes(records(spark, data)))) == [(1, 2), (1, 3), (7, 8)]


def test_limits_of_numbers_count_in_ratios(spark):
    data = [rec(k, mobile_phase_ratio=r) for k, r in enumerate(["1/23", "12/3", "1-23", "1:23.", "1,23", "1.23", "1 23", "0.5/.5", "30 vol.% H2O", "30vol%h2o."])]
    assert rows(recordhash.copy_groups(records(spark, data))) == [(0, 2), (0, 3), (0, 4), (0, 6), (8, 9)]


def test_edges(spark):
    assert recordhash.copy_groups(records(spark, [])).count() == 0
    long = "x, " * 20_000
    data = [{"record_id": 1}, {"record_id": 2}, {"record_id": 2}, {}, rec(3, critical_component=long), rec(4, critical_component=long.upper()), rec(5, critical_component="")]
    assert rows(recordhash.copy_groups(records(spark, data))) == [(1, 2), (3, 4)]
    assert rows(recordhash.conditions(records(spark, data[:2]))) == [(1, 2)]


def test_hot_group_stays_whole(spark):
    df = spark.range(3000).select(F.col("id").alias("record_id"))
    base = records(spark, [rec(0)]).drop("record_id")
    many = df.join(base, F.lit(True))
    assert recordhash.copy_groups(many).agg(F.count("*"), F.min("first_id"), F.max("first_id")).first()[:] == (2999, 0, 0)


EV = ("a", "b", None, "missed", None, None, "", None)


def test_best_record(spark):
    up = lambda i, d, conf, ev, **k: rec(i, run_ts=d, critical_condition_confidence=conf, field_evidence=ev, **k)
    data = [
        up(1, T, "unclear", EV),
        up(2, T + timedelta(days=1), "Explicit", EV),
        up(3, T, "explicit", None, paper_id="Q"),
        up(4, T + timedelta(days=1), "unclear", EV, paper_id="Q"),
        up(5, T, "explicit", EV, paper_id="R"),
        up(6, T, "explicit", EV, paper_id="R"),
        up(7, T, "explicit", EV, paper_id="S"),
    ]
    assert rows(survivor.best_records(with_clashes(records(spark, data)))) == [(1, 2)]
    assert survivor.best_records(records(spark, [])).count() == 0


def test_undated_records_are_placed_by_the_learned_order(spark):
    data = []
    for g in range(5):  # unclear comes before explicit everywhere
        data += [rec(100 + 2 * g, paper_id=f"L{g}", run_ts=T, critical_condition_confidence="unclear"), rec(101 + 2 * g, paper_id=f"L{g}", run_ts=T + timedelta(days=1), critical_condition_confidence="explicit")]
    data += [rec(1, run_ts=T, critical_condition_confidence="unclear"), rec(2, run_ts=None, critical_condition_confidence="explicit")]
    got = dict(rows(survivor.best_records(records(spark, data))))
    assert got[1] == 2 and got[100] == 101


def test_precedence_is_a_partial_order_without_cycles():
    assert survivor.precedence({(1, 2): 5, (2, 3): 4, (3, 1): 1}) == {(1, 2), (2, 3), (1, 3)}
    assert survivor.precedence({}) == set() and survivor.precedence({(1, 2): 3, (2, 1): 3}) == set()
    assert survivor.precedence({(0, 1): 2, (0, 2): 2, (3, 4): 1}) == {(0, 1), (0, 2), (3, 4)}  # 1 and 2 stay unordered


def test_repeated_rows_of_one_id_are_one_record(spark):
    up = lambda i, d: rec(i, run_ts=d, critical_condition_confidence="explicit", field_evidence=EV)
    data = [up(1, T), up(2, T + timedelta(days=1)), up(2, T + timedelta(days=1))]
    assert rows(survivor.best_records(records(spark, data))) == [(1, 2)]
    assert rows(recordhash.conditions(records(spark, data))) == [(1, 2)]
    assert survivor.survivors(records(spark, data)).first()["copies"] == 2


def test_undated_records_by_evidence_and_models(spark):
    """missed comes before filled in the evidence everywhere; nothing is known of the models' confidences."""
    ev = lambda v: (v, *[None] * 7)
    data = []
    for g in range(3):
        data += [rec(100 + 2 * g, paper_id=f"L{g}", run_ts=T, field_evidence=ev("missed")), rec(101 + 2 * g, paper_id=f"L{g}", run_ts=T + timedelta(days=1), field_evidence=ev("said"))]
    data += [rec(1, run_ts=T, field_evidence=ev("missed")), rec(2, run_ts=None, field_evidence=ev("said"))]  # filled after missed: not earlier than 1
    data += [rec(3, paper_id="Q", run_ts=T, field_evidence=ev("said")), rec(4, paper_id="Q", run_ts=None, field_evidence=ev("said"), model_confidences=("explicit", None))]  # nothing places the model's word
    data += [rec(k, paper_id="N", run_ts=None, field_evidence=ev(v)) for k, v in ((5, None), (6, "said"))]  # no dated record: equally late
    got = dict(rows(survivor.best_records(with_clashes(records(spark, data)))))
    assert got[1] == 2 and 3 not in got and got[5] == 6 and got[100] == 101


def test_survivor_is_built_field_by_field(spark):
    data = [
        rec(1, run_ts=T, critical_condition_confidence="explicit", field_evidence=("old", "only", None, None, None, None, None, None), model_confidences=("explicit", None)),
        rec(2, run_ts=T + timedelta(days=1), critical_condition_confidence="unclear", field_evidence=("new", "missed", None, None, None, None, None, None), model_confidences=("missed", "unclear")),
    ]
    s = survivor.survivors(records(spark, data)).first()
    assert (s["first_id"], s["copies"], s["confidence"], s["evidence_critical_condition_basis"], s["evidence_critical_component"], s["qwen"], s["mistral"]) == (1, 2, "explicit", "new", "only", "explicit", "unclear")


def test_survivor_places_undated_records(spark):
    ev = lambda v: (v, *[None] * 7)
    data = []
    for g in range(3):  # unclear comes before explicit everywhere
        data += [rec(100 + 2 * g, paper_id=f"L{g}", run_ts=T, critical_condition_confidence="unclear"), rec(101 + 2 * g, paper_id=f"L{g}", run_ts=T + timedelta(days=1), critical_condition_confidence="explicit")]
    data += [rec(1, run_ts=T, critical_condition_confidence="unclear", field_evidence=ev("dated")), rec(2, critical_condition_confidence="explicit", field_evidence=ev("later"))]
    got = {r["first_id"]: r for r in survivor.survivors(with_clashes(records(spark, data))).collect()}
    assert (got[1]["evidence_critical_condition_basis"], got[1]["confidence"], got[1]["copies"], len(got)) == ("later", "explicit", 2, 4)
