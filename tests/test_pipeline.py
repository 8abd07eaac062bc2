"""Resolution, scores, documents, readers and sinks on small tables."""

import json
import unicodedata
from datetime import datetime

from pyspark.sql import functions as F

from retentia.operators import documents as docs
from retentia.operators import evaluate, extractors, quality, resolve, standardize
from retentia.operators import matching as M
from retentia.sources import readers, sinks
from tests.data import records, rows, with_clashes

T0, T1 = datetime(2024, 1, 1), datetime(2024, 2, 1)


def run(model, ts, start, specs, paper="P"):
    return [{"record_id": start + k, "paper_id": paper, "subfolder": "s", "model": model, "cond_idx": k, "run_ts": ts, **s} for k, s in enumerate(specs)]


SPEC = {"column_name": "Nucleosil C18", "mobile_phase_ratio": "49/51", "temperature_celsius": "25", "critical_component": "polystyrene", "critical_condition_confidence": "explicit"}


def sample():
    return (
        run("qwen-27b", T0, 1, [SPEC])
        + run("qwen-27b", T1, 10, [SPEC, {**SPEC, "mobile_phase_ratio": "49.5/50.5"}, {**SPEC, "mobile_phase_ratio": "90/10", "temperature_celsius": "40", "column_name": "Zorbax"}])
        + run("mistral-24b", T1, 20, [{**SPEC, "critical_component": "PS", "critical_condition_confidence": None}])
        + run("qwen-27b", T1, 30, [{}], paper="Q")
    )


def test_folds_take_the_latest_run_in_order(spark):
    df = with_clashes(records(spark, sample()))
    got = rows(resolve.dedup_runs(df).select("paper_id", "model", "record_id", "n_merged"))
    assert got == [("P", "mistral-24b", 20, 1), ("P", "qwen-27b", 10, 2), ("P", "qwen-27b", 12, 1), ("Q", "qwen-27b", 30, 1)]
    assert rows(resolve.pair_up(df)) == [("P", 10, 20)]
    assert rows(resolve.consensus(df).select("paper_id", "record_id", "qwen", "mistral")) == [("P", 10, "explicit", "unclear"), ("P", 12, "explicit", "missed"), ("Q", 30, "unclear", "missed")]
    assert rows(resolve.programmatic(df).select("paper_id", "record_id", "n_sources")) == [("P", 10, 1), ("P", 12, 1), ("P", 20, 1)]
    assert resolve.consensus(records(spark, [])).count() == 0


def test_native_fold_equals_python(spark):
    got = {r["model"]: r["kept"] for r in resolve.native_fold(records(spark, run("a", T0, 1, [{"mobile_phase_ratio": str(x)} for x in (10, 11, 13, 12, 15, 40)]))).collect()}
    items = [{"mobile_phase_ratio": str(x)} for x in (10, 11, 13, 12, 15, 40)]
    assert got["a"] == ",".join(str(k + 1) for k in M.fold_keep_first(items, lambda a, b: M.ratio_match(a["mobile_phase_ratio"], b["mobile_phase_ratio"])))


def test_fingerprints_keep_the_fullest_first(spark):
    df = records(spark, [{"record_id": 1, "paper_id": "P", "column_name": "a"}, {"record_id": 2, "paper_id": "P", "column_name": " A ", "notes": "x"}, {"record_id": 3, "paper_id": "P", "column_name": "a", "notes": "y"}])
    assert rows(standardize.fingerprint_dedup(df)) == [(2, 3, 1, 3)]  # paper, column and notes


def test_fingerprints_read_the_cleaned_summary_cells(spark):
    full = {"paper_id": "P", "column_name": "a", "mobile_phase_ratio": "THF-50", "field_evidence": ("x", "y", None, None, None, None, None, None), "mobile_phase_solvents": ["THF"]}
    data = [
        {"record_id": 1, "paper_id": "p", "column_name": "A", "mobile_phase_ratio": "50"},  # a minus before a number is a dash
        {"record_id": 2, **full},  # quotations and solvents fill cells
        {"record_id": 3, "paper_id": "Q", "column_name": "null", "notes": "NULL"},
        {"record_id": 4, "paper_id": "Q", "aqueous_parameters": (None, False, None, None, None)},  # a salt that was not added fills nothing
        {"record_id": 5, "paper_id": "R", "temperature_celsius": "24.5"},
        {"record_id": 6, "paper_id": "R", "temperature_celsius": "24 °C"},  # halves go to the even number
        {"record_id": 7, "temperature_celsius": None},
    ]
    assert rows(standardize.fingerprint_dedup(records(spark, data)).select("record_id", "first_pos", "n")) == [(2, 1, 2), (3, 3, 2), (5, 5, 2), (7, 7, 1)]


def test_runs_without_a_time(spark):
    df = records(spark, run("qwen-27b", None, 1, [SPEC]) + run("mistral-24b", T0, 5, [SPEC]) + run("mistral-24b", None, 9, [SPEC, SPEC]))
    assert rows(resolve.latest_runs(df).select("model", F.size("items"))) == [("mistral-24b", 1), ("qwen-27b", 1)]
    assert rows(resolve.dedup_runs(df).select("record_id")) == [(1,), (5,)]
    assert rows(resolve.consensus(df).select("record_id", "qwen", "mistral")) == [(1, "explicit", "explicit")]


def test_evidence_is_merged_entry_by_entry():
    a, b = {"field_evidence": {"x": "A", "y": "A", "z": None}, "notes": "n"}, {"field_evidence": {"x": None, "y": "B", "z": "B"}, "notes": "m"}
    assert M.merge_consensus(a, b) == {"field_evidence": {"x": "A", "y": "B", "z": "B"}, "notes": "n"}
    assert M.merge_consensus({**a, "source_model": "qwen"}, b)["field_evidence"]["y"] == "A"
    assert M.merge_consensus({"field_evidence": None}, {}) == {"field_evidence": None}


def test_pairs_of_near_duplicates_are_counted(spark):
    one = lambda i, an, paper="P": {"record_id": i, "paper_id": paper, "subfolder": "s", **SPEC, "analyte_polymer": an}
    data = [one(1, "PS"), one(2, "ps "), one(3, "PMMA"), one(4, "PEG"), one(5, "PS", "Q"), one(6, "PS", "Q")]
    got = quality.near_duplicates(records(spark, data)).collect()
    brute = sum(1 for a in ("ps", "ps", "pmma", "peg") for b in ("ps", "ps", "pmma", "peg") if a < b)
    assert [(r["paper_id"], r["n_records"], r["n_analytes"], r["n_pairs"]) for r in got] == [("P", 4, 3, brute)]
    assert rows(quality.repeated(records(spark, data))) == [("s", "P", 1), ("s", "Q", 1)]


def test_position_consistency_compares_whole_records(spark):
    other = {**SPEC, "notes": "another note"}
    df = records(spark, run("qwen-27b", T0, 1, [SPEC]) + run("mistral-24b", T0, 5, [SPEC]) + run("qwen-27b", T0, 11, [SPEC], "Q") + run("mistral-24b", T0, 15, [other, {"column_name": "Zorbax"}], "Q") + run("mistral-24b", T0, 21, [SPEC], "R"))
    assert rows(resolve.position_consistency(df)) == [(3, 3, 1.0)]
    split = records(spark, run("qwen-27b", T0, 1, [{**SPEC, "notes": "a"}]) + run("mistral-24b", T0, 5, [{**SPEC, "notes": "b"}]))
    assert rows(resolve.position_consistency(split)) == [(1, 0, 0.0)]
    assert rows(resolve.position_consistency(records(spark, []))) == [(0, 0, 0.0)]


def test_words_of_null_one_level_down(spark):
    df = records(spark, [{"notes": "Null", "model_confidences": ("null", "x"), "aqueous_parameters": ("NULL", True, None, None, None)}])
    assert rows(quality.null_strings(df)) == [("aqueous_parameters.pH", 1), ("model_confidences.qwen", 1), ("notes", 1)]


def test_mean_score_and_names_of_references(spark):
    scores = spark.createDataFrame([("P", "a", "exact"), ("P", "b", "missing"), ("Q", "a", "partial")], "paper_id string, field string, status string")
    assert {r["mean_score"] for r in evaluate.summary(scores).collect()} == {0.5}
    ann = spark.createDataFrame([("Smith 2001", "x"), ("Other", "y")], "reference string, temperature string")
    names = spark.createDataFrame([("Smith 2001", "paper 7"), (None, "z")], "reference string, paper_id string")
    assert rows(evaluate.by_paper_name(ann, names)) == [("Other", "y"), ("paper 7", "x")]


def test_endings_of_file_names(spark):
    df = spark.createDataFrame([("a_latest.json",), ("a_consensus_latest.json",), ("a_extracted_20240101_101010_consensus.json",), ("a_extracted_20240101_101010.json",), ("a_latest_x.json",)], "n string")
    assert rows(df.select(readers.base_name(F.col("n")))) == [("a",)] * 4 + [("a_latest_x",)]


def test_split_text_counts_sections_once():
    calls = []
    text = "\n\n".join(f"word{k} " * 20 for k in range(200))
    parts = docs.split_text(text, 100, lambda t: calls.append(len(t)) or docs.count_tokens(t))
    assert "".join(parts) == text and all(docs.count_tokens(p) <= 100 for p in parts) and sum(calls) < 5 * len(text)


def test_audits_on_empty_and_null_rows(spark):
    for df in (records(spark, []), records(spark, [{}, {}]), with_clashes(records(spark, sample()))):
        for f in (quality.null_profile, quality.null_heavy, quality.flags, quality.exact_duplicates, quality.near_duplicates, quality.counts_rollup, quality.first_of_signature, quality.ratio_spellings):
            f(df).collect()
    assert rows(quality.agreement(records(spark, [{"model_confidences": ("explicit", "missed")}, {"model_confidences": ("unclear", "x")}, {}]))) == [("both", 1, 50.0), ("first only", 1, 50.0)]
    assert rows(quality.agreement(records(spark, [{"model_confidences": ("unclear", "x")}]), strict=True)) == [("second only", 1, 100.0)]


def test_scores(spark):
    gt = spark.createDataFrame([("P", ["polystyrene", "dextran"], None, "Nucleosil", None, "25", None, None), (None, ["x"], None, None, None, None, None, None)], "reference string, polymer_names array<string>, solvents array<string>, stationary_phase string, detectors array<string>, temperature string, flow_rate string, critical_range string")
    s = {r["field"]: (r["status"], r["matched"]) for r in evaluate.field_scores(records(spark, sample()), gt).collect()}
    assert s == {"polymer_names": ("partial", 1), "stationary_phase": ("exact", 1), "temperature": ("exact", 1), "solvents_mobile_phase": ("out_of_scope", 0), "detectors": ("out_of_scope", 0), "flow_rate": ("out_of_scope", 0), "critical_range": ("out_of_scope", 0)}
    assert rows(evaluate.paper_scores(evaluate.field_scores(records(spark, sample()), gt))) == [("P", round(2.5 / 3, 4))]


def test_chunks():
    text = "\n## ".join("word " * n for n in (5, 5, 30, 3))
    parts = docs.split_text(text, 12)
    assert "".join(parts) == text and all(docs.count_tokens(p) <= 36 for p in parts)
    assert docs.split_text("short", 12) == ["short"] and docs.split_text("", 5) == [""]


def test_chunk_table(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "w " * 50), (3, ""), (4, None)], "doc_id bigint, text string")
    got = rows(docs.chunk(df, 20).select("doc_id", "section"))
    assert (1, "Full Paper") in got and (2, "Part 1") in got and (3, "Full Paper") in got and not [g for g in got if g[0] == 4]
    assert rows(docs.fingerprints(df))[3][1:] == (None, None)


def test_files_round_trip(spark, tmp_path):
    folder = tmp_path / "in" / "PEG"
    folder.mkdir(parents=True)
    composed = "[121] Kr\u00fcger1996_latest.json"
    for name, n in ((composed, 2), (unicodedata.normalize("NFD", composed), 2), ("old_extracted_20240101_000000.json", 1)):
        (folder / name).write_text(json.dumps({"metadata": {"model": "m"}, "extracted_data": {"conditions": [{"analyte_polymer": f"x{k}"} for k in range(n)]}}))
    (folder / "broken_latest.json").write_text("{")
    env = readers.envelopes(spark, str(tmp_path / "in"))
    assert env.count() == 4
    kept = readers.latest_files(env)
    assert {unicodedata.normalize("NFC", r["file_name"]) for r in kept.collect()} == {composed, "broken_latest.json"} and kept.count() == 2
    assert rows(readers.conditions(kept).select("cond_idx", "analyte_polymer")) == [(0, "x0"), (1, "x1")]


def test_sinks(spark, tmp_path):
    df = records(spark, sample())
    sinks.write_summary(df, str(tmp_path / "summary"), True)
    back = readers.csv_table(spark, str(tmp_path / "summary"))
    assert back.columns == standardize.SUMMARY_HEADER and back.count() == df.count()
    sinks.write_standardized(df, str(tmp_path / "standard"))
    sinks.write_envelopes(df, str(tmp_path / "env"))
    assert spark.read.json(str(tmp_path / "env")).count() == 4
    changed = sinks.rewrite_changed(df, df.where("record_id <> 11"), str(tmp_path / "new"))
    assert rows(changed) == [("P", 1)] and spark.read.parquet(str(tmp_path / "new")).count() == df.count() - 2
    assert "| all | all | 6 |" in sinks.markdown_report(df)


def test_extractor_retries_only_failures(spark):
    class Flaky:
        def __init__(self):
            self.seen = []

        def answer(self, prompts):
            self.seen.append(len(prompts))
            return ['{"extracted_conditions": [{"analyte_polymer": "PS"}]}' if len(self.seen) > 1 or "good" in p else "oops" for p in prompts]

    df = spark.createDataFrame([(1, "good"), (2, "bad")], "doc_id bigint, prompt string").coalesce(1)
    out = extractors.call(df, "prompt", Flaky())
    assert rows(out.select("doc_id", "n_attempts", "success")) == [(1, 1, True), (2, 2, True)]
    assert rows(extractors.parse_answers(out, ["doc_id"]).select("doc_id", "analyte_polymer")) == [(1, "PS"), (2, "PS")]


def test_registry_and_provenance(spark):
    names = spark.createDataFrame([("mistral-small-24b",), ("my/own",)], "name string")
    got = {r["name"]: r["hf_id"] for r in extractors.model_config(spark, names).collect()}
    assert got["my/own"] == "my/own" and got["mistral-small-24b"].endswith("2501")
    p = extractors.provenance(spark.createDataFrame([(1, "abc"), (2, None)], "doc_id bigint, text string"), "v1", {"temperature": 0.1}).orderBy("doc_id").collect()
    assert p[0]["reproducibility"]["input"]["char_len"] == 3 and p[1]["reproducibility"]["input"]["sha256"] is None


def test_ground_truth_last_row_wins(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z")], "reference string, row_no int, v string")
    assert rows(readers.ground_truth(t, "row_no")) == [("a", "y")]


def test_stream(spark, tmp_path):
    from retentia.streaming import streams

    df = spark.range(10).select("id", F.timestamp_seconds(F.col("id") * 1800).alias("ts"), F.lit("k").alias("kind"), F.lit(1.0).alias("v"))
    df.write.parquet(str(tmp_path / "ev"))
    out = streams.drain(streams.windowed(streams.stream(spark, str(tmp_path / "ev"), df.schema), "ts", "kind", "v"), "t", ("window_start", "kind"))
    assert out.count() == 5 and out.agg(F.sum("n")).first()[0] == 10


def test_chunk_details_and_records_of_documents(spark):
    chunks = spark.createDataFrame([(1, 0, "Part 1", 5, "a"), (1, 1, "Part 2", 6, "b"), (2, 0, "Full Paper", 7, "c")], "doc_id bigint, chunk_index int, section string, token_count int, text string")
    answered = spark.createDataFrame([(1, 0, '{"extracted_conditions": [{"column_name": "A"}, {"column_name": "B"}]}', True), (1, 1, "no", False)], "doc_id bigint, chunk_index int, answer string, success boolean")
    assert rows(extractors.chunk_details(chunks, answered)) == [(1, 0, "Part 1", 5, True, 2, None), (1, 1, "Part 2", 6, False, None, "no readable answer"), (2, 0, "Full Paper", 7, False, None, "no readable answer")]
    assert rows(extractors.document_records(answered).select("doc_id", "chunk_index", "cond_idx", "column_name")) == [(1, 0, 0, "A"), (1, 0, 1, "B")]


def test_prompts_and_the_default_judge(spark):
    df = spark.createDataFrame([("25", None, "at 25")], "a string, b string, q string")
    asked = df.select(extractors.dispute_prompt("temperature_celsius", F.col("a"), F.col("b"), F.col("q"), F.lit(None)).alias("p"), extractors.validation_prompt(F.struct("a"), F.struct("q")).alias("v"), extractors.chat(F.col("a"), "be brief").alias("c")).first()
    assert "First: 25" in asked["p"] and "Second: none" in asked["p"] and '{"q":"at 25"}' in asked["v"]
    assert json.loads(asked["c"]) == {"messages": [{"role": "system", "content": "be brief"}, {"role": "user", "content": "25"}], "thinking": False}
    judge = extractors.RuleJudge()
    assert M.consensus([{"notes": "a"}], [{"notes": "b"}], judge.validate, judge.resolve)[0][0]["notes"] == "a"


def test_times_and_memory(spark):
    from retentia.operators import telemetry

    df = spark.createDataFrame([("2026-01-02T03:04:05.5Z", "2026-01-02T03:04:07Z", "N/A", "5"), ("2026-01-02 03:04:05", "02.01.2026 03:05:05", "1.5", "4"), ("?", None, None, "x")], "wall_start string, wall_end string, a string, b string")
    got = telemetry.durations(df).select("seconds", telemetry.gpu_delta(F.col("a"), F.col("b")).alias("d"))
    assert [tuple(r) for r in got.collect()] == [(1.5, None), (60.0, 2.5), (None, None)]


def test_workbooks(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Temp</t></is></c></row><row r="2"><c r="A2"><v>7</v></c><c r="C2" t="s"><v>1</v></c></row><row r="3"/></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Reference</t></si><si><r><t>25</t></r><r><t> C</t></r></si></sst>")
    assert rows(readers.xlsx_table(spark, str(tmp_path / "t.xlsx"), ["Reference", "Temp", "Absent"]).drop("path")) == [(2, "7", "25 C", None), (3, None, None, None)]
    assert not readers.parser_ready([])


def test_reports_and_removed_rows(spark, tmp_path):
    df = records(spark, sample())
    page = sinks.comparison_report(df, df.where("record_id <> 1"))
    assert "| s | P | 5 | 4 | -1 |" in page and "6 records before, 5 after" in page
    assert "| null_heavy |" in sinks.quality_report(df)
    assert rows(sinks.removed_rows(df, df.where("record_id <> 1")).select("record_id")) == [(1,)]
    sinks.write_master(df, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 6
