import subprocess
import sys
from pathlib import Path

import pytest

from retentia import catalog, common
from retentia.operators import matching, quality
from tests.data import records, rows


def test_every_oracle_belongs_to_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_catalog_without_the_training_data_operators(tmp_path):
    code = "import sys; sys.modules['retentia.llm'] = None; from retentia import catalog; print(len([q for q in catalog.queries() if q.startswith('p1_')]), 'p3_found' in catalog.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True)
    assert out.stdout.split() == ["0", "True"], out.stderr


@pytest.mark.parametrize("absent", ["xxhash", "tiktoken", "retentia.llm.reading"])
def test_core_queries_stay_without_what_the_training_data_operators_need(absent):
    code = f"import sys; sys.modules['{absent}'] = None; from retentia import catalog; q = catalog.queries(); print('p3_found' in q, 'summary_export' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True)
    assert out.stdout.split() == ["True", "True"], out.stderr


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, k, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    assert common.materialize(spark.range(3)).count() == 3


def test_metadata(spark):
    df = records(spark, [{"record_id": 1, "paper_id": "P", "model": "mistral-24b", "paper_doi": "m"}, {"record_id": 2, "paper_id": "P", "model": "qwen-27b", "paper_doi": ""}, {"record_id": 3, "paper_id": "P", "model": "qwen-27b", "paper_doi": "q"}])
    meta = quality.paper_metadata(df)
    assert meta.first()["paper_doi"] == "q" and meta.first()["publication_year"] is None
    assert rows(quality.stamp_metadata(df, meta).select("record_id", "paper_doi")) == [(1, "m"), (2, "q"), (3, "q")]


def test_judgements_and_contradictions(spark):
    a = spark.createDataFrame([("P", False, ""), ("Q", True, "x")], "paper_id string, requires_retry boolean, feedback string")
    b = spark.createDataFrame([("P", True, "y"), ("R", None, None)], "paper_id string, requires_retry boolean, feedback string")
    assert rows(quality.judgements(a, b)) == [("P", True, "y"), ("Q", True, "x"), ("R", False, None)]
    assert matching.contradictions({"column_name": "a", "analyte_polymer": "PS"}, {"column_name": "b", "analyte_polymer": "PMMA"}) == (1, 1)


def test_audit_counts(spark):
    got = dict(rows(quality.audit(records(spark, [{}, {"record_id": 1, "temperature_celsius": "130 °C", "notes": "Null"}]))))
    assert got["null_heavy"] == 2 and got["high_temperature"] == 1 and got["null_strings"] == 1
