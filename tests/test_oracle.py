"""Every registered query against its DuckDB oracle on the smallest data set."""

import pytest

import __spark_entry__ as E
from noteflare.plans.queries import QUERIES
from tests.oracle_compare import compare

SF = "/root/testdata/sf0.001"
FAST_SKIP = {"gbt_train_eval", "gbt_metrics", "gbt_rounds", "calibrated", "feature_importance", "split_counts",
             "model_influences", "model_roundtrip", "svd_project"}


@pytest.fixture(scope="module")
def results(spark):
    names = [n for n in QUERIES if n not in FAST_SKIP]
    return compare(spark, SF, names, verbose=False)


@pytest.mark.parametrize("name", sorted(n for n in E.oracle_sql() if n in QUERIES))
def test_query_matches_oracle(results, name):
    assert results[name] == "match", results[name]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["note_month", "n_notes", "next_flare_rate"]


def test_entry_imports_without_library_folders(tmp_path):
    """Queries and oracle load when the installed package has no jar folder to read."""
    import subprocess
    import sys

    code = ("import zipfile, glob\n"
            "zipfile.ZipFile = None\nglob.glob = lambda *a, **k: []\n"
            "import __spark_entry__ as e\nassert len(e.queries()) >= 60 and len(e.oracle_sql()) >= 50\n")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=E.__file__.rsplit("/", 1)[0])


def test_stop_words_equal_spark_default(spark):
    from pyspark.ml.feature import StopWordsRemover

    from noteflare.constants import ENGLISH_STOP_WORDS

    assert list(ENGLISH_STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")
