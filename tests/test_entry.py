"""The entry point works, with and without the training-data subpackage."""

import subprocess
import sys

import __spark_entry__ as entry


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert {r.segment for r in rows} >= {"overall", "warm"}


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_training_data():
    code = "import sys; sys.modules['larkspur.llm'] = None\nimport __spark_entry__ as e\nassert 'popularity_baseline' in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=entry.__file__.rsplit("/", 1)[0])
    assert done.returncode == 0, done.stderr
