"""Every registered query against its SQL on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, compare
from ligneo.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
NAMES = [name for name in entry.queries() if name in QUERIES]  # the corpus operators have tests of their own


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    message, _, good = compare(spark, con, SF_DIR, name, entry.queries()[name], ORACLES.get(name))
    assert good, message


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry_imports_without_the_corpus_operators():
    """The optional package and its pipeline can be taken out; an error inside them is not swallowed."""
    root = str(Path(entry.__file__).parent)
    run = lambda setup: subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {root!r}); {setup}; import __spark_entry__ as e; "
                                        "print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"],
                                       capture_output=True, text=True, cwd=root)
    without = run("sys.modules['ligneo.llm'] = None; sys.modules['corpus_pipeline'] = None")
    assert without.returncode == 0 and without.stdout.split()[1] == "False" and int(without.stdout.split()[0]) > 100
    broken = run("sys.modules['pyspark.sql'] = None")
    assert broken.returncode != 0
