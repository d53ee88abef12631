import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from graphlift import catalog, fixtures

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_agree_with_sql(spark, sf_dir, oracle, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    found = df.collect()
    if name in catalog.ORACLES:
        expected = oracle.sql(catalog.ORACLES[name])
        assert sorted(df.columns) == sorted(expected.columns)
        assert canonical(map(tuple, found), df.columns) == canonical(expected.fetchall(), expected.columns)
    else:
        assert found


def test_all_groups_of_two_kept_nodes_are_returned(spark, sf_dir):
    """Orders and suppliers of one nation, by plain dictionaries: no order is left out, whatever its key."""
    read = lambda name, *cols: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols).collect()]
    nation, suppliers = dict(read("customer", "c_custkey", "c_nationkey")), read("supplier", "s_suppkey", "s_nationkey")
    orders = read("orders", "o_orderkey", "o_custkey")
    expected = sorted((6 * fixtures.KIND + o, 4 * fixtures.KIND + s, 1) for o, c in orders for s, n in suppliers if nation.get(c) == n)
    assert max(o for o, _, _ in expected) >= 6_000_000_200
    assert sorted(map(tuple, catalog.QUERIES["exact_grouped_by_two"](spark, sf_dir).select("q0", "q3", "weight").collect())) == expected


def test_entry_has_rows(spark, sf_dir):
    assert entry.entry(spark).count() > 0


def test_the_rest_works_without_the_subpackage():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("graphlift.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert names and not any(n.startswith("op") or n == "pipeline" for n in names), list(names)
assert set(e.oracle_sql()) <= set(names)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(entry.__file__).parent)
