import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomkit.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def rows(found):
    clean = lambda v: round(float(v), 6) if isinstance(v, float) else list(v) if isinstance(v, tuple) else v
    return sorted(repr([clean(v) for v in r]) for r in found)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert rows(tuple(r) for r in df.select(*columns).collect()) == rows(duck.execute(f"SELECT {quoted} FROM ({catalogue.ORACLE_SQL[name]})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_history_windows_share_one_exchange(spark):
    plan = catalogue.burst_counts(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_display_width_equals_sql_on_any_first_character(spark, tmp_path):
    """Wide characters of all planes, and letters whose upper case is several."""
    texts = [chr(c) + "x" for c in [*range(0x3000), *range(0xA640, 0xAC10), *range(0xF900, 0x11200), *range(0x1F000, 0x20010)]] + ["", None]
    docs = [(k, t) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = {r.doc_id: (r.width, r.initial) for r in catalogue.display_width(spark, str(tmp_path)).collect()}
    assert got == {r[0]: r[1:] for r in c.execute(f"SELECT doc_id, width, initial FROM ({catalogue.ORACLE_SQL['display_width']})").fetchall()}
    assert got[texts.index("ßx")] == (2, "SS") and got[texts.index("😀x")] == (3, "😀") and got[len(texts) - 2] == (0, None)
