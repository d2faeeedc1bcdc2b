"""Every query against its SQL on the smallest tables, and the shape of plans."""
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import connect, difference
from postledger.operators import diff as D
from postledger.operators.skew import salted_join, top_n_per_group
from postledger.workload.views import current_postings, previous_state

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, con, name):
    text = difference(spark, con, SF, name, queries()[name], oracle_sql().get(name))
    assert text in (None, "no rows in both"), text


def test_entry(spark):
    assert entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_comparison_has_no_nested_loops_or_python(spark):
    text = plan(D.snapshot_diff(current_postings(spark, SF), previous_state(spark, SF)))
    for bad in ("NestedLoop", "Cartesian", "Python", "Pandas"):
        assert bad not in text


@pytest.mark.parametrize("name", ["page_text", "clean_html", "job_records", "decode_greenhouse", "decode_jsonld", "watch_diff", "classify_pages"])
def test_no_python_workers(spark, name):
    text = plan(queries()[name](spark, SF))
    assert "Python" not in text and "Pandas" not in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(D.detect_expired(current_postings(spark, SF), previous_state(spark, SF)))
    assert "text:string" not in text


def test_salted_join_and_top_n(spark):
    from pyspark.sql import functions as F

    big = spark.range(1000).select(F.when(F.col("id") < 900, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.col("id"))
    small = spark.createDataFrame([("hot", 1), ("950", 2)], "k string, v int")
    assert salted_join(big, small, ["k"], "inner", F.col("id")).count() == 901
    assert salted_join(big, small, ["k"], "left_anti", F.col("id")).count() == 99
    assert salted_join(big, small, ["k"], "left", F.col("id")).count() == 1000
    top = top_n_per_group(big, ["k"], [F.col("id").desc()], 3, F.col("id")).filter("k = 'hot'")
    assert sorted(r.id for r in top.collect()) == [897, 898, 899]


def test_comparison_reads_each_side_once(spark):
    """Besides the narrow list of sources, each side is scanned and joined once."""
    df = D.snapshot_diff(current_postings(spark, SF), previous_state(spark, SF))
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join FullOuter") == 1 and "LeftAnti" not in text
    assert text.count("text#") > 0 and sum("text#" in line for line in text.split("\n") if "Relation" in line) <= 3
