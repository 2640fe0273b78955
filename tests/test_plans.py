"""Plan assertions: native expressions only, partial aggregation, pruning and
pushdown at the scan, contract of the entry module."""

import pytest

import __spark_entry__ as E
from postlens.plans.catalog import CATALOG

SF = "/root/testdata/sf0.001"

NATIVE_QUERIES = [n for n in E.queries() if n in CATALOG and not n.startswith(
    ("ml_", "text_feature", "shallow_tree", "posts_dummies", "contfeats"))]


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_contract_keys():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(sql) >= 45


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["post_id", "comments_sentiment", "comments_nbr_mentions", "comments_nbr_verified"]
    assert df.count() > 0


@pytest.mark.parametrize("name", NATIVE_QUERIES)
def test_no_python_in_plan(spark, name):
    p = plan_text(E.queries()[name](spark, SF))
    assert not any(x in p for x in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "InPandas", "InArrow"))


def test_no_python_in_jobs_that_build_a_query(spark, tmp_dir):
    """Queries with quantiles run jobs while they are built: those are native too."""
    import glob
    import re
    import subprocess
    import sys
    code = f"""
import sys; sys.path.insert(0, {sys.path[0]!r}); sys.path.insert(0, {__import__("os").path.dirname(E.__file__)!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", "file://{tmp_dir}")
         .config("spark.eventLog.rolling.enabled", "false").config("spark.eventLog.compress", "false")
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
import __spark_entry__ as E
for q in ("posts_clean", "posts_wide"):
    E.queries()[q](spark, {SF!r}).count()
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, capture_output=True)
    logs = "".join(open(f, errors="replace").read() for f in glob.glob(tmp_dir + "/*") if "." != f[0])
    assert "HashAggregate" in logs
    assert not re.search(r"MapInPandas|MapInArrow|ArrowEvalPython|BatchEvalPython", logs)


def test_comment_features_partial_aggregate(spark):
    p = E.queries()["comment_features"](spark, SF)._jdf.queryExecution().executedPlan()
    s = p.toString()
    # map-side partial aggregation before the shuffle on post_id
    assert "partial_avg" in s and "partial_sum" in s
    assert "Sort " not in s.split("Exchange")[0]  # no ORDER BY on top


def test_scan_pruning_and_pushdown(spark):
    df = E.queries()["posts_with_location_url"](spark, SF)
    s = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id)]" in s
    # the documents scan reads only the key: the post text is pruned away
    assert "ReadSchema: struct<doc_id:bigint>" in s


def test_wide_has_single_join_to_comments(spark):
    df = E.queries()["posts_wide"](spark, SF)
    s = df._jdf.queryExecution().optimizedPlan().toString()
    # posts view contributes two joins; the wide table adds exactly one left join
    assert s.count("Join LeftOuter") == 1
