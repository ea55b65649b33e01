import os

import pytest

import __spark_entry__ as entry
from checks import stored, streams
from checks.oracles import all_oracles
from checks.queries import all_queries
from tickframe.session import fresh_path


def test_every_query_has_sql():
    found = all_oracles()
    assert set(all_queries()) == set(found | streams.oracles(found) | stored.oracles(found))
    assert set(all_queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the given tables")
def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[:3] == ["open_time", "symbol", "interval"]


def test_shared_folder_is_the_one_named(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert fresh_path(spark, "x").startswith(f"{named}/x-") and fresh_path(spark, "x") != fresh_path(spark, "x")
