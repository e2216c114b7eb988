"""Every query of the engine against its SQL, on the same tables in the other engine."""

import pytest

from shelfmark.plans import registry
from shelfmark.sources.catalog import VIEWS, Catalog, with_views

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_oracle(spark, sf, agree, name):
    agree(QUERIES[name](spark, sf), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", sorted(VIEWS))
def test_views_are_the_same_in_both_engines(spark, sf, agree, name):
    columns = [c for c, t in Catalog(spark, sf).table(name).dtypes if not t.startswith("array")]
    agree(Catalog(spark, sf).table(name).select(*columns), with_views(f"SELECT {', '.join(columns)} FROM {name}"))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_partition_count_changes_nothing(spark, sf):
    rows = []
    for n in ("1", "3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append([sorted(map(str, QUERIES[q](spark, sf).collect())) for q in ("r27_people_by_name_asc", "a7_duplicate_sets", "w4_eviction", "v2_dbscan_border_points", "w3_initial_revisions")])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows[0] == rows[1] == rows[2]
