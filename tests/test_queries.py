import pytest

import __spark_entry__ as entry
from blurframe.plans import queries

from .compare import assert_same, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), con, queries.SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["pipeline_rt", "merge_gain_rounds"])
def test_merging_ends_by_its_own_rules(spark, sf_dir, monkeypatch, name):
    """The queries leave the number of merge rounds to the operator."""
    seen = []
    for f in ("quick_merge", "merge_rounds"):
        own = getattr(queries.merge, f)
        monkeypatch.setattr(queries.merge, f, lambda *a, own=own, **k: seen.append(k.get("max_rounds")) or own(*a, **k))
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
    assert seen == [None]


@pytest.mark.parametrize("name,order", [("rum_bound", "T"), ("tum_bound", "RT")])
def test_bounds_merge(spark, monkeypatch, name, order):
    """The clusters are merged, in the partner order of the reference's drivers, before items are anonymized."""
    seen, own = [], queries.merge.SerialMerger.__call__

    def call(self, encoded):
        out = own(self, encoded)
        seen.append((self.order, encoded.select("group_id").distinct().count(), out.select("group_id").distinct().count()))
        return out

    monkeypatch.setattr(queries.merge.SerialMerger, "__call__", call)
    rows = queries.QUERIES[name](spark, "/root/testdata/sf0.01").cache()  # the clusters of fewer rows lose more than the bound
    assert rows.groupBy("group_id").count().where(f"count < {queries.K}").isEmpty()
    assert len(seen) == 1 and seen[0][0] == order and rows.select("group_id").distinct().count() == seen[0][2] < seen[0][1]
