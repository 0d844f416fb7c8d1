"""Ids where there are more ballots than ids (F4)."""

from __future__ import annotations

import pytest

from psephos.operators import merge
from psephos.plans.merging import ballot_id_allocation


def test_orders_beyond_all_ids(spark, tmp_path, monkeypatch):
    """As at sixty times sf0.1: one order more than ids; the one without a free id has that of its place, as in the SQL."""
    monkeypatch.setattr(merge, "LAST_ID", merge.FIRST_ID + 98)
    spark.range(100).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.ballot: r.random_ballot_id for r in ballot_id_allocation(spark, str(tmp_path)).collect()}
    assert got == {k: merge.FIRST_ID + (k * 7_368_787 + 12_345) % 99 for k in range(100) if k % 10}


def test_sharing_only_beyond_the_free_ids(spark, monkeypatch):
    monkeypatch.setattr(merge, "LAST_ID", merge.FIRST_ID + 96)
    used = spark.createDataFrame([(merge.FIRST_ID + i,) for i in (0, 5, 96)], "random_ballot_id long")
    ids = [r.random_ballot_id for r in merge.allocate_ids(spark.range(1000, 1110), "id", used, shared=True).collect()]
    assert len(ids) == 110 and {merge.FIRST_ID + i for i in range(97) if i not in (0, 5, 96)} <= set(ids)
    assert len({*ids}) <= 97 and len(ids) - len({*ids}) <= 16
    with pytest.raises(ValueError, match="free"):
        merge.allocate_ids(spark.range(1000, 1110), "id", used)
