"""Scratch scopes: nothing stays behind, whatever was written or checkpointed inside."""

import os

import pytest

from lineforge.operators.common import cut_lineage
from lineforge.session import checkpoint_dir, scratch_path, scratch_scope


def test_a_scope_leaves_nothing(spark):
    base = checkpoint_dir(spark).removeprefix("file://")
    files = lambda: sorted(f for _, _, names in os.walk(base) for f in names)
    before, folders = files(), len(os.listdir(base))
    with scratch_scope(spark) as outer:
        spark.range(10).write.parquet(scratch_path(spark, "a"))
        assert cut_lineage(spark.range(5)).count() == 5
        with scratch_scope(spark) as inner:
            assert inner.startswith(outer)
            spark.range(3).write.parquet(scratch_path(spark, "b"))
        assert not os.path.exists(inner) and spark.read.parquet(scratch_path(spark, "a")).count() == 10
    assert files() == before and len(os.listdir(base)) <= folders + 1
    with pytest.raises(ValueError):
        with scratch_scope(spark):
            spark.range(3).write.parquet(scratch_path(spark, "c"))
            raise ValueError
    assert files() == before and len(os.listdir(base)) <= folders + 1
    assert cut_lineage(spark.range(4)).count() == 4 and scratch_path(spark, "x").startswith(checkpoint_dir(spark))
