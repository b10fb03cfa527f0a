from types import SimpleNamespace

import pytest

from sitewise.llm import _common


def test_no_private_scratch_on_a_cluster():
    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        _common.scratch_root(far)


def test_tables_are_read_back(spark):
    made = _common.table(spark.range(10), "ten")
    assert made.count() == 10 and spark.sparkContext.applicationId in made.inputFiles()[0]
    _common.drop_table(made)
