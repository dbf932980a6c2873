"""The mentions behind disproportionality are counted once."""

from quillon.operators import dma
from quillon.sources import tables


def test_pairs_are_counted_once(spark, sf):
    plan = dma.disproportionality(tables.mentions(spark, sf))._jdf.queryExecution().toString()
    assert "lineitem" not in plan
