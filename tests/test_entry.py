"""The registry: names, statements, and a run of each query family at the smallest scale."""

import __spark_entry__ as entry
import pytest

SMALL = "/root/testdata/sf0.001"


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["rule_verdicts", "alert_view", "cosine_topk_per_clip", "quality_gates", "ap101", "chain_verify", "fusion_events", "plate_grammar"])
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0
