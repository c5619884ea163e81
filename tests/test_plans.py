"""Physical-plan properties that the scale design relies on."""
import re

import pytest

import __spark_entry__ as E
from conftest import SF01


def plan(spark, name):
    df = E.queries()[name](spark, SF01)
    return df._jdf.queryExecution().executedPlan().toString()


def test_ledger_partial_aggregate_and_pruned_scan(spark):
    p = plan(spark, "ledger")
    # map-side partial aggregation below the one shuffle: a hot key costs one
    # row per map task
    assert re.search(r"Exchange hashpartitioning\(guild#\d+, author#\d+L?, \d+\)", p)
    assert "partial_count" in p
    assert len(re.findall(r"Exchange", p)) == 1
    assert "partial_count" in p


def test_last_message_sorts_no_text(spark):
    p = plan(spark, "last_message")
    assert "max_by" not in p and "partial_max" in p
    assert not any("SortAggregate" in line for line in p.splitlines())


@pytest.mark.parametrize("name", ["score_lexicon", "score_case_max", "token_list", "tier",
                                  "class_flags", "request_validate", "cyclic_encode"])
def test_per_row_operators_do_not_shuffle_by_key(spark, name):
    assert "Exchange hashpartitioning" not in plan(spark, name)


def test_persona_side_is_broadcast(spark):
    assert "BroadcastHashJoin" in plan(spark, "persona_reply")


@pytest.mark.parametrize("name", ["eval_metrics", "bce_loss", "bce_masked"])
def test_metrics_are_one_global_aggregate(spark, name):
    p = plan(spark, name)
    # no regrouping by example or class: only the global single-partition
    # exchange (plus the scan-side join of documents and labels)
    assert "SinglePartition" in p
    assert not re.search(r"Exchange hashpartitioning\((id|class)#", p)


def test_stats_requests_aggregates_messages_once(spark):
    p = plan(spark, "stats_requests")
    assert p.count("Expand") == 1  # one grouping-sets aggregate for users and guilds


def test_vector_pool_aggregates_whole_vectors(spark):
    p = plan(spark, "vector_pool")
    # the explode (Generate) happens after the aggregation, above the shuffle
    before_shuffle = p[p.index("Exchange"):]
    assert "Generate" not in before_shuffle
    assert "Generate" in p[:p.index("Exchange")]


def test_best_of_n_has_no_regrouping(spark):
    p = plan(spark, "best_of_n")
    assert "collect_list" not in p
    assert "max_by" in p
