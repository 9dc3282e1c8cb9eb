import json
import re

import pytest

from weftgraph.__main__ import main
from weftgraph.plans import fixtures
from weftgraph.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"
#: Queries that run jobs while their plan is made.
LOOPS = {"learn_grammar", "learn_round_trip", "reachability", "geo_leaves", "connected_components", "equal_mass_sample", "zscore_split"}


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - LOOPS))
def test_no_query_pairs_everything_with_everything(spark, name):
    assert "CartesianProduct" not in plan(QUERIES[name](spark, DIR))


def test_scans_read_only_what_is_used(spark):
    text = plan(QUERIES["motif_edge_support"](spark, DIR))
    read = {c for s in re.findall(r"ReadSchema: struct<([^>]*)>", text) for c in re.findall(r"(\w+):", s)}
    assert read == {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"}
    assert "GreaterThan(p_size,25)" in plan(QUERIES["rule_usage_counts"](spark, DIR))


def test_patterns_on_small_graphs_need_no_join_beyond_the_gathering(spark):
    text = plan(QUERIES["motif_path3_induced"](spark, DIR))
    # nodes and edges of a graph meet once, in the partitioning that the order key has
    assert len(set(re.findall(r"\((\d+)\) SortMergeJoin|\((\d+)\) BroadcastHashJoin|\((\d+)\) ShuffledHashJoin", text))) == 1
    keys = re.findall(r"Arguments: hashpartitioning\(([^,]*),", text)
    assert sum("l_orderkey" in k for k in keys) <= 2


def test_command_line(tmp_path, capsys):
    _, g, tests = fixtures.membership_cases()[0]
    (tmp_path / "g.json").write_text(g)
    (tmp_path / "h.json").write_text(tests[0][0])
    assert main(["member", str(tmp_path / "g.json"), str(tmp_path / "h.json")]) == 0 and capsys.readouterr().out == "True\n"
    assert main([]) == 2 and json.loads(g)["S"] == "S"
