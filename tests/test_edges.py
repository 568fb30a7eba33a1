"""Edges between documents: few passes over parsed statuses, and the same edges."""

from datetime import datetime

import pytest

from descry.operators.integrity import reference_edges
from descry.queries import QUERIES

NOW = datetime(2024, 1, 1)
AT = "timestamp'2024-01-01 01:00:00'"


def inputs(spark):
    kinds = ("consensus", "consensus-microdesc", "vote", "bridge-status")
    statuses = spark.createDataFrame([(k,) for k in kinds], "kind string").selectExpr(
        "kind", f"{AT} as valid_after", "if(kind = 'vote', 'f', null) as fingerprint"
    )
    entries = spark.createDataFrame(
        [(k, s, m) for k in kinds for s, m in (("s1", "m1"), ("s2", None), (None, "m2"), ("s1", "m1"))],
        "kind string, server_digest string, micro_digest string",
    ).selectExpr(
        "kind", f"{AT} as valid_after", "if(kind = 'vote', 'f', null) as fingerprint",
        "server_digest", "micro_digest", f"{AT} as published",
    )
    sources = spark.sql(f"select 'consensus' as kind, {AT} as valid_after, 'a' as identity")
    servers = spark.sql(
        f"select 's1' as digest, 'x' as extra_info_digest, {AT} as published"
        f" union all select 's2', null, {AT}"
    )
    extras = spark.sql(f"select 'x' as digest, {AT} as published")
    micro = spark.sql("select 'm1' as sha256_hex")
    return statuses, sources, entries, servers, extras, micro, NOW


def rows(edges):
    return sorted(map(str, edges.collect()))


@pytest.mark.parametrize("to", "CMVSDE")
def test_edges_to_one_kind_are_those_among_all(spark, to):
    everything = reference_edges(*inputs(spark))
    expected = everything.filter(everything["referenced"].startswith(f"{to}-"))
    assert expected.count() > 0
    assert rows(reference_edges(*inputs(spark), to=to)) == rows(expected)


def test_weights_count_all_entries_of_a_status(spark):
    found = {
        (r.referencing[0], r.referenced): r.weight for r in reference_edges(*inputs(spark)).collect()
    }
    hour = "2024-01-01-01-00-00"
    assert found["M", "D-M1"] == found["C", "S-S1"] == found["V", "S-S2"] == 50.0
    assert found["C", None] == found["V", None] == 50.0 and ("M", None) not in found
    assert found["C", f"M-{hour}"] == found["M", f"C-{hour}"] == found["C", f"V-{hour}-A"] == 1.0
    assert found["S", "E-X"] == found["S", ""] == 0.01


def test_statuses_are_parsed_once_for_their_edges(spark):
    edges = QUERIES["unexpired_graph"](spark, "/root/testdata/sf0.001")
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
