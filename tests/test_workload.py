"""A part of the registered queries against their SQL; ``workload.check`` runs all."""

import os

import pytest

from workload.check import compare
from workload.oracles import oracle_sql
from workload.queries import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SOME = ["find_network", "find_phones", "find_secret_tokens", "scan_documents", "resolve_overlaps",
        "number_values_source", "redact_documents", "restore_join", "merge_mappings", "env_lines",
        "join_hot_values", "redact_multi_column"]


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_queries_match_sql(spark):
    assert compare(spark, SF, SOME) == []
