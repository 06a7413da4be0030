"""Every query with SQL beside it gives that SQL's rows."""

from __future__ import annotations

import pytest

from colloquy.plans import action_queries, cluster_queries, contract_queries, identity_queries, more_queries, review_queries, rule_queries, text_queries, topic_queries, voice_queries  # noqa: F401
from colloquy.plans import queries as Q


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(map(tuple, df[columns].astype(str).to_numpy()))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, duck, sf_dir, name):
    got = Q.queries()[name](spark, sf_dir).toPandas()
    assert rows(got) == rows(duck.execute(Q.oracle_sql()[name]).df())
