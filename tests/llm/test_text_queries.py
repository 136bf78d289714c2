"""Every registered query of the text operators on the smallest tables: columns, and what can be said without SQL."""

import collections

import duckdb
import pytest

from ledgerloom.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "p6_found": {"doc_id", "item_id"},
    "p6_matches": {"doc_id", "item_id", "kind"},
    "p6_phrases": {"doc_id", "item_id"},
    "p7_audit": {"fault", "times"},
    "p8_coverage": {"source", "docs", "scored", "empty"},
    "p6_items": {"item_id", "suite", "docs"},
    "p7_blocks": {"shard", "slot", "source", "block", "pass", "tokens"},
    "p7_mixture": {"shard", "slot", "source", "block", "pass", "at", "doc_id", "first_token", "n_tokens"},
    "p7_shares": {"source", "target_share", "max_repeats", "target_tokens", "available_tokens", "used_tokens", "passes", "actual_share"},
    "p8_found": {"doc_id"},
    "p8_scores": {"doc_id", "source", "score"},
    "p8_rates": {"source", "docs", "bad", "rate"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert set(df.columns) == COLUMNS[name]
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "eval_items", "mix_targets"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = con.execute(ORACLES[name])
        assert sorted(d[0] for d in want.description) == sorted(df.columns)
        order = [df.columns.index(d[0]) for d in want.description]
        assert collections.Counter(tuple(r[i] for i in order) for r in rows) == collections.Counter(want.fetchall())
    if name == "p7_blocks":
        rows = [(*r[:-1], len(r[-1])) for r in rows]
        assert 0 < max(r[-1] for r in rows) <= 512 and len({r[:2] for r in rows}) == len(rows)
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
    if name == "p8_scores":
        assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
        assert all(0 <= r.score <= 1 for r in rows)
    if name == "p7_shares":
        assert abs(sum(r.actual_share for r in rows) - 1) < 1e-9
        assert all(r.passes <= r.max_repeats for r in rows)
