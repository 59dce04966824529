"""Queries against their SQL on the smallest tables."""

import duckdb
import pytest

from sieveline.plans import catalogue

AT = "/root/testdata/sf0.001"
TABLES = ("part", "events", "nation", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
NAMES = (
    "pii_scan_documents", "sanitized_documents", "policy_matrix", "canary_join", "egress_verdict", "iou_top5", "nms_greedy", "mask_iou", "ctc_decode",
    "html_to_text", "search_query_extract", "target_risk_flags", "grant_redeem_outcomes", "latency_percentiles_floor", "semantic_detections", "scene_compaction",
    "matched_entities", "element_tree", "hit_tests", "stale_actions", "trailing_json", "session_outcomes", "plan_actions", "kept_boxes",
)


def plain(rows):
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    found = catalogue.queries()[name](spark, AT)
    columns = sorted(found.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.oracles()[name]})").fetchall()
    assert plain(found.select(*columns).collect()) == plain(want)


def test_every_query_has_a_name_once():
    assert len(catalogue.queries()) == sum(len(m.QUERIES.queries) for m in catalogue.MODULES)
