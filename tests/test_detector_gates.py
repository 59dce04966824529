import pytest

from sieveline.operators import detectors
from sieveline.plans import catalogue
from sieveline.plans.validation import LITERALS

from .test_twins import AT


@pytest.mark.parametrize("name", ["fused_decisions", "confusion_by_configuration", "sanitized_by_fusion"])
def test_detectors_run_once(spark, name):
    # Before, a filter on the number of detections had all of them in it again, or the words of context scores one by one.
    plan = catalogue.queries()[name](spark, AT)._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.splitlines() if x.lstrip("+-: ").startswith("Filter")]
    assert not [x for x in filters if "regexp_extract_all" in x or "2fa code" in x]


def test_texts_that_have_a_match_are_not_left_out(spark):
    texts = [(k, text) for k, text, _ in LITERALS] + [(99, "PWD hunter2Hunter!"), (98, "my paſs: Abcdef12!"), (97, None), (96, "a@b.co"), (95, "sk-abcdefghijklmnopqrstuv"), (94, "API_KEY = abcdefghijklmnopqrstuv")]
    found = detectors.detect(spark.createDataFrame(texts, "id int, text string"), "id").collect()
    want = {(k, c, t, n, m) for k, _, rows in LITERALS for c, t, n, m in rows}
    assert {(r.key, r.category, r.tier, r.confidence, r.matched) for r in found if r.key < 90} == want
    assert sorted((r.key, r.category) for r in found if r.key > 90) == [(94, "api-key"), (95, "api-key"), (96, "email"), (99, "password")]
