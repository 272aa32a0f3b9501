"""Plan invariants over every registered query."""

import pytest

import __spark_entry__ as E
from quarry.plans.registry import QUERIES as BASE  # the optional subpackage is tested in tests/llm
from paths import SF01
from plan_util import plan_text

# queries whose builders write to the scratch folder before returning a reader
SIDE_EFFECTS = {"telemetry_stream", "responses_roundtrip", "dataset_roundtrip", "export_text",
                "run_outputs_roundtrip", "run_end_to_end", "run_address_two_runs"}
QUERIES = {k: v for k, v in E.queries().items() if k in BASE}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SIDE_EFFECTS))
def test_no_cross_or_nested_loop_join(spark, name):
    plan = plan_text(QUERIES[name](spark, SF01))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    # no row-at-a-time Python UDF anywhere (Arrow-batched mapInPandas / cogroup only)
    assert "BatchEvalPython" not in plan


def _read_schemas(plan: str) -> list[str]:
    return [ln.split("ReadSchema: ")[1] for ln in plan.splitlines() if "ReadSchema: " in ln]


def test_scans_read_only_needed_columns(spark):
    cfg = _read_schemas(plan_text(QUERIES["dataset_config"](spark, SF01)))
    assert cfg and all("text" not in s and "n_chars" not in s for s in cfg)
    tel = _read_schemas(plan_text(QUERIES["run_telemetry"](spark, SF01)))
    assert tel and all("props" not in s and "event_type" not in s for s in tel)
    knn_plan = plan_text(QUERIES["rerank_maxsim"](spark, SF01))
    assert all("label" not in s for s in _read_schemas(knn_plan))


def test_filters_reach_the_scan(spark):
    plan = plan_text(QUERIES["messages_templated"](spark, SF01))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,assistant)" in plan
    assert "EqualTo(role,user)" in plan
