"""Write PLANS.md: the physical-plan profile of every registered query and full plans of the
headline ones (``python tools/plan_report.py [sf_dir]``)."""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from quarry.operators import metrics as M  # noqa: E402
from quarry.operators import retrieve as RT  # noqa: E402
from quarry.plans import fixtures as fx  # noqa: E402
from quarry.plans.registry import QUERIES  # noqa: E402
from quarry.session import build_session  # noqa: E402

FEATURES = ["BroadcastHashJoin", "SortMergeJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
            "TakeOrderedAndProject", "WindowGroupLimit", "Window [", "MapInPandas", "FlatMapCoGroupsInPandas",
            "Generate", "Subquery"]
# queries that write to the scratch folder when built are profiled through their readers only
SIDE_EFFECTS = {"telemetry_stream", "responses_roundtrip", "dataset_roundtrip", "export_text", "run_outputs_roundtrip"}


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    rows = []
    for name, fn in QUERIES.items():
        if name in SIDE_EFFECTS:
            continue
        p = plan_of(fn(spark, sf))
        ex = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", p))
        feats = ", ".join(f"{f.strip(' [')} x{p.count(f)}" for f in FEATURES if p.count(f))
        rows.append(f"| {name} | {ex} | {feats} |")
    headline = {
        "flagship_eval (J1 -> T2 -> A1 + A2)": QUERIES["flagship_eval"](spark, sf),
        "chrF statistics (A2, per pair)": M.ngram_match_stats(fx.pairs(spark, sf), ["example_id"],
                                                              "prediction", "reference"),
        "kNN top-k before its checkpoint (J2)": RT.knn_topk(fx.retrieval_queries(spark, sf),
                                                            fx.knowledge_base(spark, sf), 5, materialize=False),
        "split_carve (L1, L2, J7)": QUERIES["split_carve"](spark, sf),
        "running_peak (A12, W5)": QUERIES["running_peak"](spark, sf),
    }
    out = ["# PLANS", "",
           f"Physical plans as planned before execution (AQE may still coalesce partitions or turn a",
           f"sort-merge join into a broadcast at run time); input `{sf}`. Regenerate with",
           "`python tools/plan_report.py`. Counts include the plans of scalar subqueries at every",
           "reference; at execution Spark runs each once (`ReusedSubquery`).", "",
           "| query | hash/range exchanges | operators |", "| --- | --- | --- |", *rows, ""]
    for title, df in headline.items():
        out += [f"## {title}", "", "```", plan_of(df).strip(), "```", ""]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
