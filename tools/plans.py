"""Print the physical plans of the headline queries (for PLANS.md).

    python tools/plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from firmament.plans.queries import QUERIES  # noqa: E402
from firmament.session import local_session  # noqa: E402

NAMES = ["search_combined", "search_combined_index", "radius_join", "succession_batch", "upsert_legal_unit",
         "establishment_lookup", "search_batch", "bm25_documents", "feed_establishment_flatten"]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    # AQE off so the printed plan is the full static plan with codegen stages.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    print("# Physical plans of the headline queries\n")
    print(f"Generated by `tools/plans.py` at `{sf_dir}`, AQE off (static plan; `*(n)` marks a whole-stage")
    print("codegen stage). Long expressions are cut at 150 characters.\n")
    for name in NAMES:
        df = QUERIES[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"## {name}\n\n```")
        for line in plan.splitlines():
            print(line[:150] + (" …" if len(line) > 150 else ""))
        print("```\n")


if __name__ == "__main__":
    main()
