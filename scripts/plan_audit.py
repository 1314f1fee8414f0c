"""Print, per registered query, plan features that matter at scale.

BNLJ/Cartesian joins, single-partition exchanges (fine only over bounded tables such as
histograms), shuffles, broadcasts and scan read schemas. Usage: python scripts/plan_audit.py [name ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quiver.registry import QUERIES  # noqa: E402
from quiver.session import local_session  # noqa: E402


def main() -> None:
    spark = local_session()
    sf = "/root/testdata/sf0.001"
    for name in sys.argv[1:] or list(QUERIES):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        feats = {k: len(re.findall(p, plan)) for k, p in {
            "bnlj": r"BroadcastNestedLoopJoin", "cartesian": r"CartesianProduct", "single": r"SinglePartition",
            "shuffle": r"Exchange hashpartitioning|Exchange rangepartitioning", "broadcast": r"BroadcastExchange",
            "window": r"\bWindow\b", "python": r"MapInPandas|ArrowEvalPython|BatchEvalPython"}.items()}
        print(name, feats)


if __name__ == "__main__":
    main()
