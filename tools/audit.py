"""List plan features that matter at scale for every registered query.

Usage: python tools/audit.py [name ...]
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tessera.plans import catalog  # noqa: E402
from tessera.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"
MARKS = {
    "cross": r"CartesianProduct|BroadcastNestedLoopJoin",
    "single": r"Exchange SinglePartition",
    "python": r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMap\w*InPandas|FlatMap\w*InArrow",
    "exchange": r"Exchange (?:hash|range)partitioning",
    "window_no_key": r"Window \[[^\n]*\], \[\w*#?\d*L? (?:ASC|DESC)[^\n]*$",
}


def main() -> None:
    spark = local_session("audit")
    spark.sparkContext.setLogLevel("ERROR")
    for name, run in catalog.queries().items():
        if sys.argv[1:] and name not in sys.argv[1:]:
            continue
        plan = run(spark, SF)._jdf.queryExecution().executedPlan().toString()
        found = {mark: len(re.findall(regex, plan)) for mark, regex in MARKS.items()}
        print(name, {k: v for k, v in found.items() if v}, flush=True)


if __name__ == "__main__":
    main()
