"""Print the physical plan of named queries after execution (AQE final plan), e.g.

    python tools/plans.py /root/testdata/sf0.1 label_posts,active_authors
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    sf_dir = sys.argv[1]
    names = sys.argv[2].split(",")
    from linkloom.plans.queries import QUERIES
    from linkloom.session import get_session
    spark = get_session("local[8]", shuffle_partitions=16)
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"==== {name}")
        for line in plan.split("\n"):
            if "== Initial Plan ==" in line:
                break
            line = re.sub(r"(transform|from_json|to_json|invoke)\(.{160,}", r"\1(...)", line)
            print(line[:200])


if __name__ == "__main__":
    main()
