"""Print the formatted physical plan of registered queries.

    python tools/explain_plans.py [sf_dir] [query ...]

Shows what each plan reads (ReadSchema / PushedFilters), which joins are
broadcast, and where the exchanges are.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.001"
    from qsieve.plans.queries import QUERIES
    from qsieve.session import local_session
    spark = local_session(4, shuffle_partitions=8, app="qsieve-explain")
    for name in args or ["readiness"]:
        print(f"===== {name} =====")
        QUERIES[name](spark, sf_dir).explain("formatted")


if __name__ == "__main__":
    main()
