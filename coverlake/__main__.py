"""Run a registered query from the command line.

    python -m coverlake list
    python -m coverlake <query> <data_dir> [--out PATH] [--explain] [--show N]

Without ``--out`` the result is shown (``--show`` rows, default 20); with it the
result is written as Parquet (overwrite).  ``--explain`` prints the formatted
physical plan instead of running the query.
"""

from __future__ import annotations

import argparse
import sys


def main(argv=None) -> int:
    from coverlake.registry import load_all
    queries, oracles = load_all()
    p = argparse.ArgumentParser(prog="coverlake")
    p.add_argument("query")
    p.add_argument("data_dir", nargs="?")
    p.add_argument("--out")
    p.add_argument("--explain", action="store_true")
    p.add_argument("--show", type=int, default=20)
    a = p.parse_args(argv)
    if a.query == "list":
        for name, fn in sorted(queries.items()):
            doc = (fn.__doc__ or "").strip().splitlines()[0] if fn.__doc__ else ""
            print(f"{name:30s} {'sql' if name in oracles else 'rows'}  {doc}")
        return 0
    if a.query not in queries or not a.data_dir:
        p.error("unknown query or missing data_dir (try: python -m coverlake list)")
    from coverlake.session import get_spark
    spark = get_spark(f"coverlake-{a.query}")
    df = queries[a.query](spark, a.data_dir)
    if a.explain:
        df.explain("formatted")
    elif a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        df.show(a.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
