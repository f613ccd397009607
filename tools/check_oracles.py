"""Run every registered query and its DuckDB oracle side by side.

usage: python tools/check_oracles.py [sf_dir] [name ...]
"""
from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cadenza.plans.oracle import compare, con_for  # noqa: E402
from cadenza.plans.registry import load_all  # noqa: E402
from cadenza.session import get_spark  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    reg = load_all()
    spark = get_spark()
    con = con_for(sf_dir)
    bad = 0
    for name, q in reg.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, con, sf_dir, q)
        except Exception as e:  # report and continue
            r = dict(name=name, ok=False, why=f"{type(e).__name__}: {str(e)[:400]}")
        if r.get("ok") is False:
            bad += 1
        print(r, flush=True)
    print(f"FAILED {bad}")


if __name__ == "__main__":
    main()
