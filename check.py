"""Compare registered queries with their oracles: check.py [name part ...] (CHECK_SF_DIR)."""

import os
import sys
import time

from tabgraph.catalog import ORACLES, QUERIES
from tabgraph.catalog.compare import differences, duck
from tabgraph.session import local_session


def main(parts: list[str]) -> int:
    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark, con, failed = local_session(), duck(sf_dir), 0
    for name, fn in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in ORACLES:
                said = differences(df, con, ORACLES[name]) or "same"
            else:
                said = f"no oracle, {df.count()} rows"
        except Exception as error:  # report and go on with the next query
            said = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        failed += not said.startswith(("same", "no oracle"))
        print(f"{name:40s} {time.time() - start:6.1f}s  {said}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
