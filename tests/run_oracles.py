"""Check queries against their SQL twins: python tests/run_oracles.py SF_DIR [name ...]."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from railweave.catalog import ORACLES, QUERIES, load  # noqa: E402
from railweave.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    load()
    wanted = [n for n in QUERIES if not names or any(n == p or (p.endswith("*") and n.startswith(p[:-1])) for p in names)]
    spark, con, failed = local_session(8), connect(sf_dir), 0
    for name in wanted:
        start = time.time()
        try:
            if name in ORACLES:
                got, _, problems = compare(spark, con, QUERIES[name], ORACLES[name], sf_dir)
                note = f"{len(got)} rows" if not problems else f"FAIL {problems[0][:600]}"
            else:
                got = QUERIES[name](spark, sf_dir).collect()
                problems, note = [], f"{len(got)} rows, no oracle"
        except Exception as error:  # report and go on with the next query
            problems, note = ["error"], "ERROR " + (str(error)[:900] or traceback.format_exc()[-900:])
        failed += bool(problems)
        print(f"{name:24} {time.time() - start:6.1f}s {note}", flush=True)
    print(f"{len(wanted)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
