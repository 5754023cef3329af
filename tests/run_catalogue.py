"""Command line: compare all or the named queries. `python tests/run_catalogue.py SF [name...]`"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tests.compare import connect, differences  # noqa: E402
from tidewater.session import local_session  # noqa: E402


def main() -> int:
    folder = f"/root/testdata/{sys.argv[1]}"
    spark, con = local_session(), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            found = differences(df, con, oracles[name]) if name in oracles else [f"rows {df.count()}"]
        except Exception as failure:  # report and go on with the next query
            found = [f"{type(failure).__name__}: {str(failure)[:1200]}"]
        bad = bool(found) and name in oracles
        failed += bad
        print(f"{'FAIL' if bad else 'ok  '} {name} {time.time() - start:.1f}s", *found, sep="\n     ", flush=True)
    print(f"{failed} failed of {len(sys.argv[2:] or queries)}; {len(oracles)} with SQL")
    return failed


if __name__ == "__main__":
    sys.exit(main())
