"""python tests/run_oracle.py [sf_dir] [name ...]: check registered queries against their SQL."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from mailsift.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main(argv):
    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(entry.queries())
    if os.environ.get("PLAIN_SESSION"):  # the settings of a foreign session
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    else:
        spark = local_session(8)
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            found = compare(con, df, sql[name]) if name in sql else [] if df.count() else ["no rows"]
        except Exception as e:  # noqa: BLE001
            found = [f"{type(e).__name__}: {str(e)[:1500]}"]
        bad += bool(found)
        kind = "sql" if name in sql else "rows"
        print(f"{'ok ' if not found else 'BAD'} {name} [{kind}] {time.time() - start:.1f}s", *found, sep="\n    " if found else " ", flush=True)
    print(f"{len(names) - bad} of {len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
