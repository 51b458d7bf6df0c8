"""Run registered queries next to DuckDB: python tests/check.py SF_DIR [name ...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, duck  # noqa: E402

from caselog.plans.registry import load_all  # noqa: E402
from caselog.session import local_session  # noqa: E402


def main():
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session("8")
    con = duck(sf_dir)
    bad = 0
    for name, entry in load_all().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = entry.build(spark, sf_dir)
            found = compare(df, con, entry.sql) if entry.sql else ([] if df.count() > 0 else ["no rows"])
        except Exception as e:  # noqa: BLE001 - report and go on
            found = [f"{type(e).__name__}: {str(e)[:600]}"]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += bool(found)
        print(f"{'BAD ' if found else 'ok  '} {time.time() - start:6.1f}s {name} {'' if entry.sql else '(rows)'} {found or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
