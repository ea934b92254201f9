"""Run contract queries against their DuckDB twins (the driver's correctness gate, locally).

    python -m surveykit.plans.verify [--sf DIR] [--only a,b] [--write-schemas]
"""
from __future__ import annotations

import argparse
import json
import sys
import time
import traceback

from ..session import get_session
from . import schemas
from .check import compare, duckdb_connection
from .contract import QUERIES, ROWS_ONLY
from .contract_sql import SQL


def main(argv=None) -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--only", default="")
    ap.add_argument("--skip-rows-only", action="store_true")
    ap.add_argument("--write-schemas", action="store_true")
    a = ap.parse_args(argv)
    spark = get_session()
    con = duckdb_connection(a.sf)
    names = [n for n in QUERIES if not a.only or n in a.only.split(",")]
    stored = schemas.load()
    bad = 0
    for n in names:
        if a.skip_rows_only and n in ROWS_ONLY:
            continue
        t = time.time()
        try:
            df = QUERIES[n](spark, a.sf)
            if a.write_schemas:
                stored[n] = [[f.name, f.dataType.simpleString()] for f in df.schema.fields]
                schemas.save(stored)
            if n in SQL and n not in ROWS_ONLY:
                res = compare(df, schemas.wrap_rounding(n, SQL[n]), con)
            else:
                res = {"spark_rows": df.count(), "match": None}
        except Exception as e:  # report and continue
            res = {"error": f"{type(e).__name__}: {str(e)[:400]}"}
            traceback.print_exc(limit=2)
        res["sec"] = round(time.time() - t, 2)
        ok = res.get("match") is not False and "error" not in res
        bad += not ok
        print(json.dumps({"query": n, **{k: v for k, v in res.items() if k not in ('spark_cols', 'sql_cols') or not res.get('cols_match', True)}}, default=str), flush=True)
    print(f"FAILED {bad} of {len(names)}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
