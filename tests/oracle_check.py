"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: rows, column match, value match (floats rounded
to 6 significant digits, order-insensitive).
"""

from __future__ import annotations

import datetime as _dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, _dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def _sortkey(x):
    if isinstance(x, float):
        return (x is None, f"{x:.4g}")
    return (x is None, str(x))


def canon(cols, rows):
    """Columns in name order; rows sorted by their non-float values first
    (exact keys), then by floats rounded to 4 significant digits."""
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]

    def key(t):
        exact = tuple(_sortkey(x) for x in t if not isinstance(x, float))
        approx = tuple(_sortkey(x) for x in t if isinstance(x, float))
        return exact + approx
    return sorted(out, key=key)


def close(a, b):
    if len(a) != len(b):
        return False
    for ra, rb in zip(a, b):
        for x, y in zip(ra, rb):
            if isinstance(x, float) and isinstance(y, (float, int)) and not isinstance(y, bool):
                if not math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9):
                    return False
            elif isinstance(y, float) and isinstance(x, int) and not isinstance(x, bool):
                if not math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9):
                    return False
            elif x != y:
                return False
    return True


_TYPE_MAP = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "date": "DATE",
             "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
             "smallint": "SMALLINT", "float": "FLOAT"}


def type_mismatches(spark_dtypes, duck_cols, duck_types):
    """(column, spark type, duckdb type) for columns whose types differ."""
    d = dict(zip(duck_cols, [str(t) for t in duck_types]))
    out = []
    for c, t in spark_dtypes:
        want = _TYPE_MAP.get(t, t.upper())
        if t.startswith("array<"):
            want = _TYPE_MAP.get(t[6:-1], t[6:-1].upper()) + "[]"
        if c in d and d[c] != want:
            out.append((c, t, d[c]))
    return out


def duck_con(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    from climo.session import get_spark
    if os.environ.get("PLAIN_SESSION"):
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
    else:
        spark = get_spark("local[8]", shuffle_partitions=8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck_con(sf_dir)
    bad = 0
    n_exact = n_oracle = 0
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            cols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"ROWS {name}: spark rows={len(srows)} ({ts:.1f}s) [no oracle]")
            continue
        try:
            rel = con.sql(sqls[name])
            dcols = rel.columns
            tmis = type_mismatches(df.dtypes, dcols, rel.types)
            drows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:300]}")
            bad += 1
            continue
        ok_cols = sorted(cols) == sorted(dcols)
        ok_rows = len(srows) == len(drows)
        ok_vals = ok_cols and close(canon(cols, srows), canon(dcols, drows))
        tag = "OK  " if (ok_cols and ok_rows and ok_vals and not tmis) else "FAIL"
        if tmis:
            print(f"   type mismatches in {name}: {tmis}")
        if tag == "FAIL":
            bad += 1
        exact = ok_cols and canon(cols, srows) == canon(dcols, drows)
        n_exact += int(bool(exact))
        n_oracle += 1
        print(f"{tag} {name}: rows spark={len(srows)} duck={len(drows)} cols={ok_cols} vals={ok_vals} "
              f"bit-exact={exact} ({ts:.1f}s)")
        if tag == "FAIL" and ok_cols:
            a, b = canon(cols, srows), canon(dcols, drows)
            sa, sb = set(a), set(b)
            print("   spark-only:", list(sa - sb)[:3])
            print("   duck-only: ", list(sb - sa)[:3])
        elif not ok_cols:
            print("   spark cols:", cols, "\n   duck cols: ", dcols)
    print(f"done, {bad} failing; {n_exact}/{n_oracle} oracle queries bit-exact")


if __name__ == "__main__":
    main()
