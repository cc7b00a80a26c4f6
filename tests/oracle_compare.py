"""Run a registered Spark query and its DuckDB oracle on the same parquet
tables and compare row count, column names and order-insensitive values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_key(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    # exact columns order the rows; floats only among rows that agree in those
    return sorted(out, key=lambda t: ([(x is None, str(x)) for x in t if not isinstance(x, float)],
                                      [x for x in t if isinstance(x, float)]))


def same_row(a, b) -> bool:
    """Equal in all columns; floats up to the last bits of a sum's order."""
    return all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) if isinstance(x, float) and isinstance(y, float)
               else x == y for x, y in zip(a, b))


def compare(spark, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    ts = time.time() - t0
    con = duck(sf_dir)
    t0 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    td = time.time() - t0
    problems = []
    if sorted(scols) != sorted(dcols):
        problems.append(f"columns differ: spark={scols} duck={dcols}")
    if len(srows) != len(drows):
        problems.append(f"rows differ: spark={len(srows)} duck={len(drows)}")
    if not problems:
        a, b = rows_key(srows, scols), rows_key(drows, dcols)
        diffs = [(x, y) for x, y in zip(a, b) if not same_row(x, y)][:3]
        if diffs:
            problems.append(f"values differ, e.g. {diffs}")
    return problems, ts, td, len(srows)


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from clickforge.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = local_session()
    qs, orc = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        if name not in orc:
            t0 = time.time()
            n = fn(spark, sf).count()
            print(f"{name:32s} rows-only  {n:8d} rows  spark {time.time()-t0:6.2f}s")
            continue
        try:
            probs, ts, td, n = compare(spark, name, fn, orc[name], sf)
        except Exception as e:  # noqa: BLE001
            probs, ts, td, n = [f"error {type(e).__name__}: {str(e)[:400]}"], 0, 0, 0
        bad += bool(probs)
        print(f"{name:32s} {'OK ' if not probs else 'BAD'} {n:8d} rows  spark {ts:6.2f}s duck {td:6.2f}s",
              *probs, flush=True)
    print("mismatches:", bad)
