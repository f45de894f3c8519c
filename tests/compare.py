"""Runs registered queries beside their DuckDB twins: python tests/compare.py SF_DIR [NAME...]"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") and v.tzinfo else v


def differences(con, df, sql):
    cols = sorted(df.columns)
    mine = sorted(repr([plain(v) for v in r]) for r in df.select(*cols).collect())
    theirs = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({sql}) q").fetchall()
    theirs = sorted(repr([plain(v) for v in r]) for r in theirs)
    if mine == theirs:
        return None, len(mine)
    a = [x for x in mine if x not in set(theirs)][:2]
    return f"{len(mine)} and {len(theirs)} rows; {a} against {[x for x in theirs if x not in set(mine)][:2]}", len(mine)


if __name__ == "__main__":
    import __spark_entry__ as entry
    from skein.session import local_session

    spark = local_session("compare")
    spark.sparkContext.setLogLevel("OFF")
    con, twins, all_ = connect(sys.argv[1]), entry.oracle_sql(), entry.queries()
    for name in sys.argv[2:] or [n for n in all_ if n in twins]:
        t = time.time()
        try:
            bad, n = differences(con, all_[name](spark, sys.argv[1]), twins[name])
        except Exception as e:  # noqa: BLE001
            bad, n = f"{type(e).__name__}: {str(e)[:300]}", -1
        print(f"{name}: {'DIFFERS ' + bad[:600] if bad else 'ok'} ({n} rows, {time.time() - t:.1f} s)", flush=True)
