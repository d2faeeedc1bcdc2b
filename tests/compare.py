"""Compare queries with their SQL. Usage: python tests/compare.py SF_DIR [name ...]"""
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return round(v, 8)
    if isinstance(v, Decimal):
        return round(float(v), 8)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, sf, name, fn, sql):
    """None if equal, else a short text."""
    df = fn(spark, sf)
    got = _rows(df.columns, df.collect())
    if sql is None:
        return None if got else "no rows"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = _rows(names, rel.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got == want:
        return None if got else "no rows in both"
    extra = [r for r in got if r not in set(want)][:2] if len(got) < 20000 else []
    lack = [r for r in want if r not in set(got)][:2] if len(got) < 20000 else []
    return f"{len(got)} and {len(want)} rows; only here {str(extra)[:700]}; only there {str(lack)[:700]}"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from postledger.session import build_session

    sf, chosen = sys.argv[1], sys.argv[2:]
    session = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                     "spark.driver.memory": "12g"})
    session.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf), oracle_sql(), 0
    for key, fn in queries().items():
        if chosen and not any(key.startswith(c) for c in chosen):
            continue
        start = time.time()
        try:
            text = difference(session, con, sf, key, fn, sqls.get(key))
        except Exception as e:  # noqa: BLE001
            text = f"{type(e).__name__}: {str(e)[:1200]}"
        bad += text is not None
        print(f"{'ok  ' if text is None else 'BAD '} {key} {time.time() - start:.1f}s {text or ''}"
              f"{'' if key in sqls else ' (no sql)'}", flush=True)
    print("bad:", bad)
