"""Run registered queries next to their DuckDB twins and report differences.

usage: python tools/compare.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    import datetime as dt
    import decimal

    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else float(f"{v:.9g}")
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        if hasattr(v, "asDict"):
            return tuple(sorted((k, norm(x)) for k, x in v.asDict().items()))
        return tuple(norm(x) for x in v)
    return v


def diff(spark_df, rel) -> str | None:
    scols, dcols = sorted(spark_df.columns), sorted(rel.columns)
    if scols != dcols:
        return f"columns {scols} vs {dcols}"
    from collections import Counter

    kinds = []
    types = dict(zip(rel.columns, map(str, rel.types)))
    for f in spark_df.schema.fields:
        t, k = types[f.name], f.dataType.typeName()
        group = lambda x: ("str" if x in ("string", "VARCHAR") else "bool" if x in ("boolean", "BOOLEAN") else
                           "float" if x in ("double", "float", "DOUBLE", "FLOAT") else
                           "int" if x in ("integer", "long", "short", "byte", "INTEGER", "BIGINT", "SMALLINT", "TINYINT") else
                           "ts" if x.lower().startswith("timestamp") else "date" if x.lower() == "date" else x)
        if group(t) != group(k) and group(k) not in ("array", "struct", "map"):
            kinds.append(f"{f.name}: {k} vs {t}")
    if kinds:
        return "types " + "; ".join(kinds)
    a = Counter(tuple(norm(r[c]) for c in scols) for r in spark_df.select(*scols).collect())
    idx = [rel.columns.index(c) for c in scols]
    b = Counter(tuple(norm(r[i]) for i in idx) for r in rel.fetchall())
    if a == b:
        return None
    oa, ob = list((a - b).elements()), list((b - a).elements())
    key = lambda r: tuple(str(x) for x in r)
    return (f"rows {sum(a.values())} vs {sum(b.values())}, {len(oa)}/{len(ob)} differ; cols {scols}\n"
            f"  spark {sorted(oa, key=key)[:3]}\n  duck  {sorted(ob, key=key)[:3]}")


def main() -> None:
    from tickloom.plans import load
    from tickloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    prefixes = sys.argv[2:]
    spark = local_session(8)
    con = connect(sf)
    queries, oracles = load()
    bad = 0
    for name, fn in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in oracles:
                msg = diff(df, con.sql(oracles[name]))
            else:
                msg = None if df.count() >= 0 else "?"
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:600]}"
        bad += msg is not None
        flag = "ok " if msg is None else "BAD"
        print(f"{flag} {name:36s} {time.time() - t:5.1f}s {'' if name in oracles else '(rows only)'} {msg or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
