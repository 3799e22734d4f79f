"""Compare registered queries with their SQL in DuckDB, the way the driver does."""

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6g}" if isinstance(v, float) else f"{float(v):.10g}"
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return "[" + ",".join(map(plain, v)) + "]"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def differences(spark, name, query, sql, sf_dir):
    """Empty if columns and rows agree."""
    ours = query(spark, sf_dir)
    con = connection(sf_dir)
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    theirs = rel.fetchall()
    if sorted(columns) != sorted(ours.columns):
        return f"{name}: columns {sorted(ours.columns)} against {sorted(columns)}"
    names = sorted(columns)
    at = [columns.index(c) for c in names]
    a = sorted(tuple(plain(r[c]) for c in names) for r in ours.collect())
    b = sorted(tuple(plain(r[i]) for i in at) for r in theirs)
    if a != b:
        extra, missing = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"{name}: {len(a)} rows against {len(b)}; only ours {extra}; only SQL {missing}"
    return ""
