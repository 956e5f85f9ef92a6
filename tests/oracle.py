"""Side-by-side check of a query and its SQL on the same files."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def _value(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    return v


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "tinyint": "TINYINT", "double": "DOUBLE",
         "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def connect(sf_dir):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def difference(spark, con, sf_dir, fn, sql):
    """Empty text when both sides agree, else what differs."""
    got = fn(spark, sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} against {sorted(names)}"
    wide = [d[0] for d in cur.description if str(d[1]).upper() in ("HUGEINT", "INT128")]
    if wide:
        return f"cast {wide} to BIGINT in the SQL"
    kinds = {c: TYPES.get(t, t) for c, t in got.dtypes}
    odd = [(d[0], kinds[d[0]], str(d[1])) for d in cur.description if str(d[1]) != kinds[d[0]]]
    if odd:
        return f"types {odd}"
    order = sorted(names)
    want = Counter(tuple(_value(r[names.index(c)]) for c in order) for r in cur.fetchall())
    have = Counter(tuple(_value(r[c]) for c in order) for r in got.collect())
    if want == have:
        return ""
    return (f"{order}\n only spark ({sum((have - want).values())}): {list((have - want).items())[:3]}"
            f"\n only sql ({sum((want - have).values())}): {list((want - have).items())[:3]}")
