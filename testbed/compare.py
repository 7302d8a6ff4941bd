"""Run a registered query and its oracle statement and compare names, types and values."""

from __future__ import annotations

from collections import Counter

import duckdb

from testbed.registry import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
          "boolean": "BOOLEAN"}


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name: str, sf_dir: str, allow_empty: bool = False) -> str | None:
    """None when equal, otherwise a short description of the first difference."""
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    if name not in ORACLES:
        return None if got else "no rows"
    cur = con.execute(ORACLES[name])
    desc = {d[0]: str(d[1]) for d in cur.description}
    rows = cur.fetchall()
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    for field in df.schema.fields:
        want = _TYPES.get(field.dataType.simpleString())
        if want is None or want != desc[field.name]:
            return f"type of {field.name}: {field.dataType.simpleString()} vs {desc[field.name]}"
    order = [names.index(c) for c in cols]
    want_rows = [tuple(r[i] for i in order) for r in rows]
    a, b = Counter(got), Counter(want_rows)
    if len(got) != len(want_rows):
        return f"{len(got)} rows vs {len(want_rows)}; e.g. {list((a - b))[:2]} | {list((b - a))[:2]} {cols}"
    if a != b:
        return (f"{sum((a - b).values())} of {len(got)} rows differ; {cols}; "
                f"{list((a - b))[:2]} | {list((b - a))[:2]}")
    if not got and not allow_empty:
        return "no rows"
    return None
