"""Compare a Spark result with DuckDB's answer for the same tables."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set threads to 4")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return "\x00null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    return str(v)


KINDS = {"BIGINT": "int", "INTEGER": "int", "HUGEINT": "int", "SMALLINT": "int", "DOUBLE": "float", "VARCHAR": "str",
         "bigint": "int", "int": "int", "smallint": "int", "double": "float", "string": "str", "boolean": "bool",
         "BOOLEAN": "bool"}


def compare(df, con, sql: str) -> list[str]:
    """Differences found; empty when both agree."""
    names = sorted(df.columns)
    rel = con.sql(sql)
    found = []
    if sorted(rel.columns) != names:
        return [f"columns {names} against {sorted(rel.columns)}"]
    kinds = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for name, kind in df.dtypes:
        if KINDS.get(kind, kind) != KINDS.get(kinds[name], kinds[name]):
            found.append(f"type of {name}: {kind} against {kinds[name]}")
    mine = sorted([tuple(_norm(r[n]) for n in names) for r in df.collect()], key=repr)
    order = [rel.columns.index(n) for n in names]
    theirs = sorted([tuple(_norm(r[i]) for i in order) for r in rel.fetchall()], key=repr)
    if len(mine) != len(theirs):
        found.append(f"rows {len(mine)} against {len(theirs)}")
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first: {wrong[0][0]!r:.300} against {wrong[0][1]!r:.300}")
    if not mine:
        found.append("no rows")
    return found
