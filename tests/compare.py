"""Compare registered queries with their SQL in DuckDB."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from marginalia.plans.views import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6)
    if hasattr(value, "item"):
        return _norm(value.item())
    if isinstance(value, list | tuple):
        return tuple(_norm(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _norm(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


KINDS = {
    "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "hugeint": "HUGE",
    "integer": "int", "double": "float", "float": "float", "string": "str", "varchar": "str",
    "boolean": "bool", "timestamp": "ts", "timestamp_ntz": "ts",
}


def compare(spark, name, fn, sql, sf_dir):
    """None when equal, else a description of the first difference."""
    began = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - began
    if sql is None:
        return None, len(got), took
    con = duck(sf_dir)
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    types = {d[0]: str(d[1]).lower() for d in res.description}
    want = res.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}", len(got), took
    notes = []
    for field in df.schema.fields:
        a = KINDS.get(field.dataType.simpleString(), field.dataType.simpleString())
        b = KINDS.get(types[field.name], types[field.name])
        if a != b and not (a.startswith("array") and b in ("list",)) and b != "number":
            notes.append(f"{field.name}: {a}/{b}")
    left, right = rows_of(df.columns, got), rows_of(cols, want)
    if len(left) != len(right):
        extra = [r for r in left if r not in set(right)][:3]
        lack = [r for r in right if r not in set(left)][:3]
        return f"rows {len(left)} != {len(right)}\n  extra {extra}\n  lack {lack}", len(got), took
    for a, b in zip(left, right):
        if a != b:
            return f"values differ:\n  spark {a}\n  duckdb {b}\n  {sorted(cols)}", len(got), took
    return (f"TYPES {notes}" if notes else None), len(got), took


def main():
    import __spark_entry__ as entry
    from marginalia.session import build_session

    args = sys.argv[1:]
    sf = "0.001"
    if args and args[0].replace(".", "").isdigit():
        sf = args.pop(0)
    spark = build_session("compare", "8")
    sql = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if args and not any(a == name or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        try:
            diff, n, took = compare(spark, name, fn, sql.get(name), f"/root/testdata/sf{sf}")
        except Exception as error:  # noqa: BLE001
            diff, n, took = f"{type(error).__name__}: {str(error)[:900]}", -1, 0
        state = "ok " if diff is None else ("typ" if diff.startswith("TYPES") else "BAD")
        bad += diff is not None
        print(f"{state} {name:28s} rows={n} {took:.2f}s {'' if sql.get(name) else '(no sql)'} {diff or ''}", flush=True)
    print("differences:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
