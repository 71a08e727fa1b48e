"""Runs queries beside their SQL. Usage: python tests/oracle.py [NAME...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = "/root/testdata"


def plain(value: object) -> object:
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def sql_rows(sql: str, directory: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(directory).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    return [df.columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in df.collect()), key=repr)


def compare(spark, name: str, directory: str) -> str:
    """"" if the query and its SQL give the same columns and rows, else what differs."""
    import __spark_entry__ as entry

    got = spark_rows(entry.queries()[name](spark, directory))
    want = sql_rows(entry.oracle_sql()[name], directory)
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        only = [x for x in got[1] if x not in set(want[1])][:3], [x for x in want[1] if x not in set(got[1])][:3]
        return f"{len(got[1])} and {len(want[1])} rows; only in one: {only}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from gnomon.session import session

    spark = session("local[8]", spark_sql_shuffle_partitions="8")
    for name in sys.argv[1:] or entry.queries():
        began = time.time()
        try:
            said = compare(spark, name, f"{DATA}/sf0.01") if name in entry.oracle_sql() else f"no SQL; {entry.queries()[name](spark, f'{DATA}/sf0.01').count()} rows"
        except Exception as e:
            said = f"FAILED {str(e)[:600]}"
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
