"""Compare every ``queries()`` result with its ``oracle_sql()`` on DuckDB.

Per query: same column names, same Arrow types, same number of rows and the
same multiset of rows (columns sorted by name, order-insensitive). Usable as a
script: ``python tests/oracle_check.py /root/testdata/sf0.01 [name ...]``.
"""

from __future__ import annotations

import collections
import decimal
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v))
    if isinstance(v, float):
        return ("f", repr(v))
    return (type(v).__name__, v if v is None or isinstance(v, (int, str, bool)) else str(v))


def _rows(table):
    cols = sorted(table.column_names)
    data = [table.column(c).to_pylist() for c in cols]
    return cols, collections.Counter(tuple(_norm(x) for x in row) for row in zip(*data))


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> dict:
    t0 = time.time()
    s_tab = fn(spark, sf_dir).toArrow()
    t1 = time.time()
    d_tab = con.sql(sql).to_arrow_table()
    res = {"name": name, "spark_s": round(t1 - t0, 2), "rows": (s_tab.num_rows, d_tab.num_rows)}
    s_types = {f.name: str(f.type) for f in s_tab.schema}
    d_types = {f.name: str(f.type) for f in d_tab.schema}
    res["names_ok"] = sorted(s_types) == sorted(d_types)
    res["types_ok"] = s_types == d_types
    if not res["types_ok"]:
        res["type_diff"] = {k: (s_types.get(k), d_types.get(k))
                            for k in set(s_types) | set(d_types) if s_types.get(k) != d_types.get(k)}
    if res["names_ok"]:
        _, s_rows = _rows(s_tab)
        _, d_rows = _rows(d_tab.cast(s_tab.schema.select(d_tab.column_names))
                          if not res["types_ok"] and False else d_tab)
        res["values_ok"] = s_rows == d_rows
        if not res["values_ok"]:
            only_s = list((s_rows - d_rows).elements())[:3]
            only_d = list((d_rows - s_rows).elements())[:3]
            res["diff"] = {"spark_only": only_s, "oracle_only": only_d,
                           "n": (sum((s_rows - d_rows).values()), sum((d_rows - s_rows).values()))}
    else:
        res["values_ok"] = False
    res["ok"] = res["names_ok"] and res["types_ok"] and res["values_ok"] and \
        res["rows"][0] == res["rows"][1]
    return res


def main(argv):
    import __spark_entry__ as entry
    from vitrine.session import build_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = build_session("local[8]")
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(qs):
        if name not in sqls:
            print(f"{name}: no oracle (rows only)")
            continue
        try:
            r = compare(spark, con, name, qs[name], sqls[name], sf_dir)
        except Exception as exc:  # noqa: BLE001
            r = {"name": name, "ok": False, "error": repr(exc)[:400]}
        bad += not r["ok"]
        print(r, flush=True)
    print(f"{len(names or qs) - bad} ok, {bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
