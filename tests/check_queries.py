"""Run queries beside their SQL and compare. ``python tests/check_queries.py [sf] [names]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from gapwise.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v) -> str:
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, pd.Timestamp):
        return str(v.tz_localize(None) if v.tz else v)
    return repr(v.item() if hasattr(v, "item") else v)


def normal(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(_cell(v) for v in row) for row in pdf.itertuples(index=False, name=None))


def differences(spark_pdf: pd.DataFrame, sql_pdf: pd.DataFrame) -> list[str]:
    found = []
    if sorted(spark_pdf.columns) != sorted(sql_pdf.columns):
        return [f"columns {sorted(set(spark_pdf.columns) ^ set(sql_pdf.columns))}"]
    for c in sorted(spark_pdf.columns):
        kinds = {str(d).replace("[us]", "[ns]") for d in (spark_pdf[c].dtype, sql_pdf[c].dtype)}
        if len(kinds) > 1:
            found.append(f"type of {c}: {spark_pdf[c].dtype} / {sql_pdf[c].dtype}")
    if len(spark_pdf) != len(sql_pdf):
        found.append(f"rows {len(spark_pdf)} / {len(sql_pdf)}")
    elif (a := normal(spark_pdf)) != (b := normal(sql_pdf)):
        names = sorted(spark_pdf.columns)
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        first = [(n, p, q) for n, p, q in zip(names, *bad[0]) if p != q]
        found.append(f"{len(bad)} rows differ, first: {first[:4]}")
    return found


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    only = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - start
            if name in oracles:
                found = differences(got, con.sql(oracles[name]).df())
            else:
                found = [] if len(got) else ["no rows"]
        except Exception as e:
            took, got, found = time.time() - start, [], [f"{type(e).__name__}: {str(e)[:600]}"]
        spark.catalog.clearCache()
        bad += bool(found)
        print(f"{'BAD ' if found else 'ok  '} {name:24s} rows={len(got):6d} {took:6.2f}s "
              f"{'' if name in oracles else '(rows only) '}{'; '.join(found)}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
