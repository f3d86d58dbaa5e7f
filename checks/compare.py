"""Run registered queries beside their SQL: ``python -m checks.compare FOLDER [NAME ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from checks.fixtures import TABLES
from checks.oracle import oracle_sql
from checks.queries import QUERIES
from frostline.session import build_session


def _kind(values: pd.Series) -> str:
    name = str(values.dtype).lower()
    return "number" if name.startswith(("int", "float")) else "other"


def _texts(df: pd.DataFrame) -> list[str]:
    out = pd.DataFrame(index=df.index)
    for c in sorted(df.columns):
        v = df[c]
        if str(v.dtype).lower().startswith("float"):
            out[c] = v.map(lambda x: "null" if pd.isna(x) else repr(float(x) + 0.0))
        elif str(v.dtype).lower().startswith("datetime"):
            out[c] = v.map(lambda x: "null" if pd.isna(x) else str(x)[:19].replace(" 00:00:00", ""))
        else:
            out[c] = v.map(lambda x: "null" if pd.api.types.is_scalar(x) and pd.isna(x) else str(x))
    return sorted(out.agg("|".join, axis=1).tolist()) if len(out) else []


def main(folder: str, names: list[str]) -> int:
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    oracle, bad = oracle_sql(), []
    for name in names or list(QUERIES):
        start = time.time()
        try:
            got = QUERIES[name](spark, folder).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{name}: SPARK ERROR {str(e)[:1500]}", flush=True)
            bad.append(name)
            continue
        took = time.time() - start
        if name not in oracle:
            print(f"{name}: {len(got)} rows, no SQL  [{took:.1f}s]", flush=True)
            continue
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
        start = time.time()
        try:
            want = con.execute(oracle[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"{name}: SQL ERROR {str(e)[:900]}", flush=True)
            bad.append(name)
            continue
        took_sql = time.time() - start
        if sorted(got.columns) != sorted(want.columns):
            print(f"{name}: COLUMNS {sorted(got.columns)} / {sorted(want.columns)}", flush=True)
            bad.append(name)
            continue
        types = [(c, str(got[c].dtype), str(want[c].dtype)) for c in got.columns
                 if str(got[c].dtype).lower() != str(want[c].dtype).lower() and _kind(got[c]) + _kind(want[c]) != "otherother"]
        a, b = _texts(got), _texts(want)
        if a != b:
            only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
            print(f"{name}: DIFFERENT {len(a)} / {len(b)} rows, {len(only_a)} / {len(only_b)} only on one side {types} [{took:.1f}s {took_sql:.1f}s]")
            print("   columns", sorted(got.columns))
            for x in only_a[:3]:
                print("   spark", x)
            for x in only_b[:3]:
                print("   sql  ", x, flush=True)
            bad.append(name)
        else:
            print(f"{name}: same, {len(a)} rows {types or ''} [{took:.1f}s {took_sql:.1f}s]", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
