"""python tests/compare.py SF [NAME...]: runs queries beside their SQL twins and prints differences."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    plain = lambda v: v.tolist() if hasattr(v, "tolist") else v
    def norm(v):
        v = plain(v)
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, float):
            return int(v) if v == int(v) else round(v, 9)
        if hasattr(v, "isoformat"):
            return v.isoformat()[:10]
        return [norm(x) for x in v] if isinstance(v, list | tuple) else str(v) if not isinstance(v, int | bool | str) else v
    return sorted((repr([norm(v) for v in r]) for r in frame.itertuples(index=False, name=None)))


def main(sf: str, names: list[str]) -> int:
    d = f"/root/testdata/{sf}"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    bad = 0
    oracle = entry.oracle_sql()
    for name, run in entry.queries().items():
        if names and not any(name == n or name.startswith(n) for n in names):
            continue
        try:
            t0 = time.time()
            got = run(spark, d).toPandas()
            t1 = time.time()
            if name not in oracle:
                print(f"{name}: {len(got)} rows, {t1 - t0:.1f} s, no SQL", flush=True)
                continue
            want = con.sql(oracle[name]).df()
            a, b = rows(got), rows(want)
            same = sorted(got.columns) == sorted(want.columns) and a == b
            bad += not same
            print(f"{name}: {'same' if same else 'DIFFERENT'} {len(a)} {len(b)} rows, {t1 - t0:.1f} s, SQL {time.time() - t1:.1f} s", flush=True)
            if not same:
                sa, sb = set(a), set(b)
                print("  ", sorted(got.columns), sorted(want.columns), "\n   spark:", sorted(sa - sb)[:4], "\n   sql:  ", sorted(sb - sa)[:4])
        except Exception as e:
            bad += 1
            print(f"{name}: FAILED {str(e)[:600]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
