"""Compares registered queries with their SQL; the driver's check in miniature.

usage: python tests/check_oracle.py [sf] [name-prefix ...]
"""

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def canon(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return str(value)
    if hasattr(value, "as_tuple"):
        return f"{float(value):.6f}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


def main(argv):
    import __spark_entry__ as entry
    from quietwire.session import build_session

    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    base = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                "spark.driver.memory": "12g",
                                                "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{base}/{name}.parquet'")
    oracles, failed = entry.oracle_sql(), []
    for name, plan in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = plan(spark, base)
            got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            spark_sec = time.time() - start
            if name not in oracles:
                print(f"rows  {name}: {len(got)} rows {spark_sec:.1f}s", flush=True)
                continue
            start = time.time()
            cur = con.execute(oracles[name])
            want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
            sql_sec = time.time() - start
        except Exception as error:  # report and go on
            failed.append(name)
            print(f"ERROR {name}: {str(error)[:700]}", flush=True)
            continue
        ok = got_cols == want_cols and got == want
        print(f"{'ok   ' if ok else 'DIFF '} {name}: {len(got)}/{len(want)} rows "
              f"{spark_sec:.1f}s sql {sql_sec:.1f}s", flush=True)
        if not ok:
            failed.append(name)
            if got_cols != want_cols:
                print("   columns", sorted(set(got_cols) ^ set(want_cols)))
            else:
                shown = 0
                for a, b in zip([r for r in got if r not in set(want)],
                                [r for r in want if r not in set(got)]):
                    print("   ", [(c, x, y) for c, x, y in zip(got_cols, a, b) if x != y][:6] or (a, b))
                    shown += 1
                    if shown == 3:
                        break
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
