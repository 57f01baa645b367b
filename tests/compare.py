"""Compare queries with their SQL on DuckDB: ``python tests/compare.py <folder> [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 7) + 0.0
    return v


def rows_of(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [[_cell(v) for v in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns), key=repr)


def types_of(table) -> dict[str, str]:
    return {n: str(table.schema.field(n).type).replace("large_", "") for n in sorted(table.column_names)}


def compare(spark, con, folder: str, name: str, function, sql: str) -> str:
    started = time.time()
    got = function(spark, folder).toArrow()
    spark_time = time.time() - started
    started = time.time()
    want = con.execute(sql).to_arrow_table()
    duck_time = time.time() - started
    note = f"{spark_time:6.2f}s spark {duck_time:6.2f}s sql {got.num_rows:8d} rows"
    if types_of(got) != types_of(want):
        return f"TYPES {note} {types_of(got)} != {types_of(want)}"
    a, b = rows_of(got), rows_of(want)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b), key=repr)[:3], sorted(set(b) - set(a), key=repr)[:3]
        return f"DIFF  {note} sql has {len(b)} rows; spark only {only_a}; sql only {only_b}"
    return f"ok    {note}"


def main() -> int:
    from gridwave.session import session
    from gridwave.workload import all_oracles, all_queries

    folder, names = sys.argv[1], sys.argv[2:]
    spark = session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    queries, oracles = all_queries(), all_oracles()
    for name in names or queries:
        try:
            if name in oracles:
                result = compare(spark, con, folder, name, queries[name], oracles[name])
            else:
                started = time.time()
                n = queries[name](spark, folder).count()
                result = f"rows  {time.time() - started:6.2f}s spark {n:8d} rows"
        except Exception as e:  # noqa: BLE001 - report and go on
            result = f"FAIL  {type(e).__name__}: {str(e)[:600]}"
        bad += not result.startswith(("ok", "rows"))
        print(f"{name:28s} {result}", flush=True)
    print(f"{bad} not matching")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
