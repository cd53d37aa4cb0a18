"""Compare registered queries with their SQL: ``python -m tests.compare SF_DIR [name …]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = []
    for row in rows:
        values = []
        for i in order:
            v = row[i]
            if isinstance(v, float) and math.isnan(v):
                v = None
            values.append(v)
        shaped.append(tuple(values))
    return [columns[i] for i in order], sorted(shaped, key=lambda t: tuple(str(v) for v in t))


def kind(name: str) -> str:
    """The common name of a Spark or SQL type."""
    return {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(name, name)


def difference(spark_df, db, sql) -> str | None:
    """None when names, types and values are equal, else the first difference."""
    left_cols, left = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = db.execute(sql)
    described = [(d[0], str(d[1])) for d in result.description]
    right_cols, right = canonical([n for n, _ in described], result.fetchall())
    if left_cols != right_cols:
        return f"columns {left_cols} != {right_cols}"
    types = {n: kind(t) for n, t in spark_df.dtypes}
    wrong = {n: (types[n], t) for n, t in described if types[n] != t}
    if wrong:
        return f"types {wrong}"
    if len(left) != len(right):
        extra = [r for r in left if r not in set(right)][:2], [r for r in right if r not in set(left)][:2]
        return f"rows {len(left)} != {len(right)}: {extra}"
    for a, b in zip(left, right):
        if a != b:
            n = sum(x != y for x, y in zip(left, right))
            return f"{n} of {len(left)} rows differ, first {a} != {b}"
    return None


def main() -> None:
    from barograph.session import get_spark
    from barograph.plans.oracles import oracle_sql
    from barograph.plans.queries import REGISTRY

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(REGISTRY)
    spark = get_spark(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    db, sql = connect(sf_dir), oracle_sql()
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in sql:
                problem = difference(REGISTRY[name](spark, sf_dir), db, sql[name])
            else:
                problem = None if REGISTRY[name](spark, sf_dir).count() > 0 else "no rows"
        except Exception as e:  # noqa: BLE001 - reported and counted
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{time.time() - start:6.2f}s {name} {'ok' if problem is None else 'FAIL ' + problem}" + ("" if name in sql else " (rows only)"), flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    sys.exit(bad > 0)


if __name__ == "__main__":
    main()
