"""Run registered queries against their SQL: ``python -m checks.compare [sf] [key…]``."""

from __future__ import annotations

import sys
import time

import duckdb

from checks.fixtures import TABLES
from checks.oracles import ORACLES
from checks.queries import QUERIES
from hiregrid.session import build_session


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS FROM '{sf_dir}/{name}.parquet'")
    return con


def normal_rows(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """What differs between a Spark result and its SQL, None if nothing does."""
    relation = con.sql(sql)
    spark_types = sorted((name, TYPES.get(kind, kind)) for name, kind in df.dtypes)
    sql_types = sorted(zip(relation.columns, map(str, relation.types)))
    if spark_types != sql_types:
        return f"columns {spark_types} != {sql_types}"
    ours = normal_rows(df.columns, [tuple(r) for r in df.collect()])
    theirs = normal_rows(relation.columns, relation.fetchall())
    if ours == theirs:
        return None
    only_ours, only_theirs = sorted(set(ours) - set(theirs)), sorted(set(theirs) - set(ours))
    return f"{len(ours)} / {len(theirs)} rows\n  ours   {[r[:300] for r in only_ours[:3]]}\n  oracle {[r[:300] for r in only_theirs[:3]]}"


def main(sf: str = "0.01", *keys: str) -> int:
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.log.level": "ERROR",
           "spark.ui.showConsoleProgress": "false"},
    )
    con, bad = connect(sf_dir), 0
    for key in keys or QUERIES:
        start = time.time()
        try:
            found = difference(QUERIES[key](spark, sf_dir), con, ORACLES[key]) if key in ORACLES else "no oracle"
        except Exception as error:  # report every query
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += found is not None
        print(f"{key:28s} {time.time() - start:6.1f}s {'ok' if found is None else found}", flush=True)
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
