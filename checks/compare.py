"""Run queries and oracles side by side: ``python -m checks.compare [sf] [key ...]``."""

from __future__ import annotations

import sys
import time

import duckdb

from holdspan.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def rows_of(names: list[str], rows: list) -> list[str]:
    """Rows as sorted text, columns in name order."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("|".join(_text(row[i]) for i in order) for row in rows)


def _text(value) -> str:
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value))
    return str(value)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    conn = duckdb.connect()
    for name in TABLES:
        conn.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return conn


def compare(spark, conn, sf_dir: str, build, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = build(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return True, f"{len(got)} rows, no oracle, {took:.1f}s"
    result = conn.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} / {sorted(names)}"
    if got == want:
        return True, f"{len(got)} rows, {took:.1f}s"
    extra = [x for x in got if x not in set(want)][:3]
    missing = [x for x in want if x not in set(got)][:3]
    return False, f"{len(got)} / {len(want)} rows\n  {sorted(names)}\n  spark only {extra}\n  oracle only {missing}"


def main() -> int:
    from checks import all_queries

    queries, oracles = all_queries()
    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    wanted = args[1:] or list(queries)
    sf_dir = f"/root/testdata/sf{sf}"
    spark, conn = local_session(8), connect(sf_dir)
    bad = 0
    for key in queries:
        if not any(key == w or (w.endswith("*") and key.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, note = compare(spark, conn, sf_dir, queries[key], oracles.get(key))
        except Exception as error:  # report and go on with the others
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + f"{key}: {note}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main())
