"""Runs registered queries and their DuckDB statements side by side.

    python -m checks.compare [sf dir] [name part ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

from cinderlog.plans.catalog import QUERIES
from cinderlog.session import local_session

from .oracles import ORACLES


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else f"{value:.6f}"
        return str(value)

    return sorted(tuple(plain(row[i]) for i in order) for row in data)


def difference(spark, con, sf_dir: str, name: str) -> tuple[str | None, int]:
    """What differs, None if nothing does, and the number of rows."""
    ours = QUERIES[name](spark, sf_dir)
    mine = rows(ours.columns, ours.collect())
    if name not in ORACLES:
        return (None if mine else "no rows, and no statement to compare with"), len(mine)
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    theirs = rows(columns, result.fetchall())
    if sorted(ours.columns) != sorted(columns):
        return f"columns {sorted(ours.columns)} / {sorted(columns)}", len(mine)
    if mine != theirs:
        only_ours = sorted(set(mine) - set(theirs))[:2]
        only_theirs = sorted(set(theirs) - set(mine))[:2]
        rest = f"{str(only_ours)[:300]} / {str(only_theirs)[:300]}"
        return f"rows {len(mine)} / {len(theirs)}: {rest}", len(mine)
    return None, len(mine)


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = local_session(), database(sf_dir)
    failed = 0
    for name in QUERIES:
        if wanted and not any(part in name for part in wanted):
            continue
        started = time.time()
        try:
            problem, size = difference(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, size = f"{type(error).__name__}: {str(error)[:300]}", 0
        mark = "ok  " if problem is None else "FAIL"
        checked = "" if name in ORACLES else " (no oracle)"
        print(f"{mark} {time.time() - started:6.2f}s {name} {size} rows{checked} {problem or ''}", flush=True)
        failed += problem is not None
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
