"""Run registered queries against their SQL on the same parquet tables."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle_frame(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con.execute(sql).df()


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), na_position="first", kind="stable").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    got, want = ordered(got), ordered(want)
    for name in got.columns:
        a, b = got[name], want[name]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            at = same.index[~same][0]
            return (f"{name}: {int((~same).sum())} of {len(a)} differ ({a.dtype}/{b.dtype}), first at {at}:\n"
                    f"{got.loc[at].to_dict()}\n{want.loc[at].to_dict()}")
    return None


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as driver
    from tests.conftest import make_session

    spark = make_session()
    queries, sqls = driver.queries(), driver.oracle_sql()
    failed = 0
    for name in names or queries:
        started = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            note = "rows only" if name not in sqls else difference(got, oracle_frame(sf_dir, sqls[name]))
        except Exception as error:
            got, note = pd.DataFrame(), f"{type(error).__name__}: {str(error)[:1500]}"
        failed += note not in (None, "rows only")
        print(f"{name}: {note or 'ok'} ({len(got)} rows, {time.time() - started:.1f} s)", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
