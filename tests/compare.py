"""Run a registered query next to its SQL twin and compare the rows."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else float(f"{value:.12g}")
    return value


def kinds(rows, width):
    """Python type per column; None where a column has no value."""
    out = []
    for i in range(width):
        found = {type(r[i]) for r in rows if r[i] is not None}
        out.append(found.pop().__name__ if len(found) == 1 else ("mixed" if found else None))
    return out


def compare(spark_df, con, sql: str) -> str | None:
    """None when both agree, else what differs."""
    cols = sorted(spark_df.columns)
    left = [tuple(plain(v) for v in r) for r in spark_df.select(*[f"`{c}`" for c in cols]).collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    right = [tuple(plain(r[i]) for i in at) for r in cur.fetchall()]
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    lk, rk = kinds(left, len(cols)), kinds(right, len(cols))
    for c, a, b in zip(cols, lk, rk):
        if a != b and a and b:
            return f"type of {c}: {a} against {b}"
    extra, missing = Counter(left) - Counter(right), Counter(right) - Counter(left)
    if extra or missing:
        return f"{sum(extra.values())} rows differ in {cols}, e.g. {list(extra)[:2]} against {list(missing)[:2]}"
    return None
