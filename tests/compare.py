"""Compares a registered query with its SQL in DuckDB: same columns, same rows, any order."""

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _clean(v):
    if isinstance(v, float) and v != v:
        return "NaN"
    return v


def differences(spark_df, con, sql):
    """Empty string when equal, otherwise a short account."""
    names = sorted(spark_df.columns)
    left = [tuple(_clean(v) for v in row) for row in spark_df.select(*names).collect()]
    cur = con.execute(sql)
    sql_names = [c[0] for c in cur.description]
    if sorted(sql_names) != names:
        return f"columns {names} vs {sorted(sql_names)}"
    order = [sql_names.index(n) for n in names]
    right = [tuple(_clean(row[i]) for i in order) for row in cur.fetchall()]
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    key = lambda t: tuple((v is None, str(type(v)), v) if not isinstance(v, (list, dict)) else (False, "l", str(v)) for v in t)
    try:
        left, right = sorted(left, key=key), sorted(right, key=key)
    except TypeError:
        left, right = sorted(left, key=str), sorted(right, key=str)
    bad = [(a, b) for a, b in zip(left, right) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    return f"{len(bad)} of {len(left)} rows differ, e.g. {names} {bad[0]}" if bad else ""
