"""Compare a registered query with its SQL on the same Parquet tables."""

import glob
import os

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, all values as comparable text, rows sorted."""
    out = pd.DataFrame(index=range(len(df)))
    for c in sorted(df.columns):
        out[c] = [_text(v) for v in df[c].tolist()]
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def _text(value) -> str:
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value) or value is pd.NA:
        return "NULL"
    if hasattr(value, "strftime"):
        return value.strftime("%Y-%m-%d")
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, (int, float)):
        return repr(float(value))
    return str(value)


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Human-readable differences; empty when both sides agree."""
    mine = canonical(spark_df.toPandas())
    theirs = canonical(con.execute(sql).df())
    if list(mine.columns) != list(theirs.columns):
        return [f"columns {list(mine.columns)} vs {list(theirs.columns)}"]
    if len(mine) != len(theirs):
        return [f"{len(mine)} rows vs {len(theirs)}"]
    bad = (mine != theirs).any(axis=1)
    if bad.any():
        first = bad.idxmax()
        cols = [c for c in mine.columns if mine.loc[first, c] != theirs.loc[first, c]]
        return [f"{int(bad.sum())} rows differ; first in {cols}: {mine.loc[first].to_dict()} vs {theirs.loc[first].to_dict()}"]
    kinds = dict(spark_df.dtypes)
    relation = con.sql(sql)
    expected = {n: str(t) for n, t in zip(relation.columns, relation.types)}
    names = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean", "FLOAT": "float"}
    return [f"type of {c}: {kinds[c]} vs {t}" for c, t in expected.items() if names.get(t, t) != kinds[c]]
