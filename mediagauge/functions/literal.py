"""Small fixed tables as literals of the plan, without a job of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """``rows`` of numbers, texts, booleans and nulls with the columns of ``ddl``; no rows give an empty table."""
    columns = [c.strip().rsplit(" ", 1) for c in ddl.split(",")]
    if not rows:
        return spark.createDataFrame([], ddl)
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    names = ", ".join(f"`{n}`" for n, _ in columns)
    casts = ", ".join(f"cast(`{n}` as {t}) as `{n}`" for n, t in columns)
    return spark.sql(f"select {casts} from values {values} as t({names})")
