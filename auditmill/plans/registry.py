"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict = {}
ORACLES: dict = {}
FRAGMENTS: dict = {}


def comparable(df: DataFrame) -> DataFrame:
    """Plain types for a comparison across engines: no time zone, wide numbers."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "timestamp":
            c = c.cast("timestamp_ntz")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind == "float":
            c = c.cast("double")
        cols.append(c.alias(name))
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` may name fragments (``q_...``)."""
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: comparable(fn(spark, sf_dir))
        if sql:
            ORACLES[name] = with_fragments(sql)
        return fn
    return wrap


def fragment(name: str, sql: str) -> None:
    """A named sub-query that registered SQL can refer to by its name."""
    FRAGMENTS[name] = sql


def with_fragments(sql: str) -> str:
    """Prefix ``sql`` with the fragments it names, in order of need."""
    import re

    seen: list[str] = []

    def visit(text):
        for word in re.findall(r"\bq_\w+", text):
            if word in FRAGMENTS and word not in seen:
                visit(FRAGMENTS[word])
                if word not in seen:
                    seen.append(word)

    visit(sql)
    if not seen:
        return sql
    ctes = ",\n".join(f"{n} AS ({FRAGMENTS[n]})" for n in seen)
    head = "WITH "
    body = sql.lstrip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"{head}{ctes},\n{body[5:]}"
    return f"{head}{ctes}\n{body}"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_value(v) for v in values) + "]"


def sql_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (list, tuple)):
        return sql_list(v)
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def sql_values(rows, columns) -> str:
    body = ", ".join("(" + ", ".join(sql_value(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({', '.join(columns)})"
