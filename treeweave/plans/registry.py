"""Registry of queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Fixed value: the Unicode White_Space class, for the check engine.
WHITE_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def values(rows: list[tuple], columns: str) -> str:
    """Fixed rows as a SQL table."""
    quoted = ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {quoted}) v({columns})"


def glob_sql(pattern: str, path: str) -> str:
    return (
        f"CASE WHEN starts_with({pattern}, '*.') THEN ends_with({path}, substr({pattern}, 2)) "
        f"WHEN ends_with({pattern}, '/*') THEN starts_with({path}, left({pattern}, length({pattern}) - 2)) "
        f"AND length({path}) > length({pattern}) - 2 "
        f"WHEN length({pattern}) - length(replace({pattern}, '*', '')) = 1 "
        f"THEN starts_with({path}, split_part({pattern}, '*', 1)) AND ends_with({path}, split_part({pattern}, '*', 2)) "
        f"ELSE {path} = {pattern} OR starts_with({path}, {pattern} || '/') END"
    )


def include_sql(pattern: str, path: str) -> str:
    name = f"split_part({path}, '/', -1)"
    return (
        f"CASE WHEN ends_with({pattern}, '/') THEN starts_with({path}, left({pattern}, length({pattern}) - 1)) "
        f"AND length({path}) > length({pattern}) - 1 "
        f"WHEN NOT contains({pattern}, '/') THEN {glob_sql(pattern, name)} ELSE {glob_sql(pattern, path)} END"
    )


def words_sql(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[^" + WHITE_SPACE + "]+'))"


def lines_sql(text: str) -> str:
    open_end = f"CASE WHEN {text} <> '' AND NOT ends_with({text}, chr(10)) THEN 1 ELSE 0 END"
    return f"(length({text}) - length(replace({text}, chr(10), '')) + {open_end})"


def tokens_sql(n_bytes: str, words: str, lines: str) -> str:
    return (
        f"CAST(trunc((CAST({n_bytes} AS FLOAT) / CAST(3.3 AS FLOAT) + CAST({words} AS FLOAT) * CAST(0.75 AS FLOAT)) "
        f"/ CAST(2 AS FLOAT) + CAST({lines} AS FLOAT) * CAST(0.1 AS FLOAT)) AS BIGINT)"
    )


def text_tokens_sql(text: str) -> str:
    return tokens_sql(f"strlen({text})", words_sql(text), lines_sql(text))
