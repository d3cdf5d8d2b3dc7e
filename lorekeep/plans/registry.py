"""Where queries and their SQL are collected, keyed by handle."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def stop_sql() -> str:
    from lorekeep.schema import STOPWORDS

    return ", ".join(f"'{w}'" for w in STOPWORDS)


def stem_steps(source: str, keep: str, name: str) -> str:
    """CTEs from source (keep, w) to name (keep, token): the stem rules in steps, stop words left out."""
    return f"""{name}_1 AS (SELECT {keep}, w, CASE WHEN right(w, 1) = 's' AND length(w) > 3 AND substr(w, length(w) - 1, 1) NOT IN ('s', 'u') THEN left(w, length(w) - 1) ELSE w END AS p FROM {source} WHERE w NOT IN ({stop_sql()})),
    {name}_2 AS (SELECT *, CASE WHEN right(p, 3) = 'ing' AND length(p) >= 6 THEN left(p, length(p) - 3) WHEN right(p, 2) = 'ed' AND length(p) >= 5 THEN left(p, length(p) - 2) END AS b FROM {name}_1),
    {name} AS (SELECT {keep}, CASE WHEN length(w) <= 2 OR (right(w, 2) = 'ss') THEN w WHEN right(w, 4) = 'sses' THEN left(w, length(w) - 2) WHEN right(w, 3) = 'ies' THEN (CASE WHEN length(w) > 4 THEN left(w, length(w) - 3) || 'i' ELSE left(w, length(w) - 1) END)
      WHEN b IS NULL OR length(b) < 3 THEN p WHEN right(b, 1) = substr(b, length(b) - 1, 1) AND right(b, 1) NOT IN ('l', 's', 'z') THEN left(b, length(b) - 1) ELSE b END AS token FROM {name}_2)"""


def tokens_sql(source: str, key: str, fields: list[tuple[str, int]], name: str = "toks") -> str:
    """CTEs ending in `name` (key, weight, token): one row an occurrence in a field."""
    parts = " UNION ALL ".join(f"SELECT {key}, {weight} AS weight, unnest(regexp_extract_all(lower({field}), '[\\p{{L}}\\p{{N}}]+')) AS w FROM {source}" for field, weight in fields)
    return f"{name}_w AS ({parts}), {stem_steps(f'{name}_w', f'{key}, weight', name)}"


def stream_sql(source: str, key: str, field: str, name: str) -> str:
    """CTEs ending in `name` (key, s): a field's stems in order, joined by spaces."""
    return f"{name}_w AS (SELECT {key}, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM (SELECT {key}, regexp_extract_all(lower({field}), '[\\p{{L}}\\p{{N}}]+') AS l FROM {source})), {stem_steps(f'{name}_w', f'{key}, pos', f'{name}_t')}, {name} AS (SELECT {key}, string_agg(token, ' ' ORDER BY pos) AS s FROM {name}_t GROUP BY {key})"


def micro(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"
