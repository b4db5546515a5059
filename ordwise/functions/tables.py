"""Table functions for SQL: functions that Catalyst inlines, so a call becomes a generator inside its stage."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name(parameters) to (columns, body).
_FUNCTIONS = {
    "ordwise_counting(n BIGINT, first BIGINT, step BIGINT)": (
        "pos BIGINT, value BIGINT",
        "SELECT p, ordwise_counting.first + ordwise_counting.step * p FROM (SELECT explode(CASE WHEN ordwise_counting.n > 0 THEN sequence(0L, ordwise_counting.n - 1) ELSE array() END) AS p)",
    ),
    "ordwise_expand(v BIGINT, n BIGINT)": (
        "rank BIGINT, value BIGINT",
        "SELECT r, ordwise_expand.v FROM (SELECT explode(CASE WHEN ordwise_expand.n > 0 THEN sequence(0L, ordwise_expand.n - 1) ELSE array() END) AS r)",
    ),
    "ordwise_tiles(n BIGINT, size BIGINT)": (
        "tile BIGINT, first BIGINT, past BIGINT",
        "SELECT t, t * ordwise_tiles.size, least((t + 1) * ordwise_tiles.size, ordwise_tiles.n) FROM (SELECT explode(CASE WHEN ordwise_tiles.n > 0 THEN sequence(0L, CAST(floor((ordwise_tiles.n - 1) / ordwise_tiles.size) AS BIGINT)) ELSE array() END) AS t)",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL; gives their names.

    ordwise_counting: pos and first, first + step, ...; ordwise_expand: a value n times with its rank (n null or not
    above 0: no rows); ordwise_tiles: the tiles of n places, [first, past). They take columns of tables before them
    through LATERAL.
    """
    for head, (columns, body) in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS TABLE({columns}) RETURN {body}")
    return [head.partition("(")[0] for head in _FUNCTIONS]
