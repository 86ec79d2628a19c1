"""Equi-joins whose hot keys must not land in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when more than one in so many rows have it; so there are at most so many hot keys.
HOT_KEYS = 1000


def hot_join(rows: DataFrame, owners: DataFrame, on: Sequence[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with owners on the columns named in on; owners has one row a key.

    weight names the column of owners that counts the rows with the key, and total is their
    sum or more. Hot keys, at most HOT_KEYS by that arithmetic, go by broadcast; the other rows are
    shuffled, and no aggregate stands in that join's stage, so AQE may split what is still
    uneven. Both inputs are read more than once: pass written tables. how: inner or left.
    """
    heavy = owners.where(F.col(weight) * HOT_KEYS > total)
    hot = rows.join(F.broadcast(heavy), list(on))
    light = owners.where(F.col(weight) * HOT_KEYS <= total)
    rest = rows.join(F.broadcast(heavy.select(*on)), list(on), "left_anti").join(light, list(on), how)
    return rest.unionByName(hot)


#: Rows that a task gets of rows dealt by dealt().
ROWS_A_TASK = 100_000


def dealt(rows: DataFrame, on: Sequence[str], a_task: int = ROWS_A_TASK) -> DataFrame:
    """rows hashed by the columns named in on into as many partitions as it takes for about a_task rows each.

    What one task sorts or holds so stays the same however many rows there are, and later steps on these columns need no
    other exchange. Rows are counted first. One key's rows still meet in one task.
    """
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // a_task))
    return rows.repartition(parts, *on)
