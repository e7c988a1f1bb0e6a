"""Joins on keys of which a few hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.shared import staged

#: So many of the heaviest keys, at most, are broadcast.
HOT_KEYS = 1000


def join_heavy(rows: DataFrame, lookup: DataFrame, key: str, weight: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """The inner join of rows with lookup (a staged table, one row a key) on key.

    The lookup rows of the heaviest keys, at most hot_keys, are broadcast, so
    that their rows aren't gathered in a task; only the others are shuffled, and
    no key among them holds more than one part in hot_keys of all rows.
    """
    hot = staged(lookup.orderBy(F.desc(weight), key).limit(hot_keys), "hot").withColumn("_hot", F.lit(True))
    own = [c for c in lookup.columns if c != key]
    tagged = rows.join(F.broadcast(hot), key, "left")
    columns = [*rows.columns, *own]
    rest = tagged.where("_hot is null").select(rows.columns).join(lookup, key)
    return tagged.where("_hot").select(columns).unionByName(rest.select(columns))
