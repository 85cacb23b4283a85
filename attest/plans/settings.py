"""The rule pack as a table: settings by session, which thousands of sessions can have in one job.

A row is (session_id, item, key, value, version). Items: tolerance (key: a metric; percent, or points where
the metric is compared in points), low and high (key: a metric; the ends of its plausible band) and weight
(key: a rule class; its base weight).

Defined cases: a row without a session is for all sessions; a session's own row goes before it, whatever the
versions; of several rows alike, the one of the highest version counts (none is below all), of equal versions
the larger value; rows without a value, and items or keys that nobody asks for, say nothing; without a row
the pack's own number holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SETTING = "session_id string, item string, key string, value double, version long"
ITEMS = ("tolerance", "low", "high", "weight")


def settled(df: DataFrame, own: DataFrame | None, item: str, key: str, name: str) -> DataFrame:
    """df with a column `name`: the setting of its session for what its column `key` names, null without one.

    Two equi-joins with groupings of the settings: by session and key, and by key alone.
    """
    if own is None:
        return df.withColumn(name, F.lit(None).cast("double"))
    rows = own.where((F.col("item") == item) & F.col("value").isNotNull() & F.col("key").isNotNull())
    best = F.max_by("value", F.struct(F.coalesce("version", F.lit(-(2**63))), "value"))
    mine = rows.where("session_id is not null").groupBy("session_id", F.col("key").alias(key)).agg(best.alias("__mine"))
    all_ = rows.where("session_id is null").groupBy(F.col("key").alias(key)).agg(best.alias("__all"))
    got = df.join(mine, ["session_id", key], "left").join(all_, key, "left")
    return got.select(*[F.col(c) for c in df.columns], F.coalesce("__mine", "__all").alias(name))
