"""Conversations, runs and preferences: the latest rows, digests of older turns, governed projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import VISIBLE

MOST_ROWS, MOST_CHARS, MOST_RUNS = 200, 500, 50


def latest(df: DataFrame, key: str, *order: Column, newest: int | None = None, by: str | None = None) -> DataFrame:
    """The last row of each key, and of those the newest `newest` by column `by`."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    out = df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return out.orderBy(F.desc(by), key).limit(newest) if newest else out


def latest_child(parents: DataFrame, children: DataFrame, key: str, payload: str, version: str) -> DataFrame:
    """Parents with the newest payload of their children, or null: the children are aggregated before they are joined."""
    newest = children.groupBy(key).agg(F.max_by(payload, F.struct(version, payload)).alias(payload), F.max(version).alias(version))
    return parents.join(newest, key, "left")


def digest(messages: DataFrame, last: int = 6, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = MOST_CHARS) -> DataFrame:
    """The last `last` messages of each conversation, and one system row for the older ones, each cut at `most` characters.

    The digest has turn -1 and stands before the others.
    """
    rank = F.row_number().over(Window.partitionBy(conversation).orderBy(F.desc(turn)))
    ranked = messages.select(conversation, turn, role, text, rank.alias("_rank"))
    line = F.concat(F.col(role), F.lit(": "), F.substring(F.coalesce(F.col(text), F.lit("")), 1, most))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(turn, line.alias("_l")))), lambda x: x["_l"])
    older = ranked.where(F.col("_rank") > last).groupBy(conversation).agg(F.array_join(ordered, "\n").alias(text))
    return ranked.where(F.col("_rank") <= last).drop("_rank").unionByName(older.select(conversation, F.lit(-1).cast(messages.schema[turn].dataType).alias(turn), F.lit("system").alias(role), text))


def governed(df: DataFrame, table: str, columns: list[str], limit: int, visible: dict[str, tuple[str, ...]] | None = None, order: list[Column] | None = None) -> DataFrame:
    """Allowed columns of a table, at most `limit` rows (1 to 200); more rows than that are an error and not cut."""
    allowed = (visible or VISIBLE).get(table)
    if allowed is None:
        raise ValueError(f"table {table} isn't visible")
    if wrong := [c for c in columns if c not in allowed]:
        raise ValueError(f"{table} shows no {', '.join(wrong)}")
    if not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"limit must be 1 to {MOST_ROWS}")
    out = df.orderBy(*order).select(*columns) if order else df.select(*columns)
    if out.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows")
    return out
