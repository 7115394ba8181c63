"""Conversations of an owner in an organisation: list, guarded upsert, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def listed(conversations: DataFrame, owner: str, org: str, most: int = 200) -> DataFrame:
    own = conversations.where((F.col("owner") == owner) & (F.col("org") == org))
    return own.orderBy(F.desc("updated_at"), "id").limit(most)


def upsert(conversations: DataFrame, fresh: DataFrame) -> DataFrame:
    """With fresh rows by id; a row of another owner or organisation is not replaced."""
    taken = conversations.join(fresh.select("id", F.col("owner").alias("_o"), F.col("org").alias("_g")), "id").where("owner <> _o or org <> _g").select("id")
    allowed = fresh.join(taken, "id", "left_anti")
    return conversations.join(allowed.select("id"), "id", "left_anti").unionByName(allowed)


def without(conversations: DataFrame, conversation_id: str, owner: str, org: str) -> DataFrame:
    return conversations.where(~((F.col("id") == conversation_id) & (F.col("owner") == owner) & (F.col("org") == org)))
