"""Signed writes: signing on the driver, checks and diffs as set operations."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import ed25519
from quillgraph.functions.ids import packed
from quillgraph.operators.merge import merge_nodes
from quillgraph.operators.supersede import SECOND_PARTY, apply_supersessions, assertable, clock, ends_packed, ends_unpacked, judge, upsert_edges, upsert_nodes
from quillgraph.schema import edge_tag


def writer_seed(gateway_key: bytes, subject: str) -> bytes:
    """A writer's own signing seed from the gateway's key."""
    return hashlib.sha256(len(gateway_key).to_bytes(8, "little") + gateway_key + subject.encode()).digest()


def sign_id(seed: bytes, node_id: str) -> bytes:
    return ed25519.sign(seed, bytes.fromhex(node_id))


def edge_key(from_id: Column, to_id: Column, kind: Column) -> Column:
    """What an edge's signature covers: both ids and the kind's tag."""
    return F.concat(F.unhex(from_id), F.unhex(to_id), F.unhex(F.lpad(F.hex(edge_tag(kind)), 2, "0")))


def check_nodes(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """nodes with `ok`: plane and tier may be asserted, and the author's key (author, key) signed the id."""
    held = nodes.join(keys.select("author", "key"), "author", "left")
    return held.withColumn("ok", assertable() & ed25519.verified("key", F.unhex("id"), "signature")).drop("key")


def check_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """edges (with author) with `ok`: the author's key signed the edge's key."""
    held = edges.join(keys.select("author", "key"), "author", "left")
    return held.withColumn("ok", ed25519.verified("key", edge_key(F.col("from_id"), F.col("to_id"), F.col("kind")), "signature")).drop("key")


def judge_diff(stored: DataFrame, stored_edges: DataFrame, nodes: DataFrame, edges: DataFrame, writer: str, now: int) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a diff with `reason`, null for what may be applied.

    A known node may be joined only by its own author; a new one of another author must have the state of a
    first insert (active, open, no embedding); no time lies beyond now.  An edge that supersedes, refutes or
    contradicts another author's node stays a proposal; a known proposal is not promoted by a diff.
    """
    known = stored.select("id", F.col("author").alias("owner"))
    judged = nodes.join(known, "id", "left")
    fresh = F.col("owner").isNull()
    first = (F.col("status") == "Active") & F.col("valid_to").isNull()
    judged = judged.withColumn(
        "reason",
        F.when(~F.col("ok"), "signature")
        .when(~fresh & (F.col("owner") != writer), "not the author")
        .when(fresh & (F.col("author") != writer) & ~first, "not as first inserted")
        .when((F.col("valid_from") > now) | (F.col("observed_at") > now), "time"),
    ).drop("owner")
    owners = stored.select("id", "author").unionByName(nodes.select("id", "author")).withColumn("id", packed(F.col("id"))).dropDuplicates(["id"])
    target = owners.select(F.col("id").alias("to_id"), F.col("author").alias("target_author"))
    source = owners.select(F.col("id").alias("from_id"), F.lit(True).alias("known_source"))
    held = ends_packed(stored_edges.select("from_id", "to_id", "kind", F.col("quarantined").alias("was_proposal")))
    links = ends_packed(edges).join(target, "to_id", "left").join(source, "from_id", "left").join(held, ["from_id", "to_id", "kind"], "left")
    links = ends_unpacked(links).withColumn(
        "reason",
        F.when(~F.col("ok"), "signature")
        .when(F.col("target_author").isNull() | F.col("known_source").isNull(), "endpoint")
        .when(F.col("kind").isin(*SECOND_PARTY) & (F.col("target_author") != writer) & ~F.col("quarantined"), "needs a second party")
        .when(F.col("was_proposal") & ~F.col("quarantined"), "promotion"),
    ).drop("target_author", "known_source", "was_proposal")
    return judged, links


def apply_diff(stored: DataFrame, stored_edges: DataFrame, judged: tuple[DataFrame, DataFrame], now: int = 0) -> tuple[DataFrame, DataFrame]:
    """The graph with the diff, all of it or, if anything was refused, an error that names the first reason.

    The writer's own confirmed supersessions go through the guards too and retire their targets.
    """
    nodes, edges = judged
    refused = nodes.select("reason").unionByName(edges.select("reason")).where("reason is not null").agg(F.count("*").alias("n"), F.min("reason").alias("reason")).first()
    if refused["n"]:
        raise ValueError(f"{refused['n']} items refused, such as: {refused['reason']}")
    # A known node of the writer is joined with what is stored, as in a merge; a new one comes in without an embedding.
    bare = nodes.withColumn("embedding", F.lit(None).cast(stored.schema["embedding"].dataType)) if "embedding" in stored.columns else nodes
    touched = stored.join(nodes.select("id"), "id", "left_semi").unionByName(bare.select(*stored.columns))
    known = upsert_nodes(stored, merge_nodes(touched).select(*stored.columns))
    claims = edges.where("kind = 'Supersedes' and not quarantined")
    at = clock(claims) if {"at", "provenance"} & set(claims.columns) else F.lit(now).cast("long")
    asked = claims.withColumn("at", at)
    if not asked.isEmpty():
        fate = judge(known, stored_edges, asked.drop("reason"))
        barred = fate.where("reason is not null").agg(F.count("*").alias("n"), F.min("reason").alias("reason")).first()
        if barred["n"]:
            raise ValueError(f"{barred['n']} supersessions refused, such as: {barred['reason']}")
        known = apply_supersessions(known, fate).select(*stored.columns)
    return known, upsert_edges(stored_edges, edges.select(*stored_edges.columns))
