"""Merkle roots and chained anchors of a tenant's state."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import ed25519
from quillgraph.functions.ids import little_endian
from quillgraph.operators.graph import _keep, shared_dir
from quillgraph.schema import edge_tag, status_rank


def positions(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """df with each row's place (from 0) in a global order of columns that tell all rows apart.

    Range partitions are numbered on their own and offset by the sizes of those before, so no task sees all rows.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = _keep(ranged, shared_dir(df.sparkSession), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_place", place).join(before, "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(pos, hash): one leaf a node by id (id, status rank, valid_to), then one an edge by key (key, quarantined)."""
    state = F.concat(F.unhex("id"), F.unhex(F.lpad(F.hex(status_rank(F.col("status"))), 2, "0")), little_endian(F.coalesce("valid_to", F.lit(0)), 8))
    own = nodes.select(F.lit(0).alias("part"), F.col("id").alias("k1"), F.lit("").alias("k2"), F.lit(0).alias("k3"), F.sha2(state, 256).alias("hash"))
    tag = edge_tag(F.col("kind"))
    key = F.concat(F.unhex("from_id"), F.unhex("to_id"), F.unhex(F.lpad(F.hex(tag), 2, "0")), F.unhex(F.when(F.col("quarantined"), "01").otherwise("00")))
    links = edges.select(F.lit(1).alias("part"), F.col("from_id").alias("k1"), F.col("to_id").alias("k2"), tag.alias("k3"), F.sha2(key, 256).alias("hash"))
    return positions(own.unionByName(links), ["part", "k1", "k2", "k3"]).select("pos", "hash")


def merkle_root(numbered: DataFrame, repo: str) -> str:
    """Root over (pos, hash): pairs are hashed together, a lone last one alone; without leaves the hash of repo.

    Each level is one aggregation over half as many rows; the last few thousand hashes meet on the driver.
    """
    folder, level = shared_dir(numbered.sparkSession), 0
    count = numbered.count()
    while count > 4096:
        pair = F.array_sort(F.collect_list(F.struct("pos", "hash")))
        joined = F.concat(*[F.coalesce(F.unhex(F.try_element_at("pair", F.lit(k))["hash"]), F.lit(b"")) for k in (1, 2)])
        numbered = numbered.groupBy(F.floor(F.col("pos") / 2).alias("up")).agg(pair.alias("pair")).select(F.col("up").alias("pos"), F.sha2(joined, 256).alias("hash"))
        numbered = _keep(numbered, folder, f"level-{level}")
        count, level = -(-count // 2), level + 1
    row = [bytes.fromhex(r["hash"]) for r in numbered.orderBy("pos").collect()]
    if not row:
        return hashlib.sha256(repo.encode()).hexdigest()
    while len(row) > 1:
        row = [hashlib.sha256(b"".join(row[i : i + 2])).digest() for i in range(0, len(row), 2)]
    return row[0].hex()


def anchor(nodes: DataFrame, edges: DataFrame, repo: str, at_ms: int, previous: dict | None = None) -> dict:
    """A record of the state's root, chained to the one before by the hash of its JSON."""
    own = nodes.where(F.col("repo") == repo)
    leaving = edges.join(own.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    prev = hashlib.sha256(json.dumps(previous, separators=(",", ":")).encode()).hexdigest() if previous else None
    return {"repo": repo, "root": merkle_root(leaves(own, leaving), repo), "node_count": own.count(), "edge_count": leaving.count(), "anchored_at_ms": at_ms, "prev": prev}


def still_holds(record: dict, nodes: DataFrame, edges: DataFrame) -> bool:
    return anchor(nodes, edges, record["repo"], record["anchored_at_ms"])["root"] == record["root"]


def bind(record: dict, block: dict | None, external_root: str | None = None) -> dict:
    """The record bound to a block (chain_id, number, hash); refuses without one, and over-long external roots."""
    if not block or any(block.get(k) in (None, "") for k in ("chain_id", "number", "hash")):
        raise ValueError("no block to bind to")
    if external_root is not None and len(external_root) > 256:
        raise ValueError("external root is over 256 characters")
    return {**record, "chain": {k: block[k] for k in ("chain_id", "number", "hash")}, "external_root": external_root}


def sign_record(record: dict, seed: bytes) -> dict:
    """A record with an Ed25519 signature over the bytes of its compact JSON, which come along, and the signer's key."""
    payload = json.dumps(record, separators=(",", ":"), ensure_ascii=False).encode()
    return {"record": record, "payload": payload.hex(), "signature": ed25519.sign(seed, payload).hex(), "key": ed25519.public_key(seed).hex(), "alg": "ed25519"}


def record_signed(signed: dict, key: bytes | None = None) -> bool:
    """Whether the payload's signature holds, by this key if one is given, and the payload says what the record says."""
    payload = bytes.fromhex(signed["payload"])
    ours = key is None or key.hex() == signed["key"]
    return ours and json.loads(payload) == signed["record"] and ed25519.verify(bytes.fromhex(signed["key"]), payload, bytes.fromhex(signed["signature"]))
