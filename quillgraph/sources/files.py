"""Manifests, catalogs, bundles, vector files, walkers and snapshots."""

from __future__ import annotations

import hashlib
import hmac
import json
import re
import tomllib
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The groups of a chain catalog.
GROUPS = ("contracts", "aaStack", "genesis", "precompiles")


def read_manifest(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """Repos (name, fields) and dependencies (consumer, dep_repo) of a federation manifest."""
    data = tomllib.loads(text)
    repos = [(k, {a: str(b) for a, b in v.items()}) for k, v in data.get("repos", {}).items()]
    drift = [(x.get("consumer"), x.get("dep_repo")) for x in data.get("drift", [])]
    return spark.createDataFrame(repos, "name string, fields map<string,string>"), spark.createDataFrame(drift, "consumer string, dep_repo string")


def live_repos(repos: DataFrame) -> DataFrame:
    return repos.where(F.coalesce(F.try_element_at("fields", F.lit("archived")), F.lit("false")) != "True").select("name")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(chain_id, grp, name, address) of catalog files, addresses in lower case; one that is no string is an error."""
    schema = "chainId long, " + ", ".join(f"{g} map<string,string>" for g in GROUPS)
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", schema).alias("c"), "value")
    each = parsed.select("c.chainId", F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), F.col(f"c.{g}").alias("m")) for g in GROUPS])).alias("g"))
    rows = each.select(F.col("chainId").alias("chain_id"), "g.grp", F.explode("g.m").alias("name", "address"))
    good = F.when(F.col("address").rlike("^0x[0-9A-Fa-f]+$"), F.lower("address")).otherwise(F.raise_error(F.concat(F.lit("no address: "), "name")))
    return rows.select("chain_id", "grp", "name", good.alias("address")).orderBy("grp", "name")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(number, hash, parent_hash, at_ms, transactions) of block transcripts."""
    tx = "array<struct<hash:string,`from`:string,`to`:string,value:string>>"
    schema = f"results array<struct<number:string,hash:string,parentHash:string,timestamp:string,transactions:{tx}>>"
    block = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("results").alias("b"))
    number = lambda c: F.when(F.col(c).startswith("0x"), F.conv(F.substring(F.col(c), 3, 32), 16, 10)).otherwise(F.col(c)).cast("long")
    return block.select(number("b.number").alias("number"), F.col("b.hash").alias("hash"), F.col("b.parentHash").alias("parent_hash"), (number("b.timestamp") * 1000).alias("at_ms"), F.col("b.transactions").alias("transactions"))


def read_spec(text: str, known: tuple[str, ...] = ("name", "tenant", "path", "license", "optional", "include", "exclude")) -> list[dict]:
    """Sources of a corpus spec; unknown or missing keys and unsafe paths are refused."""
    data = tomllib.loads(text)
    extra = set(data) - {"version", "chunk_chars", "source"}
    if extra:
        raise ValueError(f"unknown keys: {sorted(extra)}")
    for s in data.get("source", []):
        if set(s) - set(known) or not {"name", "tenant", "path"} <= set(s):
            raise ValueError(f"keys of source {s.get('name')}: {sorted(s)}")
        if s["path"].startswith("/") or ".." in s["path"].split("/") or "\\" in s["path"]:
            raise ValueError(f"path of source {s['name']}")
    return data.get("source", [])


def read_lock(text: str, ship: tuple[str, ...] = ("approved",), hold: tuple[str, ...] = ("rejected", "pending")) -> dict[str, bool]:
    """Whether each locked item ships; an unknown verdict is an error."""
    out = {}
    for name, item in tomllib.loads(text).items():
        if item["verdict"] not in ship + hold:
            raise ValueError(f"verdict of {name}: {item['verdict']}")
        out[name] = item["verdict"] in ship
    return out


def walk(spark: SparkSession, root: str, depth: int = 12, most: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Files (path, size) in sorted order, and what was passed over (path, reason)."""
    good, skipped = [], []

    def visit(folder: Path, level: int) -> None:
        for p in sorted(folder.iterdir()):
            rel = str(p.relative_to(root))
            if p.is_symlink():
                skipped.append((rel, "link"))
            elif p.is_dir():
                if p.name.startswith("."):
                    skipped.append((rel, "hidden"))
                elif level >= depth:
                    skipped.append((rel, "depth"))
                else:
                    visit(p, level + 1)
            elif p.stat().st_size > most:
                skipped.append((rel, "size"))
            else:
                good.append((rel, p.stat().st_size))

    visit(Path(root), 1)
    return spark.createDataFrame(good, "path string, size long"), spark.createDataFrame(skipped, "path string, reason string")


def write_bundle(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A tenant's nodes and edges as JSON lines in an empty place; content as text."""
    nodes.withColumn("content", F.decode("content", "UTF-8")).write.mode("errorifexists").json(f"{path}/nodes")
    edges.write.mode("errorifexists").json(f"{path}/edges")


def read_bundle(spark: SparkSession, path: str, nodes_schema: str, edges_schema: str) -> tuple[DataFrame, DataFrame]:
    nodes = spark.read.schema(nodes_schema).json(f"{path}/nodes").withColumn("content", F.encode("content", "UTF-8"))
    edges = spark.read.schema(edges_schema).json(f"{path}/edges")
    for end in ("from_id", "to_id"):
        bad = F.raise_error(F.concat(F.lit(f"{end} is no id: "), F.coalesce(end, F.lit("null"))))
        edges = edges.withColumn(end, F.when(F.col(end).rlike("^[0-9a-f]{64}$"), F.col(end)).otherwise(bad))
    return nodes, edges


def manifest_digest(manifest: dict) -> str:
    """sha256 over the manifest's sorted JSON with its digest blank."""
    return hashlib.sha256(json.dumps({**manifest, "digest": ""}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def encode_vectors(vectors: DataFrame) -> DataFrame:
    """(id, f16 binary) of (id, data): little-endian half floats; values that they cannot hold are an error."""

    def run(batches):
        for b in batches:
            rows = [np.array(x, np.float32) for x in b["data"].to_pylist()]
            if any(not np.isfinite(x).all() or (np.abs(x) > 65504).any() for x in rows):
                raise ValueError("a vector is out of the range of half floats")
            yield pa.record_batch([b["id"], pa.array([x.astype("<f2").tobytes() for x in rows], pa.binary())], ["id", "f16"])

    return vectors.select("id", "data").mapInArrow(run, f"id {dict(vectors.dtypes)['id']}, f16 binary")


def decode_vectors(packed: DataFrame) -> DataFrame:
    """(id, data) of unit length; the zero vector stays."""

    def run(batches):
        for b in batches:
            rows = []
            for x in b["f16"].to_pylist():
                v = np.frombuffer(x, "<f2").astype(np.float32)
                if not np.isfinite(v).all():
                    raise ValueError("a stored vector is not finite")
                size = np.linalg.norm(v)
                rows.append((v / size if size else v).tolist())
            yield pa.record_batch([b["id"], pa.array(rows, pa.list_(pa.float32()))], ["id", "data"])

    return packed.mapInArrow(run, f"id {dict(packed.dtypes)['id']}, data array<float>")


def webhook_ok(secret: bytes, body: bytes, signature: str) -> bool:
    want = "sha256=" + hmac.new(secret, body, hashlib.sha256).hexdigest()
    return hmac.compare_digest(want, signature or "")


def parse_push(body: bytes, owners: set[str]) -> dict | None:
    """repo, ref and head of a push event of an allowed owner; None for others."""
    data = json.loads(body)
    repo = data.get("repository") or {}
    name, owner = repo.get("name", ""), (repo.get("owner") or {}).get("login", "")
    if owner not in owners or not re.fullmatch(r"[A-Za-z0-9._-]{1,100}", name) or name in (".", ".."):
        return None
    return {"repo": name, "ref": data.get("ref"), "head": data.get("after")}


class Snapshots:
    """Versioned Parquet tables.  A version counts once its marker is there; the highest marked one is current."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _marked(self, name: str) -> list[int]:
        p, fs = self._at(name)
        if not fs.exists(p):
            return []
        return sorted(int(x.getPath().getName()[10:]) for x in fs.listStatus(p) if x.getPath().getName().startswith("committed-"))

    def version(self, name: str) -> int:
        """The current version; 0 if there is none."""
        return max(self._marked(name), default=0)

    def _folder(self, name: str, version: int) -> str:
        """Where a version's rows are: its marker says so."""
        p, fs = self._at(f"{name}/committed-{version:08d}")
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/{self._folder(name, version or self.version(name))}")

    def commit(self, name: str, df: DataFrame, partition: list[str] | None = None) -> int:
        """Write the next version whole to a folder of a fresh name, then its marker, which names the folder and must be new.

        Readers see the one version or the other.  Of two writers at once the second one fails and touches nothing of the first.
        """
        folder = f"rows-{uuid.uuid4().hex}"
        (df.write.partitionBy(*partition) if partition else df.write).parquet(f"{self.path}/{name}/{folder}")
        nxt = self.version(name) + 1
        p, fs = self._at(f"{name}/committed-{nxt:08d}")
        try:
            out = fs.create(p, False)
        except Exception as e:
            raise OSError(f"version {nxt} of {name} was committed by another writer") from e
        out.write(bytearray(folder.encode()))
        out.close()
        return nxt

    def commit_all(self, tables: dict[str, DataFrame]) -> int:
        """The next version of several tables at once: they count together, once the manifest that names their versions does."""
        now = self.versions()
        now.update({name: self.commit(name, df) for name, df in tables.items()})
        return self.commit("manifest", self.spark.createDataFrame(sorted(now.items()), "name string, version int"))

    def versions(self) -> dict[str, int]:
        """What the last manifest names."""
        return {r["name"]: r["version"] for r in self.read("manifest").collect()} if self.version("manifest") else {}

    def current(self, name: str, schema: str) -> DataFrame:
        """A table as the last manifest names it; empty if it does not."""
        version = self.versions().get(name)
        return self.read(name, version) if version else self.spark.createDataFrame([], schema)

    def prune(self, name: str, keep: int) -> list[int]:
        """Delete all but the newest versions, markers first; returns those that went."""
        gone = self._marked(name)[:-keep] if keep else self._marked(name)
        _, fs = self._at(name)
        for v in gone:
            for path in (self._folder(name, v), f"committed-{v:08d}")[::-1]:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/{path}"), True)
        return gone
