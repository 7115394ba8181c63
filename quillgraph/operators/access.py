"""Grants, memberships, audit chains, rate limits and sealing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import ed25519
from quillgraph.functions.ids import field, little_endian, packed, unpacked

ZERO_HASH = "0" * 64


def check_grants(requests: DataFrame, grants: DataFrame, now: int) -> DataFrame:
    """requests (request_id, grant_id, resource, op) with `decision`.

    In this order: revoked, expired (now >= expiry), signature, the first matching scope's right.
    grants: (grant_id, revoked, expires_at_ms, signed, scopes array<struct<resource, can_read, can_write>>).
    """
    joined = requests.join(grants, "grant_id", "left")
    match = F.filter("scopes", lambda s: (s["resource"] == "*") | (s["resource"] == F.col("resource")))
    scope = F.try_element_at(match, F.lit(1))
    right = F.when(F.col("op") == "write", scope["can_write"]).otherwise(scope["can_read"])
    decision = (
        F.when(F.col("revoked").isNull(), "no grant")
        .when(F.col("revoked"), "revoked")
        .when(F.col("expires_at_ms").isNotNull() & (F.col("expires_at_ms") <= now), "expired")
        .when(~F.col("signed"), "bad signature")
        .when(scope.isNull(), "out of scope")
        .when(~right, "not permitted")
        .otherwise("allowed")
    )
    return joined.select("request_id", "resource", "op", decision.alias("decision"))


def readable_repos(scopes: DataFrame, repos: DataFrame) -> DataFrame:
    """(grant_id, repo): repos that a grant's first matching scope lets read.  scopes: (grant_id, pos, resource, can_read).

    A wildcard counts for a repo unless one of the grant's own scopes on it comes first.  The result names each pair,
    so it is as large as the grants with a wildcard times the repos; `readable_by` keeps the wildcard instead.
    """
    own = scopes.where("resource <> '*'").groupBy("grant_id", F.col("resource").alias("repo")).agg(F.min(F.struct("pos", "can_read")).alias("own"))
    stars = scopes.where("resource = '*'").groupBy("grant_id").agg(F.min(F.struct("pos", "can_read")).alias("star"))
    wide = repos.select("repo").distinct().withColumn("one", F.lit(1)).join(stars.withColumn("one", F.lit(1)), "one").join(own, ["grant_id", "repo"], "left")
    first = F.when(F.col("own.pos") < F.col("star.pos"), F.col("own.can_read")).otherwise(F.col("star.can_read"))
    exact = own.join(stars, "grant_id", "left_anti").join(repos.select("repo").distinct(), "repo", "left_semi")
    return wide.where(first).select("grant_id", "repo").unionByName(exact.where("own.can_read").select("grant_id", "repo"))


def readable_by(rows: DataFrame, scopes: DataFrame, grant_id: str) -> DataFrame:
    """rows (with repo) that a grant's first matching scope lets read: one grant's scopes joined, its wildcard a literal."""
    own = scopes.where(F.col("grant_id") == grant_id)
    star = own.where("resource = '*'").agg(F.min(F.struct("pos", "can_read")).alias("s")).first()["s"]
    named = own.where("resource <> '*'").groupBy(F.col("resource").alias("repo")).agg(F.min(F.struct("pos", "can_read")).alias("_own"))
    found = rows.join(named, "repo", "left")
    if star is None:
        return found.where("_own.can_read").drop("_own")
    return found.where(F.when(F.col("_own.pos") < star["pos"], F.col("_own.can_read")).otherwise(F.lit(star["can_read"]))).drop("_own")


def both_allow(decisions: DataFrame, session: DataFrame) -> DataFrame:
    """(request_id, allowed, reason): a request passes if its own grant and the session's allow it; the first refusal is the reason."""
    joined = decisions.select("request_id", F.col("decision").alias("own")).join(session.select("request_id", F.col("decision").alias("session")), "request_id", "left")
    other = F.coalesce("session", F.lit("no grant"))
    reason = F.when(other != "allowed", F.concat(F.lit("session: "), other)).when(F.col("own") != "allowed", F.concat(F.lit("request: "), F.col("own")))
    return joined.select("request_id", reason.isNull().alias("allowed"), reason.alias("reason"))


def grant_preimage(domain: str = "grant:v1") -> Column:
    """Bytes that a grant's signature covers: domain, id, issuer, recipient, each scope and its rights, policy, expiry,
    delegations, the issuer's key, and a mark if it is revoked.

    Columns: grant_id, issuer, recipient, scopes array<struct<resource, can_read, can_write>>, policy, expires_at_ms,
    delegations array<struct<delegator, at_ms>>, issuer_key, revoked.
    """
    text = lambda c: F.encode(c, "UTF-8")
    bit = lambda c: F.when(c, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    none = F.unhex(F.lit(""))
    joined = lambda items, one: F.aggregate(F.transform(items, one), none, lambda x, y: F.concat(x, y))
    return F.concat(
        field(0, text(F.lit(domain))),
        field(1, text(F.col("grant_id"))),
        field(2, text(F.col("issuer"))),
        field(3, text(F.col("recipient"))),
        joined(F.col("scopes"), lambda s: F.concat(field(4, text(s["resource"])), field(5, F.concat(bit(s["can_read"]), bit(s["can_write"]))))),
        field(6, text(F.col("policy"))),
        field(7, little_endian(F.col("expires_at_ms"), 8)),
        joined(F.col("delegations"), lambda d: F.concat(field(8, text(d["delegator"])), field(9, little_endian(d["at_ms"], 8)))),
        field(10, F.col("issuer_key")),
        F.when(F.col("revoked"), field(11, text(F.lit("revoked")))).otherwise(none),
    )


def signed_grants(grants: DataFrame) -> DataFrame:
    """grants (with issuer_key and signature) with `signed`: the issuer's key signed the preimage; unsigned ones are not."""
    made = grants.withColumn("_preimage", grant_preimage())
    return made.withColumn("signed", F.coalesce(ed25519.verified("issuer_key", "_preimage", "signature"), F.lit(False))).drop("_preimage")


def join_members(members: DataFrame, hits: DataFrame, org: str) -> DataFrame:
    """members (org, principal, role) with those of the allow-list hits (login_id, role) that have no membership of the org yet."""
    fresh = hits.select(F.lit(org).alias("org"), F.col("login_id").cast("string").alias("principal"), "role").dropDuplicates(["principal"])
    return members.select("org", "principal", "role").unionByName(fresh.join(members.select("org", "principal"), ["org", "principal"], "left_anti"))


def org_gate(requests: DataFrame, orgs: DataFrame, members: DataFrame) -> DataFrame:
    """requests (request_id, principal, org) with `decision`: unknown org, inactive org, no member, allowed, in this order.

    orgs: (org, status); members: (org, principal).
    """
    known = requests.join(orgs.select("org", "status"), "org", "left").join(members.select("org", "principal").distinct().withColumn("_in", F.lit(True)), ["org", "principal"], "left")
    decision = F.when(F.col("status").isNull(), "unknown org").when(F.col("status") != "Active", "inactive org").when(F.col("_in").isNull(), "no member").otherwise("allowed")
    return known.select("request_id", "principal", "org", decision.alias("decision"))


def role_scopes(memberships: DataFrame) -> DataFrame:
    """(principal, resource, can_read, can_write) from (principal, role, scopes array<string>)."""
    all_of_it = F.array(F.lit("*"))
    scope = F.when(F.col("role").isin("owner", "admin"), all_of_it).otherwise(F.col("scopes"))
    return memberships.select("principal", F.explode(scope).alias("resource"), F.lit(True).alias("can_read"), (F.col("role") != "read_only").alias("can_write"))


def attenuate(scopes: DataFrame, tokens: DataFrame) -> DataFrame:
    """role_scopes() cut by tokens (principal, tenants array<string> or null for all, scope string or null).

    Without a scope a token reads only; tenants narrow the resources.
    """
    joined = scopes.join(tokens, "principal")
    named = F.coalesce("tenants", F.array(F.col("resource")))
    wide = joined.select("principal", "resource", "can_read", "can_write", "scope", F.explode(named).alias("tenant"))
    both = wide.where((F.col("resource") == "*") | (F.col("tenant") == "*") | (F.col("resource") == F.col("tenant")))
    resource = F.when(F.col("resource") == "*", F.col("tenant")).otherwise(F.col("resource"))
    write = F.col("can_write") & F.coalesce(F.array_contains(F.split("scope", " "), "write"), F.lit(False))
    return both.groupBy("principal", resource.alias("resource")).agg(F.bool_or("can_read").alias("can_read"), F.bool_or(write).alias("can_write"))


def match_allowlist(logins: DataFrame, entries: DataFrame) -> DataFrame:
    """(login_id, name, role): the first entry whose verified e-mail or wallet matches, case folded.

    logins: (login_id, email, email_verified, wallet); entries: (pos, name, email, wallet, role).
    """
    fold = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    keys = logins.select("login_id", F.explode(F.array(F.struct(F.lit("e").alias("t"), F.when(F.col("email_verified"), fold("email")).alias("k")), F.struct(F.lit("w").alias("t"), fold("wallet").alias("k")))).alias("key")).where("key.k is not null")
    held = entries.select("pos", "name", "role", F.explode(F.array(F.struct(F.lit("e").alias("t"), fold("email").alias("k")), F.struct(F.lit("w").alias("t"), fold("wallet").alias("k")))).alias("key")).where("key.k is not null")
    return keys.join(held, "key").groupBy("login_id").agg(F.min(F.struct("pos", "name", "role")).alias("m")).select("login_id", "m.name", "m.role")


def audit_preimage(domain: str = "audit:v1") -> Column:
    """Bytes of an audit record: domain, sequence, time, previous hash, event, actor, resource, detail."""
    text = lambda c: F.encode(F.col(c), "UTF-8")
    return F.concat(
        field(0, F.encode(F.lit(domain), "UTF-8")),
        field(1, little_endian(F.col("sequence"), 8)),
        field(2, little_endian(F.col("timestamp_ms"), 8)),
        field(3, F.unhex("prev_hash")),
        field(4, text("event")),
        field(5, text("actor")),
        field(6, text("resource_id")),
        field(7, text("detail")),
    )


def verify_audit(records: DataFrame, hashed: Column | None = None) -> DataFrame:
    """One row (records, first_break, reason): whether each sequence from 0 on is there once and hashes chain.

    first_break is the first sequence that is there twice, has none before it, or does not carry the hash of the one
    before.  A record is compared with that one through a join on sequence - 1, not one global window.
    """
    own = records.withColumn("hash", F.sha2(audit_preimage(), 256) if hashed is None else hashed)
    before = own.groupBy((F.col("sequence") + 1).alias("sequence")).agg(F.min("hash").alias("expected"))
    each = own.groupBy("sequence").agg(F.count("*").alias("n"), F.min("prev_hash").alias("prev_hash"))
    total = own.agg(F.count("*").alias("n"))
    joined = each.join(before, "sequence", "left")
    gap = (F.col("n") > 1) | (F.col("sequence") < 0) | ((F.col("sequence") > 0) & F.col("expected").isNull())
    bad = gap | ~F.col("prev_hash").eqNullSafe(F.when(F.col("sequence") == 0, F.lit(ZERO_HASH)).otherwise(F.col("expected")))
    broken = joined.agg(F.min(F.when(bad, F.struct("sequence", F.when(gap, "sequence").otherwise("prev_hash").alias("reason")))).alias("b"))
    return total.withColumn("one", F.lit(1)).join(broken.withColumn("one", F.lit(1)), "one").select(F.col("n").alias("records"), F.col("b.sequence").alias("first_break"), F.col("b.reason").alias("reason"))


def append_audit(log: DataFrame, events: list[dict]) -> DataFrame:
    """log with a batch of a single writer's events (timestamp_ms, event, actor, resource_id, detail) chained to its last record.

    Only the last record comes to the driver, which hashes the batch in order.
    """
    spark = log.sparkSession
    last = log.withColumn("hash", F.sha2(audit_preimage(), 256)).agg(F.max(F.struct("sequence", "hash")).alias("m")).first()["m"]
    number, before = (last["sequence"] + 1, last["hash"]) if last else (0, ZERO_HASH)
    rows = []
    for e in events:
        rows.append((number, e["timestamp_ms"], before, e["event"], e["actor"], e["resource_id"], e["detail"]))
        number, before = number + 1, audit_hash(*rows[-1])
    fresh = spark.createDataFrame(rows, "sequence long, timestamp_ms long, prev_hash string, event string, actor string, resource_id string, detail string")
    return log.select(*fresh.columns).unionByName(fresh)


def audit_hash(sequence: int, timestamp_ms: int, prev_hash: str, event: str, actor: str, resource_id: str, detail: str, domain: str = "audit:v1") -> str:
    """The hash of one record: sha2 of what audit_preimage() gives."""
    parts = (domain.encode(), sequence.to_bytes(8, "little"), timestamp_ms.to_bytes(8, "little"), bytes.fromhex(prev_hash), *(x.encode() for x in (event, actor, resource_id, detail)))
    return hashlib.sha256(b"".join(bytes([k]) + len(x).to_bytes(8, "little") + x for k, x in enumerate(parts))).hexdigest()


def check_head(log: DataFrame, head: DataFrame) -> DataFrame:
    """(state): a log against the head (records, hash) that was kept beside it.

    sound; ahead (one record that the head does not know yet, as after a crash between the two writes); truncated;
    replaced (as long as the head says, with another last hash), or unknown without a head.
    """
    own = log.withColumn("hash", F.sha2(audit_preimage(), 256)).agg(F.count("*").alias("n"), F.max(F.struct("sequence", "hash")).alias("m"), F.max_by(F.col("prev_hash"), F.col("sequence")).alias("before"))
    both = own.withColumn("one", F.lit(1)).join(head.select("records", F.col("hash").alias("kept"), F.lit(1).alias("one")), "one", "left")
    state = (
        F.when(F.col("records").isNull(), "unknown")
        .when(F.col("n") < F.col("records"), "truncated")
        .when((F.col("n") == F.col("records")) & (F.coalesce("m.hash", F.lit(ZERO_HASH)) == F.col("kept")), "sound")
        .when((F.col("n") == F.col("records") + 1) & (F.col("before") == F.col("kept")), "ahead")
        .otherwise("replaced")
    )
    return both.select(state.alias("state"))


def filter_audit(log: DataFrame, actor: str | None = None, event: str | None = None, text: str | None = None) -> DataFrame:
    """Records of an actor and event, with text (without case) in actor, resource or detail."""
    log = log if actor is None else log.where(F.col("actor") == actor)
    log = log if event is None else log.where(F.col("event") == event)
    return log if not text else log.where(F.contains(F.lower(F.concat_ws("\n", "actor", "resource_id", "detail")), F.lit(text.lower())))


def fixed_window(calls: DataFrame, seconds: int, limit: int) -> DataFrame:
    """calls (principal, ts, call_id) with window start, place in it, allowed, and seconds to the window's end if refused."""
    epoch = F.unix_micros("ts")
    start = (F.floor(epoch / (seconds * 1_000_000)) * seconds).cast("long")
    own = Window.partitionBy("principal", "window_start").orderBy("ts", "call_id")
    placed = calls.withColumn("window_start", start).withColumn("place", F.row_number().over(own))
    allowed = F.col("place") <= limit
    left = F.ceil((F.col("window_start") + seconds) - epoch / 1_000_000).cast("long")
    return placed.select("principal", "call_id", "window_start", "place", allowed.alias("allowed"), F.when(~allowed, left).alias("retry_after"))


def refill(level: float, last: float, now: float, burst: float, rate: float) -> float:
    return min(burst, level + max(0.0, now - last) * rate)


def token_bucket(calls: DataFrame, burst: float, rate: float) -> DataFrame:
    """calls (principal, call_id, ts double seconds, cost) with the level before and whether they were let through.

    A clamped running value, so a fold per principal in order of time; groups stream through in sorted order
    and no group is held in memory.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, level, last = None, burst, 0.0
        for frame in frames:
            levels, allowed = [], []
            for p, ts, cost in zip(frame["principal"], frame["ts"], frame["cost"], strict=True):
                if p != who:
                    who, level, last = p, burst, ts
                level, last = refill(level, last, ts, burst, rate), ts
                levels.append(level)
                allowed.append(level >= cost)
                level -= cost if allowed[-1] else 0
            yield frame.assign(level=levels, allowed=allowed)[["principal", "call_id", "level", "allowed"]]

    kinds = dict(calls.dtypes)
    ordered = calls.select("principal", "call_id", F.col("ts").cast("double").alias("ts"), F.col("cost").cast("double").alias("cost")).repartition("principal").sortWithinPartitions("principal", "ts", "call_id")
    return ordered.mapInPandas(run, f"principal {kinds['principal']}, call_id {kinds['call_id']}, level double, allowed boolean")


def overlaps(intervals: DataFrame) -> DataFrame:
    """(principal, most): the largest number of intervals [start, stop) of a principal open at once."""
    steps = intervals.select("principal", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("stop").alias("at"), F.lit(-1).alias("d")))).alias("s"))
    sums = steps.groupBy("principal", F.col("s.at").alias("at")).agg(F.sum("s.d").alias("d"))
    open_now = F.sum("d").over(Window.partitionBy("principal").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return sums.withColumn("open_now", open_now).groupBy("principal").agg(F.max("open_now").alias("most"))


def _nonce(key: Column, aad: Column, content: Column) -> Column:
    """12 bytes that depend on key, place and content alone, so sealing is deterministic."""
    return F.unhex(F.substring(F.sha2(F.concat(key, F.lit(b"\0"), aad, F.lit(b"\0"), content), 256), 1, 24))


def _aad(slot: str | None) -> Column:
    """What binds a sealed value to its place: tenant and id, and the slot's name between them if there is one."""
    parts = [F.col("tenant"), *([F.lit(slot)] if slot else []), F.col("id")]
    return F.encode(F.concat_ws("\0", *parts), "UTF-8")


def seal(rows: DataFrame, keyring: DataFrame, slot: str | None = None) -> DataFrame:
    """(tenant, id, generation, sealed) of rows (tenant, id, content) under each tenant's live key (tenant, generation, key).

    slot: the table that the value lies in, such as edges or meta; one sealed for another place does not open.
    """
    live = rows.join(keyring.where("key is not null"), "tenant")
    cipher = F.aes_encrypt("content", "key", F.lit("GCM"), F.lit("DEFAULT"), _nonce(F.col("key"), _aad(slot), F.col("content")), _aad(slot))
    return live.select("tenant", "id", "generation", cipher.alias("sealed"))


def unseal(sealed: DataFrame, keyring: DataFrame, slot: str | None = None) -> DataFrame:
    """(tenant, id, content) of what the live keys open; other generations and shredded tenants are absent,
    a wrong tag under the live key is an error."""
    live = sealed.join(keyring.where("key is not null"), ["tenant", "generation"])
    return live.select("tenant", "id", F.aes_decrypt("sealed", "key", F.lit("GCM"), F.lit("DEFAULT"), _aad(slot)).alias("content"))


def seal_migration(rows: DataFrame, keyring: DataFrame, slot: str | None = None) -> tuple[DataFrame, DataFrame]:
    """rows (tenant, id, content, generation, sealed) with all plain ones sealed, and (sealed, kept, skipped) counts.

    Rows that are sealed already stay, so that a second run changes nothing; rows of tenants without a live key stay plain
    and are counted as skipped.
    """
    plain = rows.where("sealed is null").select("tenant", "id", "content")
    done = seal(plain, keyring, slot)
    waiting = plain.join(keyring.where("key is not null").select("tenant"), "tenant", "left_anti").select("tenant", "id", "content", F.lit(None).cast("int").alias("generation"), F.lit(None).cast("binary").alias("sealed"))
    kept = rows.where("sealed is not null").select("tenant", "id", "content", F.col("generation").cast("int").alias("generation"), "sealed")
    out = kept.unionByName(done.select("tenant", "id", F.lit(None).cast("binary").alias("content"), F.col("generation").cast("int").alias("generation"), "sealed")).unionByName(waiting)
    live = keyring.where("key is not null").select("tenant", F.lit(True).alias("live"))
    counts = rows.join(live, "tenant", "left").agg(F.count_if(F.col("sealed").isNull() & F.col("live")).alias("sealed"), F.count_if(F.col("sealed").isNotNull()).alias("kept"), F.count_if(F.col("sealed").isNull() & F.col("live").isNull()).alias("skipped"))
    return out, counts


def ensure_keys(keyring: DataFrame, tenants: DataFrame, fresh: Column) -> DataFrame:
    """keyring with a live key for each tenant: a new one of the next generation where it is absent or shredded."""
    joined = keyring.join(tenants.select("tenant").distinct().withColumn("wanted", F.lit(True)), "tenant", "full_outer")
    mint = F.col("wanted") & F.col("key").isNull()
    return joined.select("tenant", F.when(mint, F.coalesce("generation", F.lit(0)) + 1).otherwise(F.col("generation")).alias("generation"), F.when(mint, fresh).otherwise(F.col("key")).alias("key"))


def shred(keyring: DataFrame, tenant: str) -> DataFrame:
    """keyring without the tenant's key; its generation stays."""
    return keyring.withColumn("key", F.when(F.col("tenant") != tenant, F.col("key")))


def edge_owner(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with `tenant`: that of the source, else of the target, else null."""
    # All edges are shuffled for either end: as bytes their ids take half of that.
    columns = edges.columns
    edges = edges.withColumns({c: packed(F.col(c)) for c in ("from_id", "to_id")})
    for end in ("from", "to"):
        edges = edges.join(nodes.select(packed(F.col("id")).alias(f"{end}_id"), F.col("repo").alias(f"_{end}")), f"{end}_id", "left")
    ids = {c: unpacked(F.col(c)) for c in ("from_id", "to_id")}
    return edges.withColumns({**ids, "tenant": F.coalesce("_from", "_to")}).select(*[c for c in columns if c != "tenant"], "tenant")
