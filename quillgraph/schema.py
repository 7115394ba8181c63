"""Tables of the graph and the orders of their enumerations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 1

#: Strings of node kinds, tags of edge kinds, ranks of trust (higher rank, less trusted) and status.
NODE_KINDS = (
    "commit", "pr", "sprint:kickoff", "sprint:close", "adr", "audit", "finding", "handoff",
    "narrative:journal", "narrative:essay", "narrative:casestudy", "claim:confirmed", "claim:corrected", "claim:refined",
    "manifest_change", "pin_bump", "drift_event", "benchmark", "agent_action", "blocker", "tech_debt", "work_package",
    "rationale", "analogy_hypothesis", "doc", "tenant", "chain_network", "chain_contract", "chain_event", "chain_checkpoint", "branch",
)
EDGE_TAGS = {
    "TemporalNext": 1, "MergeParent": 2, "Supersedes": 3, "DependsOn": 4, "CausedBy": 5, "Motivates": 6, "Implements": 7, "Decides": 8,
    "Refutes": 9, "Contradicts": 10, "DerivedFrom": 11, "AnalogousTo": 12, "References": 13, "AnchoredTo": 14, "Emits": 15, "Touches": 16, "BranchContains": 17,
}
TRUST_RANKS = {"DerivedDeterministic": 0, "HumanConfirmed": 1, "AgentAsserted": 2, "InferredAdvisory": 3}
STATUS_RANKS = {"Active": 0, "Superseded": 1, "Archived": 2}

_ref = T.StructType(
    [T.StructField(n, T.LongType() if n.startswith("byte") else T.StringType()) for n in ("tag", "repo", "path", "git_sha", "sha", "byte_start", "byte_end", "key")]
)
_anchor = T.StructType(
    [T.StructField(n, T.IntegerType() if n.startswith("line") else T.StringType()) for n in ("repo", "path", "symbol", "line_start", "line_end")]
)
EMBEDDING = T.StructType([T.StructField("model", T.StringType()), T.StructField("data", T.ArrayType(T.FloatType()))])
NODES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("schema_version", T.ShortType()),
        T.StructField("plane", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("repo", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("source_ref", _ref),
        T.StructField("content", T.BinaryType()),
        T.StructField("valid_from", T.LongType()),
        T.StructField("valid_to", T.LongType()),
        T.StructField("observed_at", T.LongType()),
        T.StructField("trust_tier", T.StringType()),
        T.StructField("signature", T.BinaryType()),
        T.StructField("embedding", EMBEDDING),
        T.StructField("confidence", T.ArrayType(T.ByteType())),
        T.StructField("anchors", T.ArrayType(_anchor)),
        T.StructField("status", T.StringType()),
    ]
)
EDGES = T.StructType(
    [
        T.StructField("from_id", T.StringType()),
        T.StructField("to_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("plane", T.StringType()),
        T.StructField("trust_tier", T.StringType()),
        T.StructField(
            "provenance",
            T.StructType([T.StructField("method", T.StringType()), T.StructField("asserter", T.StringType()), T.StructField("at", T.LongType()), T.StructField("evidence", T.StringType())]),
        ),
        T.StructField("confidence", T.ArrayType(T.ByteType())),
        T.StructField("quarantined", T.BooleanType()),
        T.StructField("signature", T.BinaryType()),
    ]
)


def lookup(key: Column, values: dict, default=None) -> Column:
    """The value of a constant map; default for other keys."""
    found = F.lit(default)
    for k, v in values.items():
        found = F.when(key == k, F.lit(v)).otherwise(found)
    return found


def edge_tag(kind: Column) -> Column:
    return lookup(kind, EDGE_TAGS)


def trust_rank(tier: Column) -> Column:
    return lookup(tier, TRUST_RANKS)


def status_rank(status: Column) -> Column:
    return lookup(status, STATUS_RANKS)
