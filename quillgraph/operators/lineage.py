"""Reachability on commit histories by labels: every commit has a chain and a position on it.

A chain follows first parents: of the children that share a first parent, one goes on with its chain, the others begin chains of
their own.  Whoever reaches a position on a chain reaches all before it, so what some heads reach is one number a chain; edges
that leave a chain (a chain's first commit to its parent, merges to theirs) carry the numbers over.  Labels are stored and
extended by what is new; then reachability takes as many rounds as side lines are nested, over chains and not commits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.graph import _keep, drop_folder, shared_dir

LABELS = "id string, chain string, pos long"
SPINE = ("TemporalNext", "MergeParent")


def labels(spine: DataFrame, ids: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(id, chain, pos) of the commits in spine (from_id, to_id, kind) and in ids (id) that are not in known labels.

    Positions come from doubling jumps, so a line of n new commits takes log2(n) rounds; known labels never change.
    """
    spark, folder = spine.sparkSession, shared_dir(spine.sparkSession)
    known = spark.createDataFrame([], LABELS.replace("string", spine.schema["from_id"].dataType.simpleString())) if known is None else known
    spine = spine.where(F.col("kind").isin(*SPINE)).select("from_id", "to_id", "kind")
    every = spine.select(F.explode(F.array("from_id", "to_id")).alias("id"))
    every = (every if ids is None else every.unionByName(ids.select("id"))).distinct()
    first = _keep(spine.where("kind = 'TemporalNext'").groupBy(F.col("from_id").alias("id")).agg(F.min("to_id").alias("parent")), folder, "first")
    # A known chain goes on only from its last commit.
    taken = known.select("chain", (F.col("pos") - 1).alias("pos"))
    held = known.join(first.select(F.col("parent").alias("id")).distinct(), "id", "left_semi").join(taken, ["chain", "pos"], "left_anti").select("id", "chain", "pos")
    held = _keep(held, folder, "held")
    fresh = _keep(every.join(known.select("id"), "id", "left_anti"), folder, "fresh")
    heirs = first.join(fresh, "id", "left_semi").join(held.select(F.col("id").alias("parent"), F.lit(True).alias("goes_on")), "parent", "left").join(fresh.select(F.col("id").alias("parent"), F.lit(True).alias("is_new")), "parent", "left")
    heirs = heirs.where("goes_on or is_new").groupBy("parent").agg(F.min("id").alias("id"), F.max("is_new").alias("is_new"))
    up = fresh.join(heirs, "id", "left").select("id", F.when(F.col("is_new"), F.col("parent")).otherwise(F.col("id")).alias("up"), F.when(F.col("is_new"), 1).otherwise(0).cast("long").alias("steps"), F.coalesce("is_new", F.lit(False)).alias("open"), F.when(F.col("is_new").isNull(), F.col("parent")).alias("behind"))
    up, k = _keep(up, folder, "up-0"), 0
    most = up.count().bit_length() + 1
    while k < most and not up.where("open").isEmpty():
        k += 1
        over = up.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("open").alias("on"), F.col("behind").alias("far"))
        moved = up.where("open").join(over, "up").select("id", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("on").alias("open"), F.col("far").alias("behind"))
        up = _keep(up.where("not open").unionByName(moved), folder, f"up-{k}")
        drop_folder(spark, f"{folder}/up-{k - 1}")
    # What is open still leads into a cycle, which no history has: each such commit is a chain of its own.
    up = up.select("id", F.when(F.col("open"), F.col("id")).otherwise(F.col("up")).alias("up"), F.when(F.col("open"), 0).otherwise(F.col("steps")).cast("long").alias("steps"), "behind")
    out = up.join(held.select(F.col("id").alias("behind"), "chain", "pos"), "behind", "left")
    out = out.select("id", F.coalesce("chain", "up").alias("chain"), (F.coalesce(F.col("pos") + 1, F.lit(0)) + F.col("steps")).alias("pos"))
    out = _keep(out, folder, "labels")
    for name in ("first", "held", "fresh", f"up-{k}"):
        drop_folder(spark, f"{folder}/{name}")
    return out


def crossings(spine: DataFrame, labelled: DataFrame) -> DataFrame:
    """(chain, pos, to_chain, to_pos): the edges of spine that leave a chain, in labels."""
    edges = spine.where(F.col("kind").isin(*SPINE)).select("from_id", "to_id").distinct()
    ends = edges.join(labelled.withColumnRenamed("id", "from_id"), "from_id").join(labelled.select(F.col("id").alias("to_id"), F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos")), "to_id")
    return ends.where("chain <> to_chain").select("chain", "pos", "to_chain", "to_pos")


def reached(side: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, chain, top): the highest position on each chain that a start (start, chain, pos) reaches, over crossings."""
    folder = shared_dir(side.sparkSession)
    top = _keep(starts.groupBy("start", "chain").agg(F.max("pos").alias("top")), folder, "top-0")
    fresh, k = top, 0
    while True:
        k += 1
        # Only what has risen since the last round can carry anything over.
        over = side.join(fresh, "chain").where("pos <= top").groupBy("start", F.col("to_chain").alias("chain")).agg(F.max("to_pos").alias("new"))
        both = _keep(top.join(over, ["start", "chain"], "full").select("start", "chain", F.greatest("top", "new").alias("top"), (F.col("new") > F.coalesce("top", F.lit(-1))).alias("rose")), folder, f"top-{k}")
        drop_folder(side.sparkSession, f"{folder}/top-{k - 1}")
        fresh, top = both.where("rose").select("start", "chain", "top"), both.select("start", "chain", "top")
        if fresh.isEmpty():
            return top


def history(labelled: DataFrame, side: DataFrame, heads: DataFrame) -> DataFrame:
    """(start, id): each head (id) as a start, and all that it reaches, itself included."""
    tops = reached(side, heads.select("id", F.col("id").alias("start")).distinct().join(labelled, "id").select("start", "chain", "pos"))
    return labelled.join(tops, "chain").where("pos <= top").select("start", "id")


def canonical(labelled: DataFrame, side: DataFrame, heads: DataFrame) -> DataFrame:
    """(id): all that some head (id) reaches, heads included."""
    own = heads.select("id").distinct().join(labelled, "id").select(F.lit("").alias("start"), "chain", "pos")
    return labelled.join(reached(side, own), "chain").where("pos <= top").select("id")


def are_ancestors(labelled: DataFrame, side: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (ancestor, head) with `holds`: whether the one is the other or reachable from it; an unknown commit is nobody's."""
    tops = reached(side, pairs.select(F.col("head").alias("id")).distinct().join(labelled, "id").select(F.col("id").alias("start"), "chain", "pos"))
    at = pairs.join(labelled.withColumnRenamed("id", "ancestor"), "ancestor", "left").join(tops.withColumnRenamed("start", "head"), ["head", "chain"], "left")
    return at.select("ancestor", "head", F.coalesce(F.col("pos") <= F.col("top"), F.lit(False)).alias("holds"))
