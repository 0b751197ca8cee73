"""G-1: transitive group membership with the smallest nesting depth.

Only groups can be expanded, so the breadth-first walk runs over the
group-in-group edges alone: round d joins the pairs first found at depth d-1
with those edges and keeps the pairs never seen before (``left_anti``). Cycles
therefore terminate, and the first depth at which a pair appears is its
minimum. Members that are no groups (the bulk of a directory) are attached
once at the end, at one level more than the group that lists them.

Each round's new pairs are written with a reliable ``checkpoint()`` to
``spark.checkpoint.dir`` so lineage stays one round deep and a lost executor
re-reads files instead of replaying rounds. The walk ends when a round finds
nothing new, and at no other point.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.operators.skew import DEFAULT_MIN_ROWS, DEFAULT_MIN_SHARE, hot_plan, skew_join
from grantlens.session import ensure_checkpoint_dir

CHAIN = " < "  # between the names of a membership chain


def membership_closure(edges: DataFrame, group_col: str = "GroupSid", member_col: str = "MemberSid",
                       min_share: float = DEFAULT_MIN_SHARE, min_rows: int = DEFAULT_MIN_ROWS) -> DataFrame:
    """(GroupSid, MemberSid, MinNestingLevel) for every reachable pair; direct = 1.

    One ``isEmpty`` action per round decides termination; no data is
    collected. Groups that are hot on either side of the last join (huge
    direct membership, or many groups above them) are salted (see skew.py).
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    e0 = edges.select(F.col(group_col).alias("MidSid"), F.col(member_col).alias("MemberSid")) \
              .where(F.col("MidSid").isNotNull() & F.col("MemberSid").isNotNull()).distinct() \
              .checkpoint(eager=True)
    groups = e0.select(F.col("MidSid").alias("MemberSid")).distinct()
    nested = e0.join(groups, "MemberSid", "left_semi").select("MidSid", "MemberSid").checkpoint(eager=True)
    leaves = e0.join(groups, "MemberSid", "left_anti").select("MidSid", "MemberSid").checkpoint(eager=True)

    frontier = nested.select(F.col("MidSid").alias("GroupSid"), "MemberSid")
    levels = [frontier.withColumn("MinNestingLevel", F.lit(1))]
    seen = frontier
    depth = 1
    while True:
        step = frontier.select("GroupSid", F.col("MemberSid").alias("MidSid")).join(nested, "MidSid")
        new = step.select("GroupSid", "MemberSid").distinct().join(seen, ["GroupSid", "MemberSid"], "left_anti")
        new = new.checkpoint(eager=True)
        if new.isEmpty():
            break
        depth += 1
        levels.append(new.withColumn("MinNestingLevel", F.lit(depth)))
        seen = seen.unionByName(new)
        frontier = new
    closed = reduce(DataFrame.unionByName, levels)
    above = closed.select("GroupSid", F.col("MemberSid").alias("MidSid"), F.col("MinNestingLevel").alias("_d"))
    hot = hot_plan(leaves, above, "MidSid", min_share=min_share, min_rows=min_rows)
    far = skew_join(leaves, above, "MidSid", hot).select(
        "GroupSid", "MemberSid", (F.col("_d") + 1).alias("MinNestingLevel"))
    direct = leaves.select(F.col("MidSid").alias("GroupSid"), "MemberSid", F.lit(1).alias("MinNestingLevel"))
    members = direct.unionByName(far).groupBy("GroupSid", "MemberSid") \
        .agg(F.min("MinNestingLevel").alias("MinNestingLevel"))
    return closed.unionByName(members).checkpoint(eager=True)


def walk_up(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The groups that hold the seeds, with the chain that leads to each.

    ``edges`` is (GroupSid, MemberSid, GroupName), ``seeds`` (Sid, Path) with
    the seed's own name as its path. Result: (HolderSid, Sid, Depth, Path),
    the seed itself at depth 0, then every group reached; Path is
    ``seed < group < ... < holder`` along a shortest chain. Of chains of one
    length the one whose last member before the holder has the smaller SID
    counts, then the one before that, and so on.

    Breadth first from the seeds only: a round carries for each (seed, holder)
    its predecessor and the predecessor's path, so a chain is put together
    while the walk goes and nobody collects it. Holders found before never
    come again, so cycles end.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    hops = edges.where(F.col("GroupSid").isNotNull() & F.col("MemberSid").isNotNull()) \
        .select(F.col("MemberSid").alias("_at"), F.col("GroupSid").alias("HolderSid"), "GroupName")
    found = seeds.groupBy("Sid").agg(F.min("Path").alias("Path")) \
        .select(F.col("Sid").alias("HolderSid"), "Sid", F.lit(0).alias("Depth"), "Path").checkpoint(eager=True)
    frontier, rounds = found, [found]
    while True:
        at = frontier.select("Sid", F.col("HolderSid").alias("_at"), F.col("Path").alias("_path"))
        step = at.join(hops, "_at").groupBy("Sid", "HolderSid") \
            .agg(F.min(F.struct("_at", "_path")).alias("_via"), F.min("GroupName").alias("_name"))
        new = step.join(found.select("Sid", "HolderSid"), ["Sid", "HolderSid"], "left_anti").select(
            "HolderSid", "Sid", F.lit(len(rounds)).alias("Depth"),
            F.concat("_via._path", F.lit(CHAIN), "_name").alias("Path")).checkpoint(eager=True)
        if new.isEmpty():
            return found
        rounds.append(new)
        found, frontier = found.unionByName(new), new


def walk_down(edges: DataFrame, nested: DataFrame, seeds: DataFrame) -> DataFrame:
    """(HolderSid, MemberSid): every seed (column HolderSid) with itself and all its members, direct or nested.

    ``nested`` are the edges whose member is a group: the rounds run over
    them alone, all other members are attached once at the end.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    found = seeds.select("HolderSid", F.col("HolderSid").alias("MemberSid")).distinct().checkpoint(eager=True)
    frontier, own = found, found
    while True:
        step = frontier.select("HolderSid", F.col("MemberSid").alias("GroupSid")) \
            .join(nested.select("GroupSid", "MemberSid"), "GroupSid").select("HolderSid", "MemberSid").distinct()
        new = step.join(found, ["HolderSid", "MemberSid"], "left_anti").checkpoint(eager=True)
        if new.isEmpty():
            break
        found, frontier = found.unionByName(new), new
    groups = found.select("HolderSid", F.col("MemberSid").alias("GroupSid"))
    members = groups.join(edges.select("GroupSid", "MemberSid"), "GroupSid").select("HolderSid", "MemberSid")
    return own.unionByName(members).distinct()


def group_edges(edges: DataFrame) -> DataFrame:
    """The edges whose member is itself a group."""
    groups = edges.select(F.col("GroupSid").alias("MemberSid")).distinct()
    return edges.join(groups, "MemberSid", "left_semi").select("GroupSid", "MemberSid")
