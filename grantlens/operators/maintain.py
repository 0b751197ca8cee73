"""G-1 between two scans: the closure follows the changed memberships instead of being built again.

``edge_changes`` compares two scans by key. ``update_closure`` then deletes and
derives again: a pair loses its level only if a deleted membership lies on one
of its shortest ways; such pairs, and those that inserted memberships make
possible, get their levels from the pairs that stay, round by round. Work
follows the pairs around the changes, not the directory: unchanged pairs are
only read by joins on the changed SIDs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.session import ensure_checkpoint_dir

PAIR = ["GroupSid", "MemberSid"]


def edge_changes(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inserted, deleted) memberships between two scans; null SIDs are no memberships, repeated rows are one."""
    old, new = (x.select(*PAIR).dropna().distinct() for x in (before, after))
    return new.join(old, PAIR, "left_anti"), old.join(new, PAIR, "left_anti")


def _lost(closure: DataFrame, deleted: DataFrame) -> DataFrame:
    """The pairs that have a shortest way over a deleted membership."""
    cut = deleted.select(F.col("GroupSid").alias("_a"), F.col("MemberSid").alias("_b"))
    above = closure.join(cut.select("_a").distinct(), F.col("MemberSid") == F.col("_a")) \
        .select("_a", F.col("GroupSid").alias("_x"), F.col("MinNestingLevel").alias("_up"))
    below = closure.join(cut.select("_b").distinct(), F.col("GroupSid") == F.col("_b")) \
        .select("_b", F.col("MemberSid").alias("_y"), F.col("MinNestingLevel").alias("_down"))
    above = above.unionByName(cut.select("_a", F.col("_a").alias("_x"), F.lit(0).alias("_up")).distinct())
    below = below.unionByName(cut.select("_b", F.col("_b").alias("_y"), F.lit(0).alias("_down")).distinct())
    ways = cut.join(above, "_a").join(below, "_b").groupBy(F.col("_x").alias("GroupSid"), F.col("_y").alias("MemberSid")) \
        .agg(F.min(F.col("_up") + F.col("_down") + 1).alias("_way"))
    return ways.join(closure, PAIR).filter("_way = MinNestingLevel").select(*PAIR)


def update_closure(closure: DataFrame, edges: DataFrame, inserted: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(closure, changed) after the changes: ``closure`` (GroupSid, MemberSid, MinNestingLevel) is that of the scan before,
    ``edges`` the memberships of the scan after, ``inserted`` and ``deleted`` as :func:`edge_changes` gives them.

    ``changed`` has a row for each pair that was looked at again, with its new level, null where the pair is gone. Cycles
    may come and go; empty changes give the closure as it was.
    """
    ensure_checkpoint_dir(closure.sparkSession)
    hops = edges.select(F.col("GroupSid").alias("_x"), F.col("MemberSid").alias("_at")).dropna().distinct()
    inserted = inserted.checkpoint(eager=True)
    lost = _lost(closure, deleted).checkpoint(eager=True)
    kept = closure.join(lost, PAIR, "left_anti").select(*PAIR, "MinNestingLevel")

    def over(first: DataFrame, rest: DataFrame) -> DataFrame:
        """Pairs one membership longer: ``first`` (_x, _at), then a pair of ``rest`` from _at."""
        far = rest.select(F.col("GroupSid").alias("_at"), "MemberSid", (F.col("MinNestingLevel") + 1).alias("MinNestingLevel"))
        return first.join(far, "_at").select(F.col("_x").alias("GroupSid"), "MemberSid", "MinNestingLevel")

    one = F.lit(1).alias("MinNestingLevel")
    fresh = inserted.select(F.col("GroupSid").alias("_x"), F.col("MemberSid").alias("_at"))
    # Lost pairs by a membership that stays, then what stays beyond it; only the lost pairs' own groups are asked.
    again = hops.join(lost.select(F.col("GroupSid").alias("_x")).distinct(), "_x", "left_semi")
    direct = again.select(F.col("_x").alias("GroupSid"), F.col("_at").alias("MemberSid"), one)
    found = direct.unionByName(over(again, kept)).join(lost, PAIR, "left_semi")
    step = inserted.select(*PAIR, one).unionByName(over(fresh, kept)).unionByName(found)
    changed = lost.select(*PAIR, F.lit(None).cast("int").alias("MinNestingLevel")).checkpoint(eager=True)
    while True:
        best = step.groupBy(*PAIR).agg(F.min("MinNestingLevel").cast("int").alias("MinNestingLevel"))
        known = changed.withColumnRenamed("MinNestingLevel", "_now").withColumn("_seen", F.lit(True))
        old = kept.withColumnRenamed("MinNestingLevel", "_old")
        level = F.coalesce(F.when(F.col("_seen"), F.col("_now")), F.col("_old"))
        better = best.join(known, PAIR, "left").join(old, PAIR, "left").filter(level.isNull() | (F.col("MinNestingLevel") < level)) \
            .select(*PAIR, "MinNestingLevel").checkpoint(eager=True)
        if better.isEmpty():
            break
        changed = changed.join(better, PAIR, "left_anti").unionByName(better).checkpoint(eager=True)
        step = over(hops, better)
    rest = kept.join(changed, PAIR, "left_anti")
    return rest.unionByName(changed.filter("MinNestingLevel is not null")), changed
