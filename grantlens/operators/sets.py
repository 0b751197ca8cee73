"""G-5 / F-5 as sets of principals: who has a right on a resource, as bitmaps instead of a row for each.

Every principal name gets a dense number, cut into a bucket and a place in
the bucket's bitmap (4,096 bytes, Spark's bitmap functions). The members of a
large trustee are bitmaps, built once; those of a small one stay places, as a
bitmap of 4,096 bytes for a few members would cost more than the rows. An
entry then sends its trustee's sets to its resource, where they are OR-ed:
``Either`` of those with the right allowed or denied, ``Denied`` of those with
it denied. Denied lies inside Either, so the right is held by Either without
Denied.

A directory of P principals costs up to P / 8 bytes per entry and right, more
than the few principals most trustees have. So the counts alone come from the
expansion in place (expand.py): a task counts its own principals per resource
and right, and only these counts are shuffled, never a bitmap nor a pair.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.functions.rights import RIGHTS_LETTERS, has_bit
from grantlens.operators.access import RESOURCE_KEYS, aggregate_acl
from grantlens.operators.expand import counted
from grantlens.operators.numbering import numbered
from grantlens.operators.skew import hot_plan, share_for, skew_join

BITS = 32768  # places of one bitmap (4,096 bytes, fixed by the bitmap functions)
SMALL = 64  # a trustee with as many members in a bucket stays places
SET_KEYS = [*RESOURCE_KEYS, "Right", "Bucket"]


class PrincipalSets:
    """The principals behind each trustee SID: ``numbers``, ``small`` (places) and ``large`` (bitmaps).

    names  (TrusteeSid, TrusteeNTStyleName), see access.trustee_names; null SIDs and names are nobody's
    """

    def __init__(self, names: DataFrame, materialize):
        self.names = names.select("TrusteeSid", "TrusteeNTStyleName").dropna().distinct()
        self.materialize = materialize

    @cached_property
    def numbers(self) -> DataFrame:
        return self.materialize(numbered(self.names.select("TrusteeNTStyleName").distinct(), ["TrusteeNTStyleName"], "Number",
                                         self.materialize, "principals"), "numbers")

    @cached_property
    def _split(self) -> tuple[DataFrame, DataFrame]:
        placed = self.names.join(self.numbers, "TrusteeNTStyleName").select(
            "TrusteeSid", F.floor(F.col("Number") / BITS).alias("Bucket"), (F.col("Number") % BITS).alias("Place"))
        key = ["TrusteeSid", "Bucket"]
        sets = self.materialize(placed.groupBy(*key).agg(F.bitmap_construct_agg("Place").alias("Members")), "sets")
        size = F.bitmap_count("Members")
        small = placed.join(sets.filter(size <= SMALL).select(*key), key, "left_semi")
        return self.materialize(small, "places"), sets.filter(size > SMALL)

    @property
    def small(self) -> DataFrame:
        return self._split[0]

    @property
    def large(self) -> DataFrame:
        return self._split[1]

    def holders(self, acl: DataFrame) -> DataFrame:
        """(HostID, GateID, ResourceID, Right, Bucket, Either, Denied): the sets of every resource and right."""
        rights = F.array(*[F.when(has_bit(F.col(mask), bit), F.struct(F.lit(letter).alias("Right"), F.lit(deny).alias("_deny")))
                           for letter, bit in RIGHTS_LETTERS for mask, deny in (("AllowRights", False), ("DenyRights", True))])
        per_trustee = aggregate_acl(acl.dropna(subset=["TrusteeSid"]), [*RESOURCE_KEYS, "TrusteeSid"])
        entries = per_trustee.select(*RESOURCE_KEYS, "TrusteeSid", F.inline(F.array_compact(rights)))
        share = share_for(int(acl.sparkSession.conf.get("spark.sql.shuffle.partitions")))

        def sent(sets: DataFrame, both: str) -> DataFrame:
            plan = hot_plan(sets, acl.select("TrusteeSid"), "TrusteeSid", min_share=share)
            return skew_join(sets, entries, "TrusteeSid", plan).groupBy(*SET_KEYS) \
                .agg(F.expr(both).alias("Either"), F.expr(f"{both} FILTER (WHERE _deny)").alias("Denied"))

        few, many = sent(self.small, "bitmap_construct_agg(Place)"), sent(self.large, "bitmap_or_agg(Members)")
        return few.unionByName(many).groupBy(*SET_KEYS) \
            .agg(F.bitmap_or_agg("Either").alias("Either"), F.bitmap_or_agg("Denied").alias("Denied"))

    def counts(self, acl: DataFrame) -> DataFrame:
        """(HostID, GateID, ResourceID, Right, Principals): how many principals hold the right; none gives no row."""
        share = share_for(int(acl.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        plan = hot_plan(self.names, acl.select("TrusteeSid"), "TrusteeSid", min_share=share)
        return counted(acl.dropna(subset=["TrusteeSid"]), self.names, RESOURCE_KEYS, plan, dict(RIGHTS_LETTERS))

    def unfolded(self, sets: DataFrame) -> DataFrame:
        """(HostID, GateID, ResourceID, Right, TrusteeNTStyleName): the sets of :meth:`holders` as rows."""
        # Only bytes in which the sets differ hold a principal; of those, each bit.
        differ = F.expr("filter(sequence(1, length(Either)), i -> substring(Either, i, 1) <> substring(Denied, i, 1))")

        def byte(c: str):
            return F.conv(F.hex(F.substring(F.col(c), F.col("_i"), F.lit(1))), 16, 10).cast("int")

        bits = sets.withColumn("_i", F.explode(differ)).withColumn("_b", byte("Either").bitwiseXOR(byte("Denied"))) \
            .withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(7)))).filter("(shiftright(_b, _bit) & 1) = 1")
        number = F.col("Bucket") * BITS + (F.col("_i") - 1) * 8 + F.col("_bit")
        return bits.select(*RESOURCE_KEYS, "Right", number.alias("Number")).join(self.numbers, "Number") \
            .select(*RESOURCE_KEYS, "Right", "TrusteeNTStyleName")
