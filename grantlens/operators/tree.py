"""Interval labels of the path tree: containment as a comparison of numbers.

All paths are sorted once, with the separator below every other character, so
that the paths under a share follow it without a gap. A path's ``Pre`` is its
place in that order; a share holds the places ``Lo`` to ``Hi`` - 1 (the share
itself and what lies below its separator), of which those from ``Below`` on
are not the share itself, or ``Lo`` to ``HiPlain`` - 1 (every path that starts
with the share's text). Paths are not cut.

The order is a range-partitioned sort (numbering.py), so a share with a third
of all folders is spread over many tasks. Containment then cuts the *places* into chunks
of ``CHUNK``: a share has one row per chunk it reaches, a path is in one
chunk, and both meet on the chunk's number. A chunk holds ``CHUNK`` paths at
most whatever the share's size, so no key of the join is hot, and a path
leaves the join once per share that holds it.

Null keys and null paths have no place and lie in no share. Equal paths have
different places inside the same shares; a share path given twice is one share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.operators.numbering import numbered

CHUNK = 1024
# What is added to a share's key to get the borders of its intervals; no UTF-8 text holds the byte FF.
BORDERS = {"Lo": b"", "Below": b"\0\0", "Hi": b"\0\0\xff", "HiPlain": b"\xff"}
# What a share can hold: the first and the last border of it.
HOLDS = {"strict": ("Lo", "Hi"), "below": ("Below", "Hi"), "prefix": ("Lo", "HiPlain")}


def sort_key(path: Column) -> Column:
    """UTF-8 bytes with the separator as 00 00 and the zero character as 00 01: keeps "starts with" in both directions."""
    no_zero = F.replace(path, F.lit("\0"), F.lit("\0\1"))
    return F.encode(F.replace(no_zero, F.lit("\\"), F.lit("\0\0")), "UTF-8")


class PathTree:
    """Places of ``nodes`` and intervals of ``shares``, both written by ``materialize``.

    nodes   the tree's rows: ``keys``, ``id_col``, ``path_col``
    shares  rows of ``keys`` and ``path_col``; they need not be nodes themselves
    keys    what paths must have in common (a server), in front of the order
    """

    def __init__(self, nodes: DataFrame, shares: DataFrame, materialize, keys=("HostID", "GateID"),
                 id_col: str = "ResourceID", path_col: str = "NetworkPath"):
        self.keys, self.id_col, self.path_col = list(keys), id_col, path_col
        given = [*self.keys, path_col]
        places = nodes.dropna(subset=given).select(*self.keys, sort_key(F.col(path_col)).alias("_key"), F.lit(1).alias("_node"),
                                                   id_col, F.lit(None).cast("string").alias("_mark"), F.lit(None).cast("string").alias("_share"))
        marks = F.array(*[F.struct(F.lit(name).alias("_mark"), F.concat(F.col("_key"), F.lit(bytearray(end))).alias("_at"))
                          for name, end in BORDERS.items()])
        asked = shares.select(*given).dropna().distinct().withColumn("_key", sort_key(F.col(path_col)))
        edges = asked.select(*self.keys, F.col(path_col).alias("_share"), F.inline(marks)) \
            .withColumnRenamed("_at", "_key").withColumn("_node", F.lit(0))
        order = [*self.keys, "_key", "_node", id_col]  # marks come before a node of the same path
        counted = numbered(places.unionByName(edges, allowMissingColumns=True), order, "Pre", materialize, "tree-order", weight="_node")
        self.places = materialize(counted.filter("_node = 1").select(*self.keys, id_col, "Pre"), "tree-places")
        self.intervals = materialize(
            counted.filter("_node = 0").groupBy(*self.keys, F.col("_share").alias(path_col))
            .agg(*[F.max(F.when(F.col("_mark") == m, F.col("Pre"))).alias(m) for m in BORDERS]), "tree-shares")

    def inside(self, holds: str, nodes: DataFrame | None = None, shares: DataFrame | None = None) -> DataFrame:
        """(keys, id, path of the share, ...): every node with every share that holds it.

        holds   "strict": the share itself and the paths below its separator; "below": without the share itself;
                "prefix": every path that starts with the share's
        nodes   only these (keys, id)
        shares  only these of the tree's shares (keys, path, more columns that come along)
        """
        ids = [*self.keys, self.id_col]
        places = self.places if nodes is None else self.places.join(nodes.select(*ids).distinct(), ids, "left_semi")
        held = self.intervals if shares is None else self.intervals.join(shares, [*self.keys, self.path_col])
        lo, hi = (F.col(c) for c in HOLDS[holds])
        more = [c for c in held.columns if c not in self.keys and c not in BORDERS]
        chunks = F.sequence(F.floor(lo / CHUNK), F.floor((hi - 1) / CHUNK))
        held = held.filter(hi > lo).select(*more, lo.alias("_lo"), hi.alias("_hi"), F.explode(chunks).alias("_chunk"))
        # A share's interval lies among its own server's paths, so the keys need no comparison.
        return places.withColumn("_chunk", F.floor(F.col("Pre") / CHUNK)).join(held, "_chunk") \
            .filter((F.col("_lo") <= F.col("Pre")) & (F.col("Pre") < F.col("_hi"))).select(*ids, *more)
