"""Does this group hold this member? Answered from labels instead of all pairs.

The closure stores every (group, member) pair. Here the groups are numbered
once, and a group keeps the intervals of numbers that it reaches:

1. groups on a cycle reach the same: strongly connected components, by
   trimming groups without parents or children, then forward colouring and
   backward search among the rest; each component becomes one node;
2. the nodes form an acyclic graph. A spanning forest of it is numbered in
   pre-order, so a node's subtree is one interval;
3. an edge outside the forest hands the child's intervals to the parent,
   bottom-up; intervals inside another of the same node are dropped. In a
   nearly tree-shaped directory few nodes keep more than their own.

A member is reached by a group if one of the groups listing it directly has a
number in an interval of the asked group. Users get no labels at all.

Rounds are joins and aggregations, each written with ``checkpoint()``; their
number follows the depth of nesting, not the size of the directory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grantlens.session import ensure_checkpoint_dir

PARTS = 64  # parts in which the children of one node are numbered


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) of a graph (parent, child); the component is its smallest node."""
    done, left, live = [], nodes.checkpoint(eager=True), edges.filter("parent <> child").distinct().checkpoint(eager=True)
    while True:
        # A node without parents or without children lies on no cycle. All such leave, until none is left.
        inner = left.join(live.select(F.col("child").alias("node")), "node", "left_semi") \
            .join(live.select(F.col("parent").alias("node")), "node", "left_semi").checkpoint(eager=True)
        if inner.count() == left.count():
            if inner.isEmpty():
                break
            # The greatest node that reaches each node is its colour; what also reaches that node is its component.
            colour = _spread(left.withColumn("colour", F.col("node")), live, F.max)
            near = live.join(colour.select(F.col("node").alias("parent"), F.col("colour").alias("pc")), "parent") \
                .join(colour.select(F.col("node").alias("child"), F.col("colour").alias("cc")), "child") \
                .filter("pc = cc").select(F.col("child").alias("parent"), F.col("parent").alias("child"), F.col("pc").alias("colour"))
            found = colour.filter("node = colour").checkpoint(eager=True)
            front = found
            while True:
                step = front.select(F.col("node").alias("parent")).join(near, "parent").select(F.col("child").alias("node"), "colour").distinct()
                front = step.join(found, ["node", "colour"], "left_anti").checkpoint(eager=True)
                if front.isEmpty():
                    break
                found = found.unionByName(front)
            least = found.groupBy("colour").agg(F.min("node").alias("component"))
            done.append(found.join(least, "colour").select("node", "component").checkpoint(eager=True))
            inner = left.join(done[-1], "node", "left_anti").checkpoint(eager=True)
        else:
            done.append(left.join(inner, "node", "left_anti").select("node", F.col("node").alias("component")).checkpoint(eager=True))
        left = inner
        live = live.join(left.select(F.col("node").alias("parent")), "parent", "left_semi") \
            .join(left.select(F.col("node").alias("child")), "child", "left_semi").checkpoint(eager=True)
    return reduce(DataFrame.unionByName, done) if done else nodes.select("node", F.col("node").alias("component"))


def _spread(start: DataFrame, edges: DataFrame, best) -> DataFrame:
    """(node, colour) after colours went along all edges until nothing changes."""
    now = start.checkpoint(eager=True)
    while True:
        sent = now.select(F.col("node").alias("parent"), "colour").join(edges, "parent").select(F.col("child").alias("node"), "colour")
        after = now.unionByName(sent).groupBy("node").agg(best("colour").alias("colour")).checkpoint(eager=True)
        if after.join(now, ["node", "colour"], "left_anti").isEmpty():
            return after
        now = after


def _levels(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, int]:
    """(node, level) of an acyclic graph, level being the longest way from a node without parents; and the last level."""
    front = nodes.join(edges.select(F.col("child").alias("node")), "node", "left_anti").checkpoint(eager=True)
    found, level = [front.withColumn("level", F.lit(0))], 0
    while True:
        front = front.select(F.col("node").alias("parent")).join(edges, "parent").select(F.col("child").alias("node")).distinct().checkpoint(eager=True)
        if front.isEmpty():
            break
        level += 1
        found.append(front.withColumn("level", F.lit(level)))
    return reduce(DataFrame.unionByName, found).groupBy("node").agg(F.max("level").alias("level")).checkpoint(eager=True), level


def _places(rows: DataFrame) -> DataFrame:
    """``rows`` (parent, node, size) with ``ahead``, the sizes of the parent's children before the node. The children of a
    parent are taken in PARTS parts by hash, so that a parent with very many does not land in one task."""
    parts = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)))
    sums = parts.groupBy("parent", "part").agg(F.sum("size").alias("all"))
    before = F.coalesce(F.sum("all").over(Window.partitionBy("parent").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = Window.partitionBy("parent", "part").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("size").over(within), F.lit(0))
    return parts.withColumn("inside", inside).join(sums.withColumn("before", before).drop("all"), ["parent", "part"]) \
        .select("parent", "node", "size", (F.col("before") + F.col("inside")).alias("ahead"))


class GroupLabels:
    """``numbers`` (GroupSid, component, number) and ``labels`` (component, first, last) of group-in-group edges.

    ``edges`` (GroupSid, MemberSid) are all memberships, ``nested`` those whose
    member is a group (closure.group_edges). Null SIDs are no members; a group
    that lists itself is a cycle of one.
    """

    def __init__(self, edges: DataFrame, nested: DataFrame):
        ensure_checkpoint_dir(edges.sparkSession)
        self.edges = edges.filter("GroupSid is not null and MemberSid is not null").select("GroupSid", "MemberSid").distinct()
        graph = nested.select(F.col("GroupSid").alias("parent"), F.col("MemberSid").alias("child")).dropna()
        nodes = self.edges.select(F.col("GroupSid").alias("node")).distinct()
        of = components(graph, nodes).checkpoint(eager=True)
        up, down = of.select(F.col("node").alias("parent"), F.col("component").alias("p")), of.select(F.col("node").alias("child"), F.col("component").alias("c"))
        dag = graph.join(up, "parent").join(down, "child").filter("p <> c") \
            .select(F.col("p").alias("parent"), F.col("c").alias("child")).distinct().checkpoint(eager=True)
        level, last = _levels(dag, of.select(F.col("component").alias("node")).distinct())
        # The forest: of a node's parents one level above, the smallest.
        above = dag.join(level.select(F.col("node").alias("child"), F.col("level").alias("below")), "child") \
            .join(level.select(F.col("node").alias("parent"), F.col("level").alias("over")), "parent").filter("below = over + 1")
        tree = above.groupBy("child").agg(F.min("parent").alias("parent"))
        forest = level.join(tree.withColumnRenamed("child", "node"), "node", "left").checkpoint(eager=True)

        sizes, lower = [], None
        for k in range(last, -1, -1):
            at = forest.filter(F.col("level") == k)
            if lower is not None:
                sums = lower.groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("sum"))
                at = at.join(sums, "node", "left").withColumn("size", F.coalesce("sum", F.lit(0)) + 1).drop("sum")
            else:
                at = at.withColumn("size", F.lit(1).cast("long"))
            lower = at.checkpoint(eager=True)
            sizes.append(lower)
        sized = reduce(DataFrame.unionByName, sizes).withColumn("parent", F.coalesce("parent", F.lit("")))
        placed = _places(sized.select("parent", "node", "size")).join(level, "node").checkpoint(eager=True)
        own = upper = placed.filter("level = 0").select("node", F.col("ahead").alias("first"), (F.col("ahead") + F.col("size") - 1).alias("last")).checkpoint(eager=True)
        for k in range(1, last + 1):
            start = upper.select(F.col("node").alias("parent"), F.col("first").alias("from"))
            number = F.col("from") + 1 + F.col("ahead")
            upper = placed.filter(F.col("level") == k).join(start, "parent") \
                .select("node", number.alias("first"), (number + F.col("size") - 1).alias("last")).checkpoint(eager=True)
            own = own.unionByName(upper)
        own = own.checkpoint(eager=True)

        # Intervals from edges outside the forest go up level by level.
        spare = dag.join(tree, ["parent", "child"], "left_anti")
        handed = spare.join(own.withColumnRenamed("node", "child"), "child").select(F.col("parent").alias("node"), "first", "last")
        foreign = None
        for k in range(last, -1, -1):
            here = forest.filter(F.col("level") == k).select("node")
            got = handed.join(here, "node", "left_semi")
            if foreign is not None:
                kids = dag.join(here.withColumnRenamed("node", "parent"), "parent", "left_semi")
                got = got.unionByName(kids.join(foreign.withColumnRenamed("node", "child"), "child").select(F.col("parent").alias("node"), "first", "last"))
            kept = self._outer(got.distinct().unionByName(own.join(here, "node", "left_semi"))).join(own, ["node", "first", "last"], "left_anti").checkpoint(eager=True)
            foreign = kept if foreign is None else foreign.unionByName(kept)
        self.labels = own.unionByName(foreign).withColumnRenamed("node", "component").checkpoint(eager=True)
        self.numbers = of.join(own.select(F.col("node").alias("component"), F.col("first").alias("number")), "component") \
            .select(F.col("node").alias("GroupSid"), "component", "number").checkpoint(eager=True)

    @staticmethod
    def _outer(rows: DataFrame) -> DataFrame:
        """The intervals of each node that lie in no other of it. Intervals of one forest are nested or apart."""
        before = Window.partitionBy("node").orderBy("first", F.desc("last")).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("reach", F.max("last").over(before)).filter("reach is null or last > reach").drop("reach")

    def reaches(self, requests: DataFrame) -> DataFrame:
        """(GroupSid, MemberSid, Reaches) for the distinct (GroupSid, MemberSid) asked: is the member in the group, directly
        or through nested groups? Unknown SIDs are in nothing."""
        asked = requests.select("GroupSid", "MemberSid").distinct()
        spans = self.numbers.join(self.labels, "component").select("GroupSid", "first", "last")
        listed = self.edges.withColumnRenamed("GroupSid", "lister").join(self.numbers.select(F.col("GroupSid").alias("lister"), "number"), "lister")
        hit = asked.join(listed.select("MemberSid", "number"), "MemberSid").join(spans, "GroupSid") \
            .filter("number between first and last").select("GroupSid", "MemberSid").distinct().withColumn("Reaches", F.lit(True))
        return asked.join(hit, ["GroupSid", "MemberSid"], "left").select("GroupSid", "MemberSid", F.coalesce("Reaches", F.lit(False)).alias("Reaches"))
