"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Method. Every source is cut into blocks of about ``BLOCK`` words by a hash of its documents. A source's target is made of
whole passes over its blocks and of the first blocks of one more permuted pass; where that pass ends, single documents of one
block fill what is left of the target. So each source has an exact quota of block draws. The tree starts with all
quotas at its root; a node halves its shards and deals its draws to both halves, source after source, by a hypergeometric
draw from what is left, so that every shard gets its exact share of draws and every source is spread as if all draws had been
shuffled. A shard then takes disjoint consecutive draws of each source's permuted passes and shuffles its documents locally.

Everything is a DataFrame or SQL function, Python runs no row. Random numbers are hashes of names, so a rerun gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Workspace

BLOCK = 1 << 16  # words of a block
SHARD = 64  # block draws of an output shard
MOST = 3  # passes over a source
SALTS = 64  # parts of a source when its figures are looked up
CHUNK = 1 << 10  # blocks whose words are summed before the running sum
PRIME = 2147483647  # a block's place in a pass is block * PRIME + shift modulo the number of blocks
WORD = r"[^\x20\x09-\x0D]+"


def number_of(text: Column) -> Column:
    """60 bits of the text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def uniform(*names: Column) -> Column:
    """A number in [0, 1) for the names."""
    return F.shiftrightunsigned(F.xxhash64(*names), 11).cast("double") / F.lit(float(1 << 53))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def upto(low: Column, high: Column, step: int) -> Column:
    """low, low + step, ..., high; empty when high lies on the other side."""
    some = low <= high if step > 0 else low >= high
    return F.when(some, F.sequence(low, high, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def hypergeometric(pop: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` out of ``pop`` are among its ``good``, by inversion of ``u``: outcomes are weighed against the
    most likely one by the ratio of neighbours, within 12 standard deviations (beyond, less than 1e-30 is left)."""

    def ratio(v, x):  # weight of x + 1 against x
        return (v["good"] - x) * (v["draws"] - x) / ((x + 1) * (v["pop"] - v["good"] - v["draws"] + x + 1))

    mode = F.floor((draws + 1).cast("double") * (good + 1) / (pop + 2))
    var = draws.cast("double") * good / F.greatest(pop, F.lit(1)) * (pop - good) / F.greatest(pop, F.lit(1)) + 1
    low, high = F.greatest(F.lit(0).cast("long"), draws + good - pop), F.least(draws, good)
    given = F.struct(pop.alias("pop"), good.alias("good"), draws.alias("draws"), u.alias("u"), F.least(F.greatest(mode, low), high).alias("mode"),
                     low.alias("low"), high.alias("high"), (F.ceil(12 * F.sqrt(var)) + 32).alias("wide"))
    none = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))

    def walk(v, step):
        edge = F.least(v["high"], v["mode"] + v["wide"]) if step > 0 else F.greatest(v["low"], v["mode"] - v["wide"])
        return upto(v["mode"] + step, edge, step)

    def weight(v, step):
        change = (lambda x: ratio(v, x - 1)) if step > 0 else (lambda x: 1 / ratio(v, x))
        return lambda s, x: let(s["w"] * change(x), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum")))

    def total(v, step):
        return F.aggregate(walk(v, step), none, weight(v, step), lambda s: s["sum"])

    def find(v, left, step):
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), v["mode"].alias("at"))

        def go(s, x):
            one = weight(v, step)
            return let(one(s, x), lambda n: F.struct(n["w"].alias("w"), n["sum"].alias("sum"), F.when(s["sum"] <= left, x).otherwise(s["at"]).alias("at")))

        return F.aggregate(walk(v, step), start, go, lambda s: s["at"])

    def choose(v):
        sums = F.struct(total(v, 1).alias("up"), total(v, -1).alias("down"))
        return let(sums, lambda t: let(v["u"] * (1 + t["up"] + t["down"]), lambda x: F.when(x < 1, v["mode"]).when(x < 1 + t["up"], find(v, x - 1, 1)).otherwise(find(v, x - 1 - t["up"], -1))))

    return let(given, choose)


def split(quotas: Column, slots: Column, node: Column) -> Column:
    """The quotas (source, k) of the left half, which takes ``slots`` of all draws: one hypergeometric draw per source from
    what the sources before it left."""
    start = F.struct(F.aggregate(quotas, F.lit(0).cast("long"), lambda s, q: s + q["k"]).alias("pop"), slots.alias("slots"), F.array().cast("array<struct<source:int,k:bigint>>").alias("out"))

    def deal(s, q):
        x = hypergeometric(s["pop"], q["k"], s["slots"], uniform(node, q["source"]))
        return let(x, lambda n: F.struct((s["pop"] - q["k"]).alias("pop"), (s["slots"] - n).alias("slots"), F.array_append(s["out"], F.struct(q["source"].alias("source"), n.alias("k"))).alias("out")))

    return F.aggregate(quotas, start, deal, lambda s: s["out"])


def splitting_tree(quotas: DataFrame, shards: int) -> DataFrame:
    """(shard, source, k) of quotas (source int, k long): exact shares of all draws, spread hypergeometrically."""
    entry = F.struct("source", "k")
    nodes = quotas.agg(F.array_sort(F.collect_list(entry)).alias("quotas")).select(F.lit(0).cast("long").alias("shard"), F.lit(shards).cast("long").alias("shards"), "quotas")
    for level in range((shards - 1).bit_length()):
        half = F.call_function("div", F.col("shards"), F.lit(2).cast("long"))
        pop = F.aggregate("quotas", F.lit(0).cast("long"), lambda s, q: s + q["k"])
        slots = F.call_function("div", pop * half, F.col("shards"))
        cut = nodes.withColumn("left", F.when(F.col("shards") > 1, split(F.col("quotas"), slots, F.struct(F.lit(level), F.col("shard")))))
        rest = F.transform(F.arrays_zip(F.col("quotas").alias("q"), F.col("left").alias("l")), lambda z: F.struct(z["q"]["source"].alias("source"), (z["q"]["k"] - z["l"]["k"]).alias("k")))
        one = F.struct("shard", half.alias("shards"), F.col("left").alias("quotas"))
        other = F.struct((F.col("shard") + half).alias("shard"), (F.col("shards") - half).alias("shards"), rest.alias("quotas"))
        both = F.when(F.col("left").isNull(), F.array(F.struct("shard", "shards", "quotas"))).otherwise(F.array(one, other))
        nodes = cut.select(F.explode(both).alias("n")).select("n.*")
    return nodes.select("shard", F.explode("quotas").alias("q")).select("shard", "q.*").filter("k > 0")


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """(no, source, source_size, target) of (source, source_size): weights 1, 2, 3, repeating over the sources by code point,
    null last, share all words; a target stops at ``most`` times its source, the excess is shared again."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("no", F.row_number().over(every)).withColumn("weight", (F.col("no") - 1) % 3 + 1)
    # By size per weight: a source is full if it is so when all before it are.
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "no")
    whole = Window.partitionBy(F.lit(0))
    cap = F.col("source_size") * most
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("all", F.sum("source_size").over(whole)).withColumn("before", before).withColumn("after", after)
    rows = rows.withColumn("full", cap * F.col("after") < (F.col("all") - F.col("before")) * F.col("weight"))
    left = F.col("all") - F.coalesce(F.sum(F.when(F.col("full"), cap)).over(whole), F.lit(0))
    weight = F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole), F.lit(1))
    target = F.when(F.col("full"), cap.cast("double")).otherwise((left * F.col("weight")).cast("double") / weight)
    return rows.select("no", "source", "source_size", target.alias("target"))


class Mix:
    """A mix of ``docs``: ``documents`` has one row per document with its draws, ``shards`` the mixed rows.

    Defined results: a null or empty text has size 0 and is never drawn; a null source is one source, the last; rows that
    repeat a doc_id in a source (or, without doc_id, a text) are drawn alike; other columns keep their names in ``rest``; an
    empty table gives an empty result. No document is drawn more than three times.
    """

    def __init__(self, docs: DataFrame, block: int = BLOCK, shard: int = SHARD):
        self.space = space = Workspace(docs.sparkSession, "mix")
        text, doc_id = docs["text"].cast("string"), docs["doc_id"].cast("string")
        rest = F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("rest")
        size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
        mark = number_of(F.when(doc_id.isNotNull(), doc_id).otherwise(F.coalesce(text, F.lit(""))))
        given = space.store(docs.select(rest, size.alias("size"), docs["source"].cast("string").alias("source"), mark.alias("mark")), "given")
        sizes = given.groupBy("source").agg(F.sum("size").alias("source_size"))
        passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0).cast("long"))
        self.sources = targets(sizes).withColumn("passes", passes).withColumn("part", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)))
        self.sources = space.store(self.sources.withColumn("blocks", F.greatest(F.ceil(F.col("source_size") / block), F.lit(1).cast("long"))), "sources")
        # A source may hold a third of all rows: its figures meet them in SALTS parts.
        salted = self.sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "name")
        rows = given.withColumn("salt", F.pmod(F.xxhash64("mark"), F.lit(SALTS)).cast("int"))
        rows = rows.join(salted, (rows["salt"] == salted["salt"]) & rows["source"].eqNullSafe(salted["name"]))
        self.rows = space.store(rows.select("rest", "size", "mark", "no", "source_size", "target", "passes", "part", "blocks", (F.col("mark") % F.col("blocks")).alias("block")), "rows")
        space.drop("given")
        self._plan(shard)

    def _plan(self, shard: int) -> None:
        space, drawn = self.space, self.rows.filter("size > 0")
        facts = ("no", "passes", "part", "blocks")
        blocks = drawn.groupBy(*facts, "block").agg(F.sum("size").alias("words"))
        place = lambda turn: (F.col("block") * PRIME + number_of(F.concat_ws(":", "no", turn)) % F.col("blocks")) % F.col("blocks")
        blocks = space.store(blocks.withColumn("place", place(F.col("passes"))), "blocks")
        # Where the last pass ends: the chunk of blocks, the block in it, the documents in that.
        crossing = F.col("before").between(0, F.col("part")) & (F.col("part") < F.col("before") + F.col("words"))

        def cross(rows: DataFrame, order: str) -> DataFrame:
            window = Window.partitionBy("no").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
            return rows.withColumn("before", F.col("ahead") + F.coalesce(F.sum("words").over(window), F.lit(0))).filter(crossing)

        chunk = F.call_function("div", F.col("place"), F.lit(CHUNK).cast("long")).alias("chunk")
        chunks = blocks.groupBy("no", "part", chunk).agg(F.sum("words").alias("words")).withColumn("ahead", F.lit(0).cast("long"))
        ends = cross(chunks, "chunk").select("no", "chunk", F.col("before").alias("ahead"))
        ends = cross(blocks.select("*", chunk).join(ends, ["no", "chunk"]), "place").select("no", "block", "place", "before")
        ends = space.store(ends, "ends")
        units = drawn.join(ends, ["no", "block"]).groupBy("no", "part", "before", "mark").agg(F.sum("size").alias("words"))
        order = Window.partitionBy("no").orderBy("mark").rowsBetween(Window.unboundedPreceding, 0)
        units = units.withColumn("after", F.col("before") + F.sum("words").over(order)).withColumn("fits", F.col("after") <= F.col("part"))
        # All documents that fit, by mark; of the block's others, from the largest on, each that still fits, and
        # one more if that comes nearer. The array holds the documents of one block, that is of about BLOCK words.
        reached = F.coalesce(F.max(F.when(F.col("fits"), F.col("after"))), F.first("before"))
        others = F.sort_array(F.collect_list(F.when(~F.col("fits"), F.struct("words", (-F.col("mark")).alias("mark")))), asc=False)
        edge = units.groupBy("no", "part").agg(F.max(F.when(F.col("fits"), F.col("mark"))).alias("upto"), reached.alias("reached"), others.alias("others"))
        start = F.struct((F.col("part") - F.col("reached")).alias("left"), F.array().cast("array<bigint>").alias("picks"))

        def pick(state, unit):
            taken = F.struct((state["left"] - unit["words"]).alias("left"), F.array_append(state["picks"], -unit["mark"]).alias("picks"))
            return F.when(unit["words"] <= state["left"], taken).otherwise(state)

        edge = edge.withColumn("state", F.aggregate("others", start, pick))
        rest = F.filter("others", lambda x: ~F.array_contains("state.picks", -x["mark"]))
        near = F.array_min(F.transform(rest, lambda x: F.struct(F.abs(x["words"] - F.col("state.left")).alias("off"), (-x["mark"]).alias("mark"))))
        edge = edge.withColumn("near", near).withColumn("picks", F.col("state.picks"))
        edge = edge.select("no", "upto", F.when(F.col("near.off") < F.col("state.left"), F.array_append("picks", F.col("near.mark"))).otherwise(F.col("picks")).alias("picks"))
        edge = space.store(ends.select("no", F.col("place").alias("end")).join(edge, "no"), "edge")

        some = F.col("upto").isNotNull() | (F.size("picks") > 0)
        quotas = self.sources.select("no", "passes", "blocks").join(edge, "no", "left")
        quotas = quotas.select(F.col("no").alias("source"), (F.col("passes") * F.col("blocks") + F.coalesce(F.col("end") + some.cast("long"), F.lit(0))).alias("k")).filter("k > 0")
        total = quotas.agg(F.sum("k")).head()[0] or 0
        self.quotas = space.store(splitting_tree(quotas, max(1, -(-total // shard))), "quotas")
        # A shard takes the next draws of each source.
        order = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(F.sum("k").over(order), F.lit(0))
        draws = self.quotas.withColumn("start", start).select(F.col("source").alias("no"), "shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("k") - 1)).alias("draw"))
        turns = blocks.select("no", "passes", "blocks", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))).alias("turn"))
        turns = turns.withColumn("draw", F.col("turn") * F.col("blocks") + place(F.col("turn"))).join(draws, ["no", "draw"])
        plan = turns.groupBy("no", "block").agg(F.array_sort(F.collect_list(F.struct("turn", "shard"))).alias("draws"))
        ending = ends.select("no", "block").join(edge.drop("end"), "no")
        plan = space.store(plan.join(ending.withColumn("ending", F.lit(True)), ["no", "block"], "left"), "plan")
        whole = F.col("ending").isNull() | (F.col("mark") <= F.col("upto")) | F.array_contains("picks", F.col("mark"))
        kept = F.filter("draws", lambda d: (d["turn"] < F.col("passes")) | F.coalesce(whole, F.lit(False)))
        empty = F.array().cast("array<struct<turn:bigint,shard:bigint>>")
        found = self.rows.withColumn("block", F.when(F.col("size") > 0, F.col("block"))).join(plan, ["no", "block"], "left")
        self.documents = found.select("rest", "size", "source_size", "target", F.coalesce(kept, empty).alias("draws"), "mark")

    def shards(self) -> DataFrame:
        """(shard, place, turn, rest, size): the mixed rows; a shard's rows are in random order by ``place``. Write it with
        ``repartition("shard")`` and join texts by id."""
        rows = self.documents.select("rest", "size", "mark", F.explode("draws").alias("d")).select("d.shard", "d.turn", "rest", "size", "mark")
        order = Window.partitionBy("shard").orderBy(F.xxhash64("mark", "turn", "shard"), "mark", "turn")
        return rows.withColumn("place", F.row_number().over(order)).select("shard", "place", "turn", "rest", "size")


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    taken = F.col("size") * F.size("draws")
    return Mix(docs).documents.select("rest.doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


#: The blocks' places and the running sums of every source in one window each; the targets by resharing round by round, one
#: round more than there are sources.
ORACLE_SQL = rf"""
WITH RECURSIVE given AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15) AS BIGINT) AS mark FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM given GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM sizes),
weighed AS (SELECT *, (no - 1) % 3 + 1 AS weight FROM named),
rounds AS (
  SELECT 0 AS r, no, weight, source_size, false AS filled, CAST((SELECT sum(source_size) FROM sizes) AS BIGINT) AS pool, CAST((SELECT sum(weight) FROM weighed) AS BIGINT) AS share FROM weighed
  UNION ALL
  SELECT r + 1, no, weight, source_size, now, CAST(pool - coalesce(sum(3 * source_size) FILTER (now AND NOT filled) OVER (), 0) AS BIGINT), CAST(share - coalesce(sum(weight) FILTER (now AND NOT filled) OVER (), 0) AS BIGINT)
  FROM (SELECT *, filled OR 3 * source_size * share < pool * weight AS now FROM rounds) WHERE r <= (SELECT count(*) FROM sizes)),
aims AS (SELECT no, CASE WHEN filled THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(pool * weight AS DOUBLE) / share END AS target FROM rounds WHERE r = (SELECT max(r) FROM rounds)),
sources AS (SELECT n.*, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes,
    greatest(1, CAST(ceil(source_size / {BLOCK}) AS BIGINT)) AS blocks FROM named n JOIN aims USING (no)),
spread AS (SELECT g.doc_id, g.size, g.mark, s.*, greatest(target - passes * source_size, 0) AS part, mark % blocks AS block,
    (mark % blocks * {PRIME} + CAST('0x' || substr(md5(s.no || ':' || passes), 1, 15) AS BIGINT) % blocks) % blocks AS place
  FROM given g JOIN sources s ON g.source IS NOT DISTINCT FROM s.source),
sums AS (SELECT *, sum(size) OVER (PARTITION BY no ORDER BY place) - sum(size) OVER (PARTITION BY no, place) AS before, sum(size) OVER (PARTITION BY no, place) AS words FROM spread),
ending AS (SELECT *, before <= part AND part < before + words AND size > 0 AS last_block, before + words <= part AS whole FROM sums),
units AS (SELECT no, part, before, mark, sum(size) AS words FROM ending WHERE last_block GROUP BY ALL),
ordered AS (SELECT *, before + sum(words) OVER (PARTITION BY no ORDER BY mark) AS after FROM units),
fit AS (SELECT no, max(mark) FILTER (after <= part) AS upto, max(part) - coalesce(max(after) FILTER (after <= part), min(before)) AS room FROM ordered GROUP BY no),
others AS (SELECT no, mark, words, row_number() OVER (PARTITION BY no ORDER BY words DESC, mark) AS k FROM ordered WHERE after > part),
picks AS (
  SELECT no, CAST(0 AS BIGINT) AS k, room, CAST(NULL AS BIGINT) AS mark FROM fit
  UNION ALL
  SELECT p.no, o.k, CASE WHEN words <= room THEN room - words ELSE room END, CASE WHEN words <= room THEN o.mark END FROM picks p JOIN others o ON o.no = p.no AND o.k = p.k + 1),
nearest AS (SELECT o.no, arg_min(o.mark, {{'off': abs(words - room), 'mark': o.mark}}) FILTER (abs(words - room) < room) AS mark
  FROM others o JOIN (SELECT no, min(room) AS room FROM picks GROUP BY no) USING (no) ANTI JOIN picks p ON p.no = o.no AND p.mark = o.mark GROUP BY o.no),
chosen AS (SELECT no, mark FROM picks UNION ALL SELECT no, mark FROM nearest)
SELECT doc_id, size, source_size, target,
  size * (passes + CASE WHEN whole OR last_block AND (coalesce(mark <= upto, false) OR EXISTS (SELECT 1 FROM chosen p WHERE p.no = ending.no AND p.mark = ending.mark)) THEN 1 ELSE 0 END) AS taken
FROM ending LEFT JOIN fit USING (no)
"""
