"""G-5: ACL entries expanded to principals without a shuffle of the expanded rows.

The (resource, principal) pairs are many times the entries and the
memberships they come from. So principals are numbered and dealt into buckets
of ``PAIRS`` (trustee, principal) pairs, an entry goes to each bucket that
holds a principal of its trustee, and both meet there, as all entries of a
resource that reach a principal are in its bucket. A bucket is cut into
slices by the resource, each with its own copy of the bucket's pairs.

Both the copies of entries (more buckets) and those of pairs (more slices)
cost shuffle, so buckets and slices are large: pairs travel as numbers in one
array per trustee, and a slice's rows are never in memory at once. The task
expands them for some principals after another, about ``CHUNK`` rows at a
time, and ORs the masks of a principal on a resource there. Rows leave in the
order of the trustee that gave them first, then the resource: all columns but
the name stay the same for the trustee's members, and the names come again
for its next resource, which a columnar file keeps in few bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.operators.numbering import numbered
from grantlens.operators.skew import skew_join
from grantlens.session import ensure_checkpoint_dir

PAIRS = 4_000_000  # (trustee, principal) pairs of a bucket
ROWS = 48_000_000  # expanded rows of a slice
ENTRIES = 3_000_000  # entries of a slice
LEAST = 500_000  # rows for which a slice of its own is worth while
CHUNK = 1_000_000  # expanded rows in memory
BATCH = 65_536  # rows handed on at a time
PLACE = ["_bucket", "_slice"]
PIECES = "_bucket int, kind string, data binary"
MASKS = ["AllowRights", "DenyRights"]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, one range after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _firsts(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))


def _in_order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys (not below 0) in order and the places they were at, the first place of equal ones first."""
    bits = max(1, int(len(key)).bit_length())
    if not len(key) or int(key.max()).bit_length() + bits > 63:
        order = np.argsort(key, kind="stable")
        return key[order], order
    both = np.sort(key << bits | np.arange(len(key)))
    return both >> bits, both & (1 << bits) - 1


class _Slice:
    """The entries, pairs and names that met in a slice, as numbers."""

    def __init__(self, entries: pa.Table, members: pa.Table, keys: list[str]):
        self.resources, code = _resources(entries, keys)
        sids = members["_of"].to_numpy()
        known = np.argsort(sids)
        trustee = known[np.searchsorted(sids, entries["_t"].to_numpy(), sorter=known)]
        size = max(1, self.resources.num_rows)
        _, order = _in_order(trustee * size + code)
        self.code, trustee = code[order], trustee[order]
        self.masks = []
        for mask in MASKS:
            column = entries[mask].combine_chunks()
            value, known = pc.fill_null(column, 0).to_numpy()[order], pc.is_valid(column).to_numpy(zero_copy_only=False)[order]
            self.masks.append((column.type, value, None if known.all() else known))
        self.entries = np.bincount(trustee, minlength=len(sids))  # of each trustee
        self.at = np.cumsum(self.entries) - self.entries
        lists = members["_members"].combine_chunks()
        who, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(sids), dtype=np.int32), pc.list_value_length(lists).to_numpy())
        reached = self.entries[of] > 0
        self.who, self.of = who[reached], of[reached]

    def chunks(self):
        """(resource codes, principals, masks): the rows of some principals after another, one for each resource and principal."""
        if not len(self.who):
            return
        until = np.cumsum(np.bincount(self.who, weights=self.entries[self.of]))  # rows up to each principal
        part = ((until - 1) // CHUNK).astype(np.int64)
        people, every = len(part), len(self.entries) * len(part)
        pairs = np.unique(part[self.who] * every + self.of * np.int64(people) + self.who)  # a pair that comes twice counts once
        bounds = np.searchsorted(pairs, np.arange(part[-1] + 2) * every)
        for low, high in zip(bounds, bounds[1:]):
            if low < high:
                yield self._rows(*np.divmod(pairs[low:high] % every, people), people)

    def _rows(self, of: np.ndarray, who: np.ndarray, people: int):
        first = _firsts(of)
        members, n = np.diff([*first, len(of)]), self.entries[of[first]]
        entry, members, first = _ranges(self.at[of[first]], n), np.repeat(members, n), np.repeat(first, n)
        member, entry = who[_ranges(first, members)], np.repeat(entry, members)
        code, least = self.code[entry], int(who.min())
        pair, place = _in_order(code * (people - least) + member - least)
        group = _firsts(pair)
        alone = len(group) == len(pair)
        kept = np.sort(place[group])
        masks = []
        for kind, value, known in self.masks:
            value, known = value[entry], None if known is None else known[entry]
            if not alone:
                # A null mask adds nothing; where all are null the result is, as with bit_or.
                value[place[group]] = np.bitwise_or.reduceat(value[place], group)
                value = value[kept]
                if known is not None:
                    known[place[group]] = np.logical_or.reduceat(known[place], group)
                    known = known[kept]
            masks.append(pa.array(value, kind, mask=None if known is None else ~known))
        return (code, member, masks) if alone else (code[kept], member[kept], masks)


def _resources(entries: pa.Table, keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    """The distinct keys (null is a value) and each entry's place among them."""
    code, first = np.zeros(entries.num_rows, np.int64), np.zeros(0, np.int64)
    for k in keys:
        column = entries[k].combine_chunks()
        coded = pc.dictionary_encode(column, null_encoding="encode")
        coded = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        _, first, code = np.unique(code * max(1, coded[1]) + coded[0], return_index=True, return_inverse=True)
    return entries.select(keys).take(pa.array(first)).combine_chunks(), code.astype(np.int64)


def _piece(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as to:
        to.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _in_pieces(kind: str):
    """(_bucket, kind, data): rows that come bucket by bucket, many in a piece."""

    def run(batches):
        for batch in batches:
            bucket = batch.column("_bucket").to_numpy()
            bounds = [*_firsts(bucket), len(bucket)]
            for low, high in zip(bounds, bounds[1:]):
                data = _piece(batch.slice(low, high - low).select(batch.schema.names[1:]))
                yield pa.record_batch([pa.array([int(bucket[low])], pa.int32()), pa.array([kind]), pa.array([data], pa.binary())], names=["_bucket", "kind", "data"])

    return run


def _met(entries: pa.Table, pieces: pa.Table) -> pa.Table:
    """(kind, data): what met in a slice, in pieces; the last one is its end."""
    more = [("entries", _piece(b)) for b in entries.combine_chunks().to_batches(max_chunksize=BATCH)] if pieces.num_rows else []
    more = [pa.record_batch([pa.array([kind]), pa.array([data], pa.binary())], names=["kind", "data"]) for kind, data in [*more, ("end", b"")]]
    return pa.Table.from_batches([*pieces.select(["kind", "data"]).to_batches(), *more])


def _per_slice(work):
    """``work`` over each slice of a task; the batches that it makes."""

    def run(batches):
        got: dict[str, list[pa.RecordBatch]] = {}
        for batch in batches:
            for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data")):
                if kind != "end":
                    got.setdefault(kind, []).extend(pa.ipc.open_stream(data.as_buffer()))
                    continue
                tables, got = {k: pa.Table.from_batches(v) for k, v in got.items()}, {}
                if "entries" in tables and "members" in tables:
                    yield from work(tables)

    return run


def _expand(keys: list[str], columns: list[str]):
    """(keys, TrusteeNTStyleName, _a, _d) of a slice."""

    def work(tables: dict[str, pa.Table]):
        names = tables.pop("names")
        names = names["_name"].take(pa.array(np.argsort(names["_who"].to_numpy()))).combine_chunks()
        rows = _Slice(tables.pop("entries"), tables.pop("members"), keys)
        for code, member, masks in rows.chunks():
            for low in range(0, len(code), BATCH):
                some = pa.array(code[low:low + BATCH])
                out = [rows.resources[k].combine_chunks().take(some) for k in keys] + [names.take(pa.array(member[low:low + BATCH]))]
                yield pa.record_batch(out + [m.slice(low, BATCH) for m in masks], names=columns)

    return _per_slice(work)


def _count(keys: list[str], bits: list[int], columns: list[str]):
    """(keys, n0, n1, ...): how many principals of a slice hold each right on a resource."""

    def work(tables: dict[str, pa.Table]):
        rows = _Slice(tables.pop("entries"), tables.pop("members"), keys)
        held = np.zeros((len(bits), rows.resources.num_rows), np.int64)
        for code, _, (allow, deny) in rows.chunks():
            free = pc.fill_null(allow, 0).to_numpy() & ~pc.fill_null(deny, 0).to_numpy()
            for n, bit in enumerate(bits):
                held[n] += np.bincount(code[free & bit != 0], minlength=held.shape[1])
        some = np.flatnonzero(held.any(axis=0))
        out = rows.resources.take(pa.array(some))
        for low in range(0, len(some), BATCH):
            part = out.slice(low, BATCH)
            yield pa.record_batch([part[k].combine_chunks() for k in keys] + [pa.array(n[some[low:low + BATCH]]) for n in held], names=columns)

    return _per_slice(work)


def _meeting(acl: DataFrame, names: DataFrame, keys: list[str], plan: dict, named: bool) -> DataFrame:
    """(kind, data): the pieces of every slice, those of one after each other."""
    spark = acl.sparkSession
    ensure_checkpoint_dir(spark)
    name = F.col("TrusteeNTStyleName")
    pairs = names.select("TrusteeSid", "TrusteeNTStyleName").filter("TrusteeSid IS NOT NULL")
    numbers = numbered(pairs.select("TrusteeNTStyleName").distinct(), ["TrusteeNTStyleName"], "_n", lambda df, _: df.checkpoint(), "")
    numbers = numbers.select(name.alias("_name"), "_n").checkpoint()
    each = max(1, -(-numbers.count() // max(1, -(-names.count() // PAIRS))))  # principals of a bucket
    bucket, who = F.floor(F.col("_n") / each).cast("int").alias("_bucket"), (F.col("_n") % each).cast("int").alias("_who")
    members = pairs.join(numbers, name.eqNullSafe(F.col("_name"))).select("TrusteeSid", bucket, who) \
        .groupBy("TrusteeSid", "_bucket").agg(F.collect_list("_who").alias("_members")) \
        .withColumn("_t", F.monotonically_increasing_id()).checkpoint()
    touched = members.select("TrusteeSid", "_bucket", "_t", F.size("_members").alias("_n"))
    sent = acl.groupBy("TrusteeSid").agg(F.count(F.lit(1)).alias("_entries"))
    sizes = touched.join(sent, "TrusteeSid").groupBy("_bucket") \
        .agg(F.sum(F.col("_n") * F.col("_entries")).alias("_rows"), F.sum("_entries").alias("_entries")).collect()
    most = min(ROWS, max(LEAST, -(-sum(r["_rows"] for r in sizes) // (4 * spark.sparkContext.defaultParallelism))))
    slices = [(r["_bucket"], max(-(-r["_rows"] // most), -(-r["_entries"] // ENTRIES))) for r in sizes]
    slices = F.broadcast(spark.createDataFrame(slices, "_bucket int, _slices int"))
    # One entry for each resource and trustee; map-side partial aggregation collapses duplicates before the shuffle.
    per_trustee = acl.groupBy(*keys, "TrusteeSid").agg(*[F.bit_or(m).alias(m) for m in MASKS])
    # A trustee has a row per bucket at most, so only those with many entries are split.
    hot = {sid: n for sid, n in plan.items() if n < 0}
    entries = skew_join(touched.select("TrusteeSid", "_bucket", "_t"), per_trustee, "TrusteeSid", hot).join(slices, "_bucket") \
        .withColumn("_slice", F.pmod(F.xxhash64(*keys), F.col("_slices")).cast("int"))
    pieces = members.select("_bucket", F.col("_t").alias("_of"), "_members").sortWithinPartitions("_bucket").mapInArrow(_in_pieces("members"), PIECES)
    if named:
        pieces = pieces.unionByName(numbers.select(bucket, who, "_name").sortWithinPartitions("_bucket").mapInArrow(_in_pieces("names"), PIECES))
    pieces = pieces.join(slices, "_bucket").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
    there = [F.col(c).alias(f"{c}_there") for c in PLACE]
    return entries.select(*PLACE, *keys, "_t", *MASKS).groupBy(*PLACE) \
        .cogroup(pieces.select(*there, "kind", "data").groupBy(*(f"{c}_there" for c in PLACE))).applyInArrow(_met, "kind string, data binary")


def expanded(acl: DataFrame, names: DataFrame, keys: list[str], plan: dict) -> DataFrame:
    """(keys, TrusteeNTStyleName, _a, _d): the masks that reach each principal on each resource.

    acl    keys, TrusteeSid, AllowRights, DenyRights
    names  (TrusteeSid, TrusteeNTStyleName); plan splits the hot trustees (skew.hot_plan)
    """
    types = dict(acl.dtypes)
    columns = {**{k: types[k] for k in keys}, "TrusteeNTStyleName": "string", "_a": types["AllowRights"], "_d": types["DenyRights"]}
    return _meeting(acl, names, keys, plan, True) \
        .mapInArrow(_expand(keys, list(columns)), ", ".join(f"{c} {t}" for c, t in columns.items()))


def counted(acl: DataFrame, names: DataFrame, keys: list[str], plan: dict, rights: dict[str, int]) -> DataFrame:
    """(keys, Right, Principals): how many principals hold each right (its bit allowed and not denied) on a resource; none gives no row."""
    types = dict(acl.dtypes)
    each = [f"n{i}" for i in range(len(rights))]
    columns = {**{k: types[k] for k in keys}, **dict.fromkeys(each, "bigint")}
    held = _meeting(acl, names, keys, plan, False) \
        .mapInArrow(_count(keys, list(rights.values()), list(columns)), ", ".join(f"{c} {t}" for c, t in columns.items()))
    held = held.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in each])
    some = F.array(*[F.struct(F.lit(letter).alias("Right"), F.col(n).alias("Principals")) for letter, n in zip(rights, each)])
    return held.select(*keys, F.inline(some)).filter("Principals > 0")
