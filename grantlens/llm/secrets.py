"""Secret scans with a trigram inverted index, DataFrame functions only.

Method. From each rule's regular expression a Boolean trigram query is derived on the driver (any of some conjunctions of
lower-cased trigrams that every match must contain). The inverted index holds, for the trigrams that some query names, the
documents that contain them; a conjunction is answered by intersecting its postings (documents that have all its
trigrams). Candidates are verified with the rule itself on the whole text. A rule without mandatory trigrams scans
every text. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 64  # strings that a part of a regular expression may stand for and still be followed exactly


@dataclass(frozen=True)
class Rule:
    """``value`` of at least ``least`` characters is needed in that group of a match, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The three base rules of the contract, in their order. Access keys and hex runs state their length in the
# pattern (a maximal run that is too short has no part that is long enough, so nothing else changes).
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}"),
)
# Public formats of further credentials.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_host", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + MORE


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Conjunctions of trigrams, one of which a text with a match must satisfy; empty if the rule has no such need."""
    best: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        """The strings that must occur here become one alternative of conjunctions each."""
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if sets and frozenset() not in sets:
            best.append([s for s in sets if not any(o < s for o in sets)])

    def exact(node) -> set[str] | None:
        """All strings that a part stands for, if they are few."""
        op, arg = node
        if op is sre.LITERAL:
            return {chr(arg).lower()}
        if op is sre.IN:
            out = set()
            for kind, value in arg:
                if kind is sre.LITERAL:
                    out.add(chr(value).lower())
                elif kind is sre.RANGE and value[1] - value[0] < MOST:
                    out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    return None
            return out if len(out) <= 8 else None
        if op is sre.SUBPATTERN:
            return sequence(arg[3])
        if op is sre.BRANCH:
            parts = [sequence(x) for x in arg[1]]
            return None if any(p is None for p in parts) else set().union(*parts)
        if op is sre.MAX_REPEAT and arg[1] is not sre.MAXREPEAT and arg[1] <= 2:
            one = sequence(arg[2])
            return None if one is None else {"".join(x) for k in range(arg[0], arg[1] + 1) for x in product(one, repeat=k)}
        if op in (sre.ASSERT, sre.ASSERT_NOT, sre.AT):
            return {""}
        return None

    def sequence(nodes) -> set[str] | None:
        out = {""}
        for node in nodes:
            part = exact(node)
            if part is None or len(out) * len(part) > MOST:
                return None
            out = {a + b for a in out for b in part}
        return out

    def walk(nodes) -> None:
        run = {""}
        for node in nodes:
            part = exact(node)
            if part is not None and len(run) * len(part) <= MOST:
                run = {a + b for a in run for b in part}
                continue
            close(run)
            run = {""} if part is None else part
            if part is None and node[0] is sre.SUBPATTERN:
                walk(node[1][3])
        close(run)

    walk(sre_parser.parse(pattern))
    return max(best, key=lambda sets: min(map(len, sets)), default=[])


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the given trigrams over the whole, lower-cased texts."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("doc_id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules): the documents that satisfy the trigram query of the rules that have one."""
    spark = index.sparkSession
    terms = [(r.kind, k, t, len(s)) for r in rules for k, s in enumerate(trigram_query(r.pattern)) for t in sorted(s)]
    # The terms come from the rules alone (a few dozen rows), so they are broadcast whatever the corpus.
    terms = F.broadcast(spark.createDataFrame(terms, "kind string, part int, trigram string, size int"))
    met = index.distinct().join(terms, "trigram").groupBy("doc_id", "kind", "part", "size").agg(F.count("*").alias("n")).filter("n = size")
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("rules"))


def _spans(rule: Rule) -> Column:
    """Array of (start, end) of a rule's leftmost non-overlapping matches in ``text``: what stands between the matches
    and the matches themselves alternate, so that their lengths add up to the offsets."""
    pattern = F.lit(rule.pattern)
    parts, found = F.split("text", rule.pattern, -1), F.regexp_extract_all("text", pattern, F.lit(0))
    value = F.regexp_extract_all("text", pattern, F.lit(rule.group))
    kind = "struct<at:int,spans:array<struct<start:int,end:int>>>"
    lengths = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size")))
    steps = F.zip_with(lengths, value, lambda x, v: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), (F.length(v) >= rule.least).alias("good")))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + x["size"]
        more = F.concat(a["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        return F.struct(end.alias("at"), F.when(x["good"], more).otherwise(a["spans"]).alias("spans")).cast(kind)

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")).cast(kind)
    return F.when(F.regexp_like("text", pattern), F.aggregate(steps, none, step, lambda a: a["spans"])).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def _named(rank: int, kind: str):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): spans is an array of (start, rank, kind, end), by start, then by the rules' order.

    Defined results: a null or empty text has no spans; each row keeps its row, also if ids repeat or are null (rows of
    one id share their candidates, which verification sorts out); other columns are ignored; an empty table gives an
    empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({t for q in queries.values() for s in q for t in s})
    if trigrams:
        found = candidates(build_index(docs, trigrams), rules).select(F.col("doc_id").alias("found_id"), "rules")
        docs = docs.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left").drop("found_id")
    else:
        docs = docs.withColumn("rules", F.lit(None).cast("array<string>"))
    spans = []
    for rank, r in enumerate(rules):
        made = _spans(r)
        if queries[r.kind]:
            made = F.when(F.array_contains("rules", r.kind), made).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        spans.append(F.transform(made, _named(rank, r.kind)))
    return docs.select("doc_id", F.array_sort(F.concat(*spans)).alias("spans"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    return found.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def _oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for rank, r in enumerate(RULES):
        p = quoted(r.pattern.replace("(?<![0-9a-f])", ""))  # the leftmost greedy run starts where no hex digit precedes
        parts.append(f"""SELECT doc_id, {rank} AS rank, {quoted(r.kind)} AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'a': list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'n': length(m[i]), 'v': length(v[i])}})) AS s
    FROM (SELECT doc_id, regexp_extract_all(text, {p}, 0) AS m, regexp_extract_all(text, {p}, {r.group}) AS v, string_split_regex(text, {p}) AS gaps FROM d WHERE regexp_matches(text, {p}))""")
    least = " ".join(f"WHEN {quoted(r.kind)} THEN {r.least}" for r in RULES)
    count = ", ".join(f"count(kind) FILTER (kind = {quoted(r.kind)}) AS n_{r.kind}" for r in BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 found AS ({' UNION ALL '.join(parts)}),
 good AS (SELECT doc_id, rank, kind, s.a::BIGINT AS a, (s.a + s.n)::BIGINT AS e FROM found WHERE s.v >= CASE kind {least} END),
 per AS (SELECT doc_id, {count}, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, rank) AS spans FROM good GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (doc_id)"""


ORACLE_SQL = _oracle()
