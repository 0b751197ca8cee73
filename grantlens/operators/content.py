"""G-7: content-scan matches per document and criterion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.sources.governance import HOST_MODULUS

# The default scan criteria (name -> Java/RE2-compatible regex).
DEFAULT_CRITERIA = {
    "Email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}",
    "IPv4": r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}",
}
# A literal every match must contain: texts without it skip the regex (exact,
# and a plain substring search is far cheaper than a backtracking scan).
REQUIRED_LITERAL = {"Email": "@", "IPv4": "."}


def content_matches(documents: DataFrame, resources: Column, criteria: dict[str, str] | None = None,
                    text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(DocumentID, HostID, ParentResourceID, CriteriaName, MatchCount) with MatchCount > 0.

    Document k sits in resource k modulo ``resources``, their number.
    Each criterion is a literal-pattern ``regexp_count`` over the whole text
    (compiled once per task, JVM side); the per-criterion counts are
    exploded into rows. A map-only stage: no shuffle.
    """
    crit = criteria or DEFAULT_CRITERIA
    required = REQUIRED_LITERAL if criteria is None else {}
    text = F.col(text_col)

    def count(name: str, pattern: str):
        n = F.regexp_count(text, F.lit(pattern)).cast("long")
        lit = required.get(name)
        return n if lit is None else F.when(F.instr(text, lit) > 0, n).otherwise(F.lit(0).cast("long"))

    per = [F.struct(F.lit(name).alias("CriteriaName"), count(name, pattern).alias("MatchCount"))
           for name, pattern in crit.items()]
    d = documents.select(F.col(id_col).alias("DocumentID"), F.explode(F.array(*per)).alias("m"))
    parent = F.col("DocumentID") % resources
    return d.select(
        "DocumentID",
        (parent % HOST_MODULUS).cast("int").alias("HostID"),
        parent.alias("ParentResourceID"),
        F.col("m.CriteriaName").alias("CriteriaName"),
        F.col("m.MatchCount").alias("MatchCount"),
    ).filter(F.col("MatchCount") > 0)
