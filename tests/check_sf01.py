"""Oracle check at sf0.1, where hot SIDs are salted (slow; run by hand):
    python tests/check_sf01.py
Full-row comparison for the salted keys, aggregate fingerprint for the 10M-row effective access."""
import sys, time
sys.path.insert(0, "/root/repo"); sys.path.insert(0, "/root/repo/tests")
from grantlens import build_session, GovernanceCatalog
from oracle_compare import duck, compare
import __spark_entry__ as E
from pyspark.sql import functions as F
spark = build_session("local[8]", 8, extra={"spark.ui.showConsoleProgress": "false"})
sf = "/root/testdata/sf0.1"; con = duck(sf)
cat = GovernanceCatalog.for_dir(spark, sf)
print("hot plan", cat.hot_holders)
for name in ["membership_closure", "trustee_share_access", "unused_access", "resource_access", "unused_access_all_shares",
             "resource_access_all_shares", "trustee_access_local_batch", "permission_source", "trustee_access", "effective_membership_filtered"]:
    t = time.time(); n, problems = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], sf)
    print("OK " if not problems else "BAD", name, n, round(time.time() - t, 1), problems, flush=True)
# aggregate fingerprint of the full effective access (10M rows)
s = E.queries()["effective_access"](spark, sf).agg(
    F.count(F.lit(1)).alias("n"), F.countDistinct("TrusteeNTStyleName").alias("t"), F.sum("AllowRights").alias("a"),
    F.sum("DenyRights").alias("d"), F.sum(F.length("AllowRightsDescription")).alias("la"), F.sum("ResourceID").alias("r")).collect()[0]
d = con.execute("SELECT count(*), count(DISTINCT TrusteeNTStyleName), sum(AllowRights), sum(DenyRights), sum(length(AllowRightsDescription)), sum(ResourceID) FROM (" + E.oracle_sql()["effective_access"] + ")").fetchone()
print("effective_access aggregate", tuple(s), tuple(int(x) for x in d), "OK" if tuple(int(x) for x in s) == tuple(int(x) for x in d) else "BAD")
