"""Column helpers: mask text, LIKE-to-regex translation, account flags."""

import re

from pyspark.sql import functions as F

from grantlens.functions.accounts import ACCOUNT_FLAGS, flag_columns
from grantlens.functions.like import like_to_regex
from grantlens.functions.rights import effective_allow, mask_text


def test_like_to_regex_translation():
    assert like_to_regex("a%b_c") == r"(?s)\Aa.*b.c\z"
    assert like_to_regex("[AB]%") == r"(?s)\A[AB].*\z"
    assert like_to_regex("[^a-c]x") == r"(?s)\A[^a-c]x\z"
    r = re.compile(like_to_regex("CORP\\[AB]dmin%").replace(r"\z", r"\Z"))  # Python's \Z is Java's \z
    assert r.match("CORP\\Admin1") and r.match("CORP\\Bdmin") and not r.match("CORP\\Cdmin")


def test_mask_text_and_effective_allow(spark):
    df = spark.createDataFrame([(33, 1), (0, None), (None, 2), (-2147483648, 0), (-1073741823, 0)], "a int, d int")
    got = df.select(mask_text("a").alias("m"), effective_allow(F.col("a"), F.col("d")).alias("e")).collect()
    assert [(r.m, r.e) for r in got] == [("0x00000021", 32), ("0x00000000", 0), (None, None), ("0x80000000", -2147483648), ("0xC0000001", -1073741823)]


def test_account_flags_decode(spark):
    uac = 0x0002 | 0x0200 | 0x1000000
    row = spark.createDataFrame([(uac,)], "u int").select(*flag_columns(F.col("u"))).collect()[0]
    on = {name for name, _ in ACCOUNT_FLAGS if row[name] == 1}
    assert on == {"ACCOUNTDISABLE", "NORMAL_ACCOUNT", "TRUSTED_TO_AUTH_FOR_DELEGATION"}
