"""Column-level helpers: all built from pyspark.sql.functions (JVM side)."""

from grantlens.functions.accounts import ACCOUNT_FLAGS, FLAG_PARAMS, flag_columns
from grantlens.functions.fingerprint import fingerprint
from grantlens.functions.like import like, like_to_regex
from grantlens.functions.rights import effective_allow, has_bit, mask_text, rights_letters

__all__ = [
    "ACCOUNT_FLAGS", "FLAG_PARAMS", "flag_columns", "fingerprint", "like", "like_to_regex",
    "effective_allow", "has_bit", "mask_text", "rights_letters",
]
