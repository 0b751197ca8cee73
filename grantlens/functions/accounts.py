"""Account-control flags decoded from a userAccountControl bit mask."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The twenty account-control flag columns with their
# userAccountControl bits (public directory-service constants), in the
# column order of the user and computer inventories.
ACCOUNT_FLAGS = (
    ("ACCOUNTDISABLE", 0x0002),
    ("HOMEDIR_REQUIRED", 0x0008),
    ("LOCKOUT", 0x0010),
    ("PASSWD_NOTREQD", 0x0020),
    ("PASSWD_CANT_CHANGE", 0x0040),
    ("ENCRYPTED_TEXT_PWD_ALLOWED", 0x0080),
    ("TEMP_DUPLICATE_ACCOUNT", 0x0100),
    ("NORMAL_ACCOUNT", 0x0200),
    ("INTERDOMAIN_TRUST_ACCOUNT", 0x0800),
    ("WORKSTATION_TRUST_ACCOUNT", 0x1000),
    ("SERVER_TRUST_ACCOUNT", 0x2000),
    ("DONT_EXPIRE_PASSWORD", 0x10000),
    ("MNS_LOGON_ACCOUNT", 0x20000),
    ("SMARTCARD_REQUIRED", 0x40000),
    ("TRUSTED_FOR_DELEGATION", 0x80000),
    ("NOT_DELEGATED", 0x100000),
    ("USE_DES_KEY_ONLY", 0x200000),
    ("DONT_REQ_PREAUTH", 0x400000),
    ("PASSWORD_EXPIRED", 0x800000),
    ("TRUSTED_TO_AUTH_FOR_DELEGATION", 0x1000000),
)

# Filter parameter stem -> flag column, as the user and
# computer tools name them.
FLAG_PARAMS = {
    "account_disabled": "ACCOUNTDISABLE",
    "homedir_required": "HOMEDIR_REQUIRED",
    "lockout": "LOCKOUT",
    "passwd_notreqd": "PASSWD_NOTREQD",
    "passwd_cant_change": "PASSWD_CANT_CHANGE",
    "encrypted_pwd_allowed": "ENCRYPTED_TEXT_PWD_ALLOWED",
    "temp_duplicate": "TEMP_DUPLICATE_ACCOUNT",
    "normal_account": "NORMAL_ACCOUNT",
    "interdomain_trust": "INTERDOMAIN_TRUST_ACCOUNT",
    "workstation_trust": "WORKSTATION_TRUST_ACCOUNT",
    "server_trust": "SERVER_TRUST_ACCOUNT",
    "dont_expire_pwd": "DONT_EXPIRE_PASSWORD",
    "mns_logon": "MNS_LOGON_ACCOUNT",
    "smartcard_required": "SMARTCARD_REQUIRED",
    "trusted_for_delegation": "TRUSTED_FOR_DELEGATION",
    "not_delegated": "NOT_DELEGATED",
    "use_des_key": "USE_DES_KEY_ONLY",
    "dont_req_preauth": "DONT_REQ_PREAUTH",
    "password_expired": "PASSWORD_EXPIRED",
    "auth_for_delegation": "TRUSTED_TO_AUTH_FOR_DELEGATION",
}


def flag_columns(uac: Column) -> list[Column]:
    """One 0/1 integer column per account flag, named after the flag."""
    return [uac.bitwiseAND(F.lit(bit)).__ne__(0).cast("int").alias(name) for name, bit in ACCOUNT_FLAGS]
