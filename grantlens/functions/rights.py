"""Access-mask decoding (bit tests and the rights-letter string)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rights letters with their mask bits, in the order they are
# printed (R W D L M A). The order is part of the output contract.
RIGHTS_LETTERS = (
    ("R", 1),
    ("W", 2),
    ("D", 4),
    ("L", 32),
    ("M", 8),
    ("A", 16),
)


def has_bit(mask: Column, bit: int) -> Column:
    """``(mask & bit) <> 0``; NULL when the mask is NULL."""
    return mask.bitwiseAND(F.lit(bit)) != 0


def rights_letters(mask: Column | str) -> Column:
    """Decode a rights mask into letters; a NULL or zero mask gives ''."""
    m = F.col(mask) if isinstance(mask, str) else mask
    parts = [F.when(has_bit(m, bit), F.lit(letter)).otherwise(F.lit("")) for letter, bit in RIGHTS_LETTERS]
    return F.concat(*parts)


def mask_text(mask: Column | str) -> Column:
    """Mask as fixed-width hexadecimal text, e.g. ``0x00000021``.

    Masks are 32 bits; one with the top bit set is a negative int and is read
    as unsigned (``0x80000000``).
    """
    m = F.col(mask) if isinstance(mask, str) else mask
    unsigned = m.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.concat(F.lit("0x"), F.lpad(F.hex(unsigned), 8, "0"))


def effective_allow(allow: Column, deny: Column) -> Column:
    """Deny wins over allow: ``allow & ~deny`` (a NULL deny counts as none)."""
    return allow.bitwiseAND(F.bitwise_not(F.coalesce(deny, F.lit(0))))
