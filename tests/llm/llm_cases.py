"""Small tables shared by the operators' tests: edge rows, an empty table, words without a library."""

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 8000
# Extra columns carry names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, node long, rest string, h1 long, component long"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def held(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds == 0


def docs(spark, rows):
    """rows of (doc_id, text) or (doc_id, text, lang)"""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), 0.5, 1, 1, "x", 1, 1) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


EDGE = [(1, None), (2, ""), (3, "  \t\n "), (None, "a text without an id here"), (4, "one"), (5, "same row twice in here"), (5, "same row twice in here"),
        (6, "Same ROW twice in here"), (7, LONG), (8, LONG + "x"), (9, "tail\x00nul \U0001F600 é   wide"), (-3, "negative ids count too")]


def thue_morse(n):
    """Two texts of n letters that sums of letters times powers of one number modulo 2^64 cannot tell apart."""
    text, other = "a", "b"
    while len(text) < n:
        text, other = text + other, other + text
    return text, other


TWINS = [w for n in (1 << 10, 1 << 11, 1 << 12, 1 << 13) for w in thue_morse(n)]
