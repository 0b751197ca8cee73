import hashlib

from grantlens.llm.line_dedup import dedup_lines, op9_line_dedup
from llm_cases import EDGE, LOWER, SF, TWINS, docs

SPACE = "\x20\t\n\x0b\x0c\r"


def brute(rows):
    owner, where = {}, {}
    key = lambda line: line.strip(SPACE).translate(LOWER)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 10 and i is not None:
                owner[k] = min(owner.get(k, i), i)
                where.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10 or len(where[key(x)]) < 2 or owner[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


ROWS = [(5, "first shared line\nown line of five\n\nshort"), (2, "  FIRST shared LINE\t\nfirst shared line\nshort\nother"),
        (9, "first shared line\nsecond shared line"), (11, "second shared line\r\nlast own line\n"), (12, "second shared line"), (7, "ééééééééé\néééééééééé"), (8, "ééééééééé\néééééééééé")]


def test_lines_equal_brute_force(spark):
    for rows in (ROWS, EDGE, ROWS + EDGE + [(20 + i, "a line that all have\n" + str(i)) for i in range(30)]):
        for batches in (1, 4):
            got = [(r.doc_id, r.kept, r.n_lines, r.n_dropped) for r in dedup_lines(docs(spark, rows), batches).collect()]
            assert sorted(got, key=str) == brute(rows)


def test_digest_and_other_columns(spark):
    rows = {r.doc_id: r for r in dedup_lines(docs(spark, ROWS), digest=True, rest=("lang", "h1")).collect()}
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t, _, _ in brute(ROWS)}
    assert {i: r.kept for i, r in rows.items()} == want and rows[5].rest.lang == "en" and rows[5].rest.h1 == 1


def test_empty_table(spark):
    assert dedup_lines(docs(spark, ROWS).limit(0)).count() == 0


def test_registered_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.kept_sha256, r.n_lines, r.n_dropped) for r in op9_line_dedup(spark, SF).collect()), key=str)
    assert got == sorted(((i, hashlib.sha256(t.encode()).hexdigest(), n, k) for i, t, n, k in brute(rows)), key=str)


def test_lines_that_a_polynomial_confuses_stay(spark):
    rows = [(i + 1, t) for i, t in enumerate([*TWINS, TWINS[0]])]
    got = {r.doc_id: (r.kept, r.n_dropped) for r in dedup_lines(docs(spark, rows)).collect()}
    assert got == {i: (t, 0) if i < len(rows) else ("", 1) for i, t in rows}
