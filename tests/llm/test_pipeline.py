import corpus_pipeline as P
import __spark_entry__ as E
from grantlens.llm.queries import ORACLE, QUERIES
from llm_cases import EDGE, docs
from test_line_dedup import brute as brute_lines
from test_ngram_join import brute as brute_classes
from test_search import plain
from tokenizers import Tokenizer

MID = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, len(QUERIES) + 1)]
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding"]


def test_stages_against_brute_force(spark):
    read = spark.read.parquet(f"{MID}/documents.parquet")
    given = {r.doc_id: r for r in read.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    stages = dict(P.STAGES)
    one = stages["quality classifier"](spark, read, MID)
    assert one.columns == COLUMNS
    kept = {r.doc_id: r for r in one.collect()}
    assert all(kept[i] == given[i] for i in kept)
    assert sum(i in kept for i, q in labels.items() if q == 1) >= 0.99 * sum(q == 1 for q in labels.values())
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 0.1 * sum(q == 0 for q in labels.values())
    one = spark.createDataFrame(list(kept.values()), read.schema)
    two = stages["line dedup"](spark, one, MID)
    assert two.columns == COLUMNS
    lines = {r.doc_id: r for r in two.collect()}
    want = {i: t for i, t, _, _ in brute_lines([(i, r.text) for i, r in kept.items()])}
    assert {i: r.text for i, r in lines.items()} == want and all(r.n_chars == len(r.text) and r.lang == kept[i].lang for i, r in lines.items())
    two = spark.createDataFrame(list(lines.values()), read.schema)
    three = stages["n-gram Jaccard join"](spark, two, MID)
    assert three.columns == COLUMNS
    single = {r.doc_id: r for r in three.collect()}
    assert set(single) == {i for i, (_, c) in brute_classes([(i, r.text) for i, r in lines.items()], 5, 80).items() if c == i}
    three = spark.createDataFrame(list(single.values()), read.schema)
    four = stages["benchmark decontamination"](spark, three, MID)
    assert four.columns == COLUMNS
    clean = {r.doc_id: r for r in four.collect()}
    items = [plain(r.text) for r in spark.read.parquet(f"{MID}/benchmark.parquet").collect()]
    assert set(clean) == {i for i, r in single.items() if not any(x in plain(r.text) for x in items)}
    five = stages["BPE encoding"](spark, spark.createDataFrame(list(clean.values()), read.schema), MID).collect()
    t = Tokenizer.from_file(P.default_vocabulary())
    assert {r.doc_id: r.ids for r in five} == {i: t.encode(r.text, add_special_tokens=False).ids for i, r in clean.items()}
    assert all(r.n_tokens == len(r.ids) for r in five)


def test_stages_take_edge_rows(spark):
    table = docs(spark, EDGE).select(*COLUMNS)
    for name, stage in P.STAGES[1:]:
        assert stage(spark, table, MID).count() > 0 and stage(spark, table.limit(0), MID).count() == 0, name
