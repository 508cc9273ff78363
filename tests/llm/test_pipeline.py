import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framequarry.llm import queries as Q


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), name)
        assert docs.columns == columns
        kept = docs.count()
        assert kept <= n if name != "mixing" else 0 < kept <= 2 * n
        if name == "exact_dedup":
            assert docs.select("text").distinct().count() == kept
        n = kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == n and last.filter("not round_trip").count() == 0


def test_stages_on_awkward_rows(spark, sf):
    """Nulls, repeated rows, ties, empty and long texts, clashing names; each stage by what it must keep."""
    a, b, long = "a b c d e f g h", "one two three four five", " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, a, "x"), (2, a, "x"), (2, a, "x"), (None, a, None), (None, "p q r s t u", None), (None, "p q r s t u", "y"), (5, None, "x"), (6, "", "y"), (7, b, None), (8, b + " ", "y"), (9, long, "x"), (10, long + " end", "x"), (None, long + " other end", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("row", "text_hash", "gone_id", "kept", "copies", "score"):
        docs = docs.withColumn(name, F.lit(1))
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    keep = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    for source in (docs, docs.limit(0)):
        one = stages["toxicity"](spark, source, sf)
        assert one.columns == columns and keep(one) == keep(source)
        two = corpus_pipeline.materialise(stages["exact_dedup"](spark, one, sf), "t")
        assert two.columns == columns
        three = corpus_pipeline.materialise(stages["near_dedup"](spark, two, sf), "t")
        assert three.columns == columns
        four = corpus_pipeline.materialise(stages["mixing"](spark, three, sf), "t")
        assert four.columns == columns
        five = stages["sentencepiece"](spark, four, sf)
        if source is docs:
            assert keep(two) == sorted([(2, a), (None, "p q r s t u"), (6, ""), (7, b), (8, b + " "), (9, long), (10, long + " end"), (None, long + " other end")], key=str)
            assert keep(three) == sorted([(2, a), (None, "p q r s t u"), (6, ""), (7, b), (9, long)], key=str)
            assert set(keep(four)) <= {x for x in keep(three) if x[1]} and max(map(keep(four).count, keep(four))) <= 2
            assert sorted(r.round_trip for r in five.collect()) == [True] * four.count()
        else:
            assert five.collect() == []


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_queries_agree_with_sql(spark, sf, name):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = db.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    rows = {tuple(r) for r in want.fetchall()}
    got = {tuple(r[c] for c in columns) for r in Q.queries()[name](spark, sf).collect()}
    assert got == rows
