import pytest
from pyspark.sql import functions as F

from lanternfish.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def found(spark):
    return queries.QUERIES["op8_toxicity"](spark, SF).cache()


def test_one_row_each(spark, found):
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert found.where("score is null or not score between 0 and 1 or predicted != cast(score >= 0.7 as int)").count() == 0


def test_held_out_accuracy(spark, found):
    """All held-out rows of every language, those without any abuse too."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = found.where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    n = {(r.lang, r.toxic, r.predicted): r["count"] for r in known.groupBy("lang", "toxic", "predicted").count().collect()}
    hit, missed, wrong = (sum(x for (_, t, p), x in n.items() if (t, p) == k) for k in ((1, 1), (1, 0), (0, 1)))
    assert hit >= 0.85 * (hit + missed)
    assert hit >= 0.95 * (hit + wrong)
    for lang in ("en", "de", "fr", "es"):
        assert n[lang, 1, 1] >= 0.75 * (n[lang, 1, 1] + n.get((lang, 1, 0), 0))


def test_labels_of_held_out_rows_are_not_used(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(toxicity.training_row(), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.score(docs, x).collect()} for x in (labels, other))
    assert a == b


def test_edges(spark):
    docs = spark.createDataFrame([(i, "you scum" if i % 2 else "good day", "x") for i in range(400)] + [(1, "you scum", "x"), (500, None, "x"), (501, "", "x"), (None, "..", None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(3, 1), (7, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == 404
    assert all((r.score >= 0.7) == (r.text == "you scum") for r in rows)
    assert len({r.score for r in rows if not r.text or r.text == ".."}) == 1
    assert {r.score for r in toxicity.score(docs, labels.where("toxic = 1")).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), labels.limit(0)).count() == 0
