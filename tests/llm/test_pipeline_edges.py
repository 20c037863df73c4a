import pytest

import corpus_pipeline
from lanternfish import session
from lanternfish.llm import toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_chars int, score string, predicted string, n_words string, hit_spans string, line int, rep string, `a b` int, label string, version int"
EXTRA = (5, "s", "p", "w", "h", 3, "r", 4, "l", 6)


def rows(spark):
    item = next(r.text for r in session.table(spark, SF, "benchmark").collect() if r.text and len(r.text.split()) > 12)
    copy = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    texts = [(1, None), (2, ""), (3, "plain text"), (3, "plain text"), (None, "no id"), (None, None), (4, copy), (5, copy), (6, copy + " more"), (7, f"Before. {item} After."), (8, "\n\n"), (9, "x" * 300_000), (10, "Share this line now\n" + copy[:100]), (11, "Share this line now\nown"), (12, "Share this line now")]
    return [(d, t, *EXTRA) for d, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(spark), SCHEMA)


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_and_empty_tables(spark, docs, name):
    out = stage(name)(spark, docs, SF)
    assert out.dtypes == docs.dtypes
    assert {tuple(r)[3:] for r in out.collect()} == {EXTRA[1:]}
    assert stage(name)(spark, docs.limit(0), SF).count() == 0


def test_toxicity(spark, docs):
    model = toxicity.score(docs.select("doc_id", "text"), session.table(spark, SF, "labels"))
    assert kept(stage("toxicity")(spark, docs, SF)) == kept(model.where("predicted = 0"))


def test_line_dedup(spark, docs):
    found = dict(kept(stage("line_dedup")(spark, docs, SF)))
    assert (found[10].split("\n")[0], found[11], found[12]) == ("Share this line now", "own", "")
    assert len(kept(stage("line_dedup")(spark, docs, SF))) == docs.count()


def test_ngram_join(spark, docs):
    gone = {5, 6}
    assert kept(stage("ngram_join")(spark, docs, SF)) == sorted(((r[0], r[1]) for r in rows(spark) if r[0] not in gone), key=str)


def test_decontaminate(spark, docs):
    out = stage("decontaminate")(spark, docs, SF)
    found = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    assert found[7].text.split()[0] == "Before." and len(found[7].text) < 40 and found[7].n_chars == len(found[7].text)
    assert [x for x in kept(out) if x[0] != 7] == sorted(((r[0], r[1]) for r in rows(spark) if r[0] != 7), key=str)


def test_tokens(spark, docs):
    out = stage("byte_bpe")(spark, docs, SF).collect()
    assert len(out) == len(rows(spark))
    assert all((r.n_tokens == 0) == (not r.text) for r in out)
