import base64
import re

import pytest

from lanternfish.plans import catalogue

TEXTS = [None, "", "short", "x" * 60, "y" * 90, "z" * 600, "é" * 1200, "w" * 2000, "see image_data here", "a" * 60000, "b" * 204800, "c" * 600000]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    docs = [(doc, text) for i, text in enumerate(TEXTS) for doc in (50 * i, 50 * i + 7)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    texts = ["plain words", "", 'now {"name": "open", "parameters": {"q": "r"}}', '```json\n{"name": "show", "parameters": {"a": "b"}}\n```', "a { b", "odd ``` fence"]
    turns = [(c, t, "user" if t % 2 else "model", x) for c in range(10) for t, x in enumerate(texts)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def rows(spark, sf, name):
    return sorted(map(tuple, catalogue.QUERIES[name](spark, sf).collect()), key=str)


def docs():
    return [(doc, text) for i, text in enumerate(TEXTS) for doc in (50 * i, 50 * i + 7)]


def test_base64_runs(spark, sf):
    def one(text):
        if text is None:
            return None, None
        p = base64.b64encode(text.encode()).decode()
        runs = re.findall("[A-Za-z0-9+/]{100,}={0,2}", p)
        return max(runs, key=len, default=None), p[:2000] + "...[truncated]" if len(p) > 2000 else re.sub("[A-Za-z0-9+/]{100,}={0,2}", "[IMAGE_DATA]", p)

    assert rows(spark, sf, "base64_runs") == sorted(((d, *one(t)) for d, t in docs()), key=str)


def test_image_geometry(spark, sf):
    found = {r.doc_id: (r.side, r.width) for r in catalogue.QUERIES["image_geometry"](spark, sf).collect()}
    assert set(found) == {d for d, _ in docs()}
    for d, t in docs():
        n = len((t or "").encode())
        if t is not None:
            assert found[d][0] == (200 if n < 51200 else 400 if n < 204800 else 600 if n < 512000 else 800)
        assert found[d][1] == round(896 * max(1, (d % 50 + 60) / 60), 6)
    assert {s for s, _ in found.values()} >= {200, 400, 600, 800}


def test_image_prompts(spark, sf):
    told = lambda d: "Error: e. " if d % 2 == 0 else ""
    want = [(d, None if t is None else f"User provided an image but it could not be processed properly. {told(d)}Please respond to the following text only: {t}", 2) for d, t in docs()]
    assert rows(spark, sf, "image_prompts") == sorted(want, key=str)


def test_definitely_text(spark, sf):
    """A call of the function family begins with neither brace, fence nor tool mark, so without a family it is text."""
    want = [(c, t, c % 5 in (3, 4)) for c in range(10) for t in range(6)]
    assert rows(spark, sf, "definitely_text") == sorted(want, key=str)


def test_stream_fold(spark, sf):
    found = {r.stream_id: r for r in catalogue.QUERIES["stream_fold"](spark, sf).collect()}
    assert len(found) == 50  # an empty text without a call has no tokens
    for c in range(10):
        assert (found[f"{c}-0"].call, found[f"{c}-0"].text) == ("show", "plain words")
        assert (found[f"{c}-2"].call, found[f"{c}-2"].text) == ("open", "now ")
        assert found[f"{c}-4"].result == found[f"{c}-4"].text == "a { b"
        assert found[f"{c}-5"].result == found[f"{c}-5"].text == "odd ``` fence"
