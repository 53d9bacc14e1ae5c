"""What a task's Python holds does not grow with its batch, and what is found does not depend on batches."""

import tracemalloc

import numpy as np
import pyarrow as pa

from textassay.operators import pages, paragraphs
from textassay.plans import native


def peak(run) -> float:
    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


def vectors(ids, x) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(x), pa.list_(pa.float32()))], ["vec_id", "embedding"])


def test_neighbours_of_a_large_batch_take_little_memory():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(10_000, 16)).astype(np.float32)
    batch, names = vectors(np.arange(10_000), x), np.arange(1024) * 100
    assert peak(lambda: list(native._nearest(names, x[:1024].astype(np.float64), [batch]))) < 60


def test_equal_vectors_are_taken_by_id_whatever_their_order():
    x = np.ones((2000, 4), np.float32)
    ids = np.arange(2000)[::-1].copy()
    halves = [vectors(ids[:700], x[:700]), vectors(ids[700:], x[700:])]
    found = list(native._nearest(np.array([100]), x[:1].astype(np.float64), halves))
    assert sorted(r["vec_id"] for b in found for r in b.to_pylist()) == [0, 1, 2, 3, 4]


def test_trees_of_pages_are_not_held_together():
    page = "<html><title>A title</title><body>" + "<div><p>Some words of a page.</p></div>" * 200 + "</body></html>"
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([page] * 300)], ["page_id", "html"])
    found = []
    assert peak(lambda: found.extend(pages._extracted(batch))) < 20
    rows = [r for b in found for r in b.to_pylist()]
    assert [r["page_id"] for r in rows] == list(range(300)) and {r["title"] for r in rows} == {"A title"} and {r["text"] for r in rows} == {pages.Tree(page).text()}


def test_anchors_of_many_paragraphs_equal_those_by_definition(spark, monkeypatch):
    def anchor(text, p):
        return next((p[:m] for m in range(22, 9, -1) if m <= len(p) and len(text) - len(text.replace(p[:m], "")) == m), p[:10])

    texts = ["\n".join(["aaaaaaaaaaaaaaaaaaaaaaaaaaaa", " The same line again and again", "The same line again and once", "short", "exactly10!", "abababababababababababababab", "The same line again and again\u3000", "é" * 23]), "", "\n \n", "one"]
    want = {(k, i, anchor(t, p)) for k, t in enumerate(texts) for i, p in enumerate([q for q in (x.strip(" \t\n\r\f\u3000\u00a0") for x in t.split("\n")) if q], 1)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string")
    assert {tuple(r) for r in paragraphs.anchors(docs).collect()} == want
    for text in texts:  # both ways of counting
        tops = [p[:22] for p in text.split("\n") if len(p) >= 10]
        few = paragraphs._once(text, tops)
        with monkeypatch.context() as m:
            m.setattr(paragraphs, "SEARCHED", 0)
            assert paragraphs._once(text, tops) == few


def test_state_of_clamped_steps_comes_with_the_rows():
    import pandas as pd

    from textassay.streaming import stateful

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    state, rows = State(), pd.DataFrame({"user_id": [7] * 4, "dim": ["x"] * 4, "id": [2, 1, 3, 4], "step": [-0.9, 0.9, 0.9, 0.9], "t": [1.0, 1.0, 2.0, 3.0]})
    first = list(stateful.clamp_steps(("k",), iter([rows[:2], rows[2:]]), state))
    assert first[0].to_dict("records") == [{"user_id": 7, "dim": "x", "x": 1.0, "n": 4}]
    assert list(stateful.clamp_steps(("k",), iter([rows[:1]]), state))[0]["n"].tolist() == [5] and abs(state.get[0] - 0.1) < 1e-9
