"""What a worker holds at once doesn't grow with the rows of an Arrow batch, nor with the distinct runs of a text."""

import numpy as np
import pyarrow as pa

from tracelet.llm import packing
from tracelet.llm.common import BATCH_ROWS, table
from tracelet.llm.queries import tokenizer_path

TEXTS = ["ab cd", None, "", "x" * 50, "é" * 30, "one two three four five", "y" * 7, None]


def batches(rows):
    ids = pa.array([*range(len(TEXTS) - 1), None], pa.int64())
    whole = pa.RecordBatch.from_arrays([ids, pa.array(TEXTS)], ["doc_id", "text"])
    return [whole.slice(a, rows) for a in range(0, len(TEXTS), rows)]


def test_groups_do_not_depend_on_the_batches(monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 20)
    found = [[b.to_pylist() for b in packing.regrouped(batches(rows))] for rows in (1, 3, 8)]
    assert found[0] == found[1] == found[2]
    assert [r for b in found[0] for r in b] == [r for b in batches(8) for r in b.to_pylist()]
    sizes = [sum(len((r["text"] or "").encode()) for r in b) for b in found[0]]
    assert len(sizes) == 4 and all(s >= 20 for s in sizes[:-1])
    assert list(packing.regrouped([])) == list(packing.regrouped(batches(8)[0].slice(0, 0) for _ in range(2))) == []


def test_encodings_held_at_once(monkeypatch):
    """Distinct runs that aren't letters: their encodings, which are much larger than their ids, are never all held."""
    runs = [f"{i}-{i * i}" for i in range(50)]
    toks = packing.Tokens(tokenizer_path())
    want = [np.array(toks.tokenizer.encode(r, add_special_tokens=False).ids, "<u4").tobytes() for r in runs]
    most, inner = [], toks.tokenizer

    class Counting:
        def encode_batch_fast(self, texts, **options):
            most.append(len(texts))
            return inner.encode_batch_fast(texts, **options)

    monkeypatch.setattr(packing, "AT_ONCE", 7, raising=False)
    toks.tokenizer = Counting()
    assert toks.runs(runs) == want
    assert max(most) <= 7


def test_batches_of_texts_are_small(spark):
    before = spark.conf.get(BATCH_ROWS)
    try:
        spark.conf.set(BATCH_ROWS, "10000")
        docs = table(spark, "/root/testdata/sf0.01", "documents").coalesce(1).select("doc_id", "text")

        def sizes(rows):
            for b in rows:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

        found = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
        assert sum(found) == docs.count() and max(found) <= 500
    finally:
        spark.conf.set(BATCH_ROWS, before)
