"""Functions over Arrow batches hold the Python copies of few rows, and no token ids that they don't use."""

import sys
import types

import numpy as np
import pyarrow as pa

from brindle.llm import common, packing, quality


def test_slices_hold_all_rows_in_order():
    batches = [pa.RecordBatch.from_pydict({"i": list(range(a, b))}) for a, b in ((0, 2500), (2500, 2500), (2500, 2501))]
    got = list(common.slices(iter(batches)))
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(2501))
    assert max(b.num_rows for b in got) == common.SLICE_ROWS


class Rows:
    """Stands for a DataFrame: keeps the function that would run on it."""

    columns, schema = ["doc_id", "text"], None

    def mapInArrow(self, f, schema):  # noqa: N802
        self.f = f
        return self


def a_batch(n):
    return pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "text": [f"some words of row {i}" if i % 7 else None for i in range(n)]})


def test_the_quality_filter_works_on_few_rows_and_forgets_token_ids(monkeypatch):
    layers = np.zeros((2 * quality.DIM + 8, quality.HIDDEN)), np.zeros(quality.HIDDEN), np.zeros(quality.HIDDEN), 30.0
    model = quality.Model(np.zeros((quality.BUCKETS, quality.DIM), np.float32), np.zeros(2 * quality.DIM + 8), np.ones(2 * quality.DIM + 8), layers)
    monkeypatch.setitem(sys.modules, "_brindle_pieces", types.ModuleType("_brindle_pieces"))
    got = list(quality.keep_good(Rows(), model).f(iter([a_batch(4100)])))
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(4100))
    assert max(b.num_rows for b in got) <= common.SLICE_ROWS and "_brindle_pieces" not in sys.modules


def test_pieces_leave_in_small_batches(monkeypatch):
    monkeypatch.setattr(packing, "with_id", lambda *_: None)
    rows = pa.RecordBatch.from_pydict({"id": list(range(2100)), "text": [f"row {i}" for i in range(2100)]})
    got = list(packing.cut_pieces(Rows(), packing.BYTE_TOKENIZER, 2, 1024, keep_ids=True).f(iter([rows])))
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(2100)) and max(b.num_rows for b in got) <= common.SLICE_ROWS
