from __future__ import annotations

import pyarrow as pa

from lectern.functions.arrow import by_bytes, flat_strings, lists_from, map_distinct


def test_batches_by_bytes_keep_every_row():
    texts = ["aaaa", None, "bbb", "c" * 50, "", "dd", None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(range(7))], ["t", "i"])
    parts = list(by_bytes(iter([batch, batch.slice(0, 0)]), "t", 8))
    assert [t for p in parts for t in p.column("t").to_pylist()] == texts
    assert all(sum(len(t or "") for t in p.column("t").to_pylist()) <= 8 or sum(bool(t) for t in p.column("t").to_pylist()) == 1 for p in parts)


def test_lists_round_trip():
    lists = pa.array([["a", None], None, [], ["b"]], pa.list_(pa.string()))
    flat, rows = flat_strings(lists)
    assert lists_from(flat, rows, 4).to_pylist() == [["a", None], [], [], ["b"]]
    assert map_distinct(flat, str.upper).to_pylist() == ["A", None, "B"]
