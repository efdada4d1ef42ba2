"""Workers give freed memory back and pass every batch on."""

import pyarrow as pa

from voxelloom.llm.memory import tidy


def test_tidy_passes_all_batches():
    rows = [pa.RecordBatch.from_pydict({"a": [i, i + 1]}) for i in range(3)]

    def twice(batches):
        for b in batches:
            yield b
            yield b

    assert [b.column(0).to_pylist() for b in tidy(twice)(iter(rows))] == [[i, i + 1] for i in range(3) for _ in (0, 1)]
    assert list(tidy(twice)(iter([]))) == []
