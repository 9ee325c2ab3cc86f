"""Packing of many short texts."""

from test_tokens import BPE

from sievewright.llm import packing


def test_short_texts_fill_sequences(spark):
    """Empty texts are the end id alone: 4096 fit in a sequence, not 256."""
    docs = spark.createDataFrame([(i, "" if i % 4 else "one two") for i in range(12000)], "doc_id long, text string")
    pieces = packing.pack(docs, BPE).collect()
    assert sorted(p.doc_id for p in pieces) == list(range(12000))
    ends = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == ends.get(p.sequence_id, 0)
        ends[p.sequence_id] = p.offset + p.length
    assert max(ends.values()) <= 4096
    assert len(ends) <= sum(p.length for p in pieces) // 4096 + 2


def test_bundles_waste_little():
    for step, capacity in ((16, 4096), (4, 256)):
        for length in range(1, packing.SHORT * step + 1):
            each, steps = packing.bundle(length, step, capacity)
            assert each >= 1 and each * length <= steps * step <= capacity
            assert 16 * each * length >= 15 * steps * step
