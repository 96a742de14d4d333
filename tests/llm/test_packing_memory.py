"""Working memory of the tokenising pass."""

import tracemalloc

import pyarrow as pa

from regmesh.llm import packing
from regmesh.llm.textvec import blocks


def test_encoding_holds_arrays_of_a_small_block_only():
    """Several workers share an executor's memory, so one may hold few dozen MB beside its word table."""
    texts = pa.array([" ".join(f"w{(i * 7 + j) % 900}" for j in range(400)) for i in range(4000)])
    enc = packing.WordEncoder(packing.tokenizer_path())
    tracemalloc.start()
    try:
        for block in blocks(texts, packing.BLOCK_BYTES):
            enc.encode(block)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 30e6
    assert enc.known.key.nbytes + enc.known.at.nbytes + enc.known.len.nbytes <= 16 << 20
