"""What a Python worker holds while it encodes, which the pipeline's packing stage failed by (round 3)."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa

from tracewell.llm.tokens import Encoder, vocabulary


def test_encoding_a_large_batch_takes_a_bounded_multiple_of_its_ids():
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(3000)]
    texts = pa.array([" ".join(rng.choices(words, k=1000)) for _ in range(1200)])
    e = Encoder(vocabulary("byte_bpe_50k.json"))
    tracemalloc.start()
    ids, _ = e.encode_all(texts, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts.nbytes > 7_000_000
    assert peak < 4 * ids.nbytes
