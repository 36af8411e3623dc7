import gc
import weakref

import pandas as pd
import public_tokenizers
import pyarrow as pa

from tilewright.llm import jaccard_join, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
BATCH = pa.RecordBatch.from_pydict({"id": pa.array([1, 2], pa.int64()), "text": ["one two three", None]})


def pieces():
    return [x for b in packing.cut_batches(iter([BATCH]), PATH, 2, 4096, False) for x in b.to_pylist()]


def test_a_worker_keeps_its_tokenizer_until_it_does_other_work():
    first = pieces()
    held = weakref.ref(packing.chunk_tokenizer(PATH))
    assert pieces() == first and packing.chunk_tokenizer(PATH) is held()
    signed = [*jaccard_join.signed(iter([pd.Series(["one two three", None])]), 5, jaccard_join.Bands.of(80, 100))]
    gc.collect()
    assert held() is None and signed[0]["n"].tolist() == [1, 0]
    assert pieces() == first
