"""Packing's encoder remembers fewer chunks than others do, and works on smaller portions."""

import public_tokenizers
import pyarrow as pa

from millrace.llm import encoding, packing
from tests.llm.test_operators import docs_of


def test_packing_encodes_small_portions_with_a_small_memory(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = encoding.encoder(path, "leading", 40)
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{i}x{k}" for k in range(60)) for i in range(20)])], names=["text"])
    for part in encoding.portions(batch, 0, 1):
        whole = own.tokenizer.encode(part.column(0)[0].as_py(), add_special_tokens=False).ids
        assert own.encode(part.column(0))[0].tolist() == whole and len(own.index) <= 40 + 60
    assert packing.KEPT < encoding.CHUNKS_KEPT
    long = "word " * 500_000
    pieces = packing.pack_documents(docs_of(spark, [(1, long), (2, long)]), path, end_id=0, spaces="leading").collect()
    n = len(own.tokenizer.encode(long, add_special_tokens=False).ids) + 1
    assert {r.doc_tokens for r in pieces} == {n} and sum(r.length for r in pieces) == 2 * n
