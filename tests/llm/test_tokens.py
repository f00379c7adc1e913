import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewatch.llm.packing import packing_digest, padded_length
from tidewatch.llm.token_files import pack, token_digest, unpack


def encoded(name, rows, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return {k: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4") for k, t in rows}


@pytest.mark.parametrize("which", ["docs", "edge_docs"])
def test_token_file_round_trip(spark, request, which):
    df = request.getfixturevalue(which)
    ids = encoded("byte_bpe_50k.json", [tuple(r) for r in df.select("doc_id", "text").collect()], 2)
    got = {r.doc_id: tuple(r)[1:] for r in token_digest(spark, df).collect()}
    want, at = {}, 0
    for k in sorted(ids):
        want[k], at = (at, len(ids[k]), zlib.crc32(ids[k].tobytes())), at + len(ids[k])
    assert got == want


@pytest.mark.parametrize("which", ["docs", "edge_docs"])
def test_packing_keeps_every_id_once(request, which):
    df = request.getfixturevalue(which)
    ids = encoded("word_bpe_49k.json", [tuple(r) for r in df.select("doc_id", "text").collect()], 1)
    rows = packing_digest(df).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for groups, total in ((by_doc, {k: len(v) for k, v in ids.items()}), (by_sequence, {})):
        for k, pieces in groups.items():
            at = 0
            for start, length in sorted(pieces):
                assert start == at and length > 0
                at += length
            assert at == total.get(k, at) and (groups is by_doc or at <= 2048)
    assert len(by_doc) == len(ids)
    assert len(by_sequence) == -(-sum(map(len, ids.values())) // 2048)


def test_empty_tables(spark, no_docs):
    assert token_digest(spark, no_docs).count() == 0
    assert packing_digest(no_docs).count() == 0


def test_padding():
    assert [padded_length(n, 2048) for n in (1, 2, 3, 1000, 1025, 2048)] == [1, 2, 4, 1024, 2048, 2048]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_blocks(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_000, n), rng.zipf(1.3, n).clip(max=2**32 - 1), np.full(n, 7), np.where(rng.random(n) < 0.02, 2**32 - 1, 3)):
        ids = ids.astype(np.uint32)
        assert np.array_equal(unpack(pack(ids)), ids)


def test_packing_hands_on_a_few_texts_at_a_time(spark, monkeypatch):
    """A task holds copies of some texts, not of ten thousand: the tokenizer never gets more than a slice's or a batch's bytes."""
    from tidewatch.llm import packing
    from tidewatch.sources import scratch

    monkeypatch.setattr(scratch, "BATCH", 1 << 16)
    monkeypatch.setattr(packing, "SLICE", 1 << 12)
    seen = spark.sparkContext.accumulator(0)

    class Watched:
        def __init__(self, inner):
            self.tokenizer, self._inner = inner.tokenizer, inner

        def encode(self, texts):
            seen.add(int(texts.nbytes > 1 << 13))
            return self._inner.encode(texts)

    inner = packing.encoder
    monkeypatch.setattr(packing, "encoder", lambda name: Watched(inner(name)))
    df = spark.createDataFrame([(i, f"some words of text {i} " * 20) for i in range(400)], "doc_id long, text string").repartition(1)
    rows = packing_digest(df).collect()
    assert {r.doc_id for r in rows} == set(range(400)) and sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())
    assert seen.value == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None
