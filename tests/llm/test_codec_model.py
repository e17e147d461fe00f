"""What the codec's model predicts, and what its checksums tell."""

from __future__ import annotations

import numpy as np
import pytest

from matchengine.llm import token_codec


def test_majority_id_is_predicted():
    """Order 0: half of the ids are one, the others cost 14 bits each."""
    rng = np.random.default_rng(5)
    ids = rng.integers(1 << 14, 1 << 15, 64 * token_codec.BLOCK_TOKENS).astype(np.uint32)
    ids[rng.random(len(ids)) < 0.5] = 30_001
    data = token_codec.encode_stripe(ids)
    assert (token_codec.decode_stripe(data) == ids).all()
    # The entropy is 8 bits; tables of 16,384 ids are the rest.
    assert 8 * len(data) / len(ids) < 9.2


def test_mismatched_model_is_noticed(monkeypatch):
    ids = np.random.default_rng(6).zipf(1.3, 6000).clip(0, 50_000).astype(np.uint32)
    data = token_codec.encode_stripe(ids)
    coded = token_codec._decode_blocks
    monkeypatch.setattr(token_codec, "_decode_blocks", lambda *a: np.abs(coded(*a) - 1))
    with pytest.raises(ValueError):
        token_codec.decode_stripe(data)


def test_any_ids():
    rng = np.random.default_rng(7)
    for ids in (rng.integers(0, 1 << 32, 5000), rng.integers(0, 1 << 24, 5000), np.full(3000, 2**32 - 1), np.arange(70_000), np.zeros(1)):
        ids = ids.astype(np.uint32)
        assert (token_codec.decode_stripe(token_codec.encode_stripe(ids)) == ids).all()


def test_damage_is_noticed():
    ids = np.random.default_rng(8).zipf(1.2, 6000).clip(0, 50_000).astype(np.uint32)
    data = token_codec.encode_stripe(ids)
    for at in (40, len(data) // 2, len(data) - 5):
        broken = bytearray(data)
        broken[at] ^= 64
        with pytest.raises(ValueError):
            token_codec.decode_stripe(bytes(broken))


def test_contexts_predict():
    """Ids that follow from the one or two before cost little, whatever their share."""
    rng = np.random.default_rng(9)
    chain = rng.permutation(4000)
    starts = rng.integers(0, 4000, 40_000)
    ids = np.stack([starts, chain[starts], chain[chain[starts]]], axis=1).ravel().astype(np.uint32)
    # 12 bits choose a start; whether an id goes on as the last time costs 0.9 an
    # id, and 4,000 followers are listed. Without contexts it is 12 bits an id.
    bits = 8 * len(token_codec.encode_stripe(ids))
    assert bits < (12 + 3 * 0.95) * len(starts) + 8 * 16_000 < 0.6 * 12 * len(ids)


def test_tokens_of_text_cost_less_than_deflate():
    import zlib

    import pyarrow.parquet as pq

    from matchengine.llm import textvec, tokens

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0)
    ids, _ = tokens.encoder(tokens.tokenizer_path("byte_bpe_50k.json")).encode(*textvec.buffers(texts))
    ids = ids.astype(np.uint32)
    coded = token_codec.encode_stripe(ids)
    print(f"{8 * len(coded) / len(ids):.2f} bits an id, deflate {8 * len(zlib.compress(ids.astype('<u2').tobytes(), 9)) / len(ids):.2f}")
    assert len(coded) < len(zlib.compress(ids.astype("<u2").tobytes(), 9))
    assert (token_codec.decode_stripe(coded) == ids).all()
