"""Memos of fixed size: whatever they forget, results stay."""

import struct

import public_tokenizers
import pytest

from themeloom.llm import packing
from themeloom.llm.common import BoundedCache


def test_cache_stays_bounded_and_keeps_words_met_again():
    computed = []
    cache = BoundedCache(lambda k: computed.append(k) or k * 2, 3)
    for k in range(20):
        assert cache[k] == 2 * k
        assert cache[-1] == -2
        assert len(cache) <= 3 and len(cache.older) <= 3
    assert computed.count(-1) == 1


@pytest.mark.parametrize("size", [1, 2, 300_000])
def test_words_encode_like_whole_texts_whatever_the_memo_holds(monkeypatch, size):
    monkeypatch.setattr(packing, "MEMO_WORDS", size)
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", " \t\n", "Plain words, it's 12", "été naïve\x1cjoined\x85lines", "á b́", "plain words again\r\n\x0b\x0c ok", "🙂🙂 x"]
    for text in texts * 2:
        words = text.encode().split()
        ids_of = encoder.learn(set(words))
        ids = b"".join(ids_of[w] for w in words)
        whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == whole
