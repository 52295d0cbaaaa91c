"""Words are encoded by their parts: the ids of the whole word, with few texts given to the tokenizer."""

import itertools
import random
import struct

import public_tokenizers

from themeloom.llm import packing


class Counted:
    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def _encoder():
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    encoder.tokenizer = Counted(encoder.tokenizer)
    return encoder


def test_words_in_other_case_and_marks_are_known_by_their_parts():
    encoder = _encoder()
    stems = ["".join(s) for s in itertools.product(["wo", "ra", "été"], ["lin", "ñor", "heit"], ["e", "us"])]
    shapes = ("{}", "{},", "({})", "{}.", "{}'s", "'{}'", "#{}!")
    words = {form(shape.format(s)).encode() for s in stems for shape in shapes for form in (str, str.title, str.upper)}
    found = encoder.learn(words)
    assert encoder.tokenizer.texts <= 2
    for word in words:
        want = encoder.tokenizer.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(found[word]) // 4}I", found[word])) == want


def test_odd_words_encode_like_the_library():
    encoder = _encoder()
    random.seed(3)
    letters = "aBcsStTrReEvVmMlLdD019.,!<|>#'éÉßÿ÷×µªİJ̌́ﬁ\x1c\x85漢🙂\x00"
    words = {"".join(random.choices(letters, k=random.randint(1, 7))).encode() for _ in range(20_000)}
    words |= {b"<|startoftext|>", b"<|STARTOFTEXT|>", b"a<|endoftext|>b", b"\xff\xfe"}
    words = {w for w in words if w.split() == [w]}
    found = encoder.learn(words)
    for word in words:
        want = encoder.tokenizer.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(found[word]) // 4}I", found[word])) == want
