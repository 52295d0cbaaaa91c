"""Piece encoding of long texts without a space against the library."""

import random

import public_tokenizers
import sentencepiece

from themeloom.llm.piece_encoding import encoder


def test_long_text_without_spaces_equals_the_library():
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    draw = random.Random(3)
    text = "".join(draw.choice("abcdetheinrsß☃") for _ in range(200_000))
    assert encoder(path).encode(text) == sentencepiece.SentencePieceProcessor(model_file=path).encode(text, add_eos=True)
