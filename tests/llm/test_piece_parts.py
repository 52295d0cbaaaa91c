"""Parts of texts for the sentence-piece encoder: cut where no piece reaches across, equal to the library."""

import itertools
import random

import public_tokenizers
import sentencepiece

from themeloom.llm.piece_encoding import Encoder, joined_letters

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_a_word_with_marks_is_the_same_part():
    own, library = Encoder(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    words = ["".join(p) for p in itertools.product(["quem", "ich", "été"], ["ador", "ñull", "heit"])]
    marks = [a + b for a in ",.;!?)" for b in ("", "\n", '"', "…")]
    text = " ".join(w + m for w in words for m in marks)
    assert own.encode(text, end=False) == library.encode(text)
    assert len(own.parts) <= len(words) + 2 * len(marks)


def test_no_piece_holds_characters_of_both_classes():
    pieces = list(Encoder(PATH).vocabulary.ids)
    letters = joined_letters(pieces)
    assert all(set(p.lstrip("▁")) <= letters or not set(p) & letters for p in pieces)
    assert joined_letters(["ab", "b-", "-;", "▁+", "▁x"]) == set("ab-;x")


def test_odd_texts_encode_and_decode_like_the_library():
    own, library = Encoder(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    random.seed(4)
    letters = "abcdeinrstABST  \n,.;-'\"()=<>/0123éßñÉ▁\t\r漢字🙂ж́\x00\x07 "
    for _ in range(3000):
        text = "".join(random.choices(letters, k=random.randint(0, 60)))
        ids = own.encode(text, end=False)
        assert ids == library.encode(text)
        assert own.decode(ids) == library.decode(ids)
    for _ in range(3000):
        ids = random.choices(range(300), k=random.randint(0, 6)) + random.choices(range(32_000), k=random.randint(0, 4))
        assert own.decode(ids) == library.decode(ids)
