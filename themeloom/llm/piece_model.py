"""A merge-type piece vocabulary: the file's pieces, re-merging, and which adjacent pieces are compatible."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from sentencepiece import sentencepiece_model_pb2

from themeloom.llm.common import BoundedCache

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
PAIR_LIMIT = 400_000


@dataclass(frozen=True)
class Vocabulary:
    ids: dict[str, int]  # normal pieces
    scores: dict[str, float]
    pieces: tuple[str, ...]  # by id
    byte_ids: tuple[int, ...]
    control: frozenset[int]
    unknown: int
    end: int


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """Reads a model file. Only what the encoder reproduces is accepted: merge type, byte fallback, no rewriting of
    characters, a leading space, and pieces whose spaces all stand in front."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    trainer, normaliser = model.trainer_spec, model.normalizer_spec
    ids, scores, byte_ids, control, unknown = {}, {}, {}, set(), 0
    for k, piece in enumerate(model.pieces):
        if piece.type == NORMAL:
            ids[piece.piece], scores[piece.piece] = k, piece.score
        elif piece.type == BYTE:
            byte_ids[int(piece.piece[3:5], 16)] = k
        elif piece.type == CONTROL:
            control.add(k)
        elif piece.type == UNKNOWN:
            unknown = k
        else:
            raise ValueError(f"piece type {piece.type} is not supported")
    supported = (
        trainer.model_type == 2 and trainer.byte_fallback and len(byte_ids) == 256
        and not normaliser.precompiled_charsmap and normaliser.add_dummy_prefix and normaliser.escape_whitespaces
        and not normaliser.remove_extra_whitespaces and not trainer.treat_whitespace_as_suffix
        and all(SPACE not in p.lstrip(SPACE) for p in ids)
    )
    if not supported:
        raise ValueError(f"{path} is not a merge-type model with byte fallback and plain normalisation")
    return Vocabulary(
        ids, scores, tuple(p.piece for p in model.pieces), tuple(byte_ids[b] for b in range(256)), frozenset(control),
        unknown, trainer.eos_id,
    )


def remerge(vocabulary: Vocabulary, text: str) -> list[str]:
    """Merges a short string from its characters: best score first, leftmost among equals."""
    parts, scores = list(text), vocabulary.scores
    while len(parts) > 1:
        best, at = None, -1
        for k in range(len(parts) - 1):
            score = scores.get(parts[k] + parts[k + 1])
            if score is not None and (best is None or score > best):
                best, at = score, k
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Compatibility:
    """Whether merging the text of two adjacent pieces gives back those two, with a bounded memo."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.memo = BoundedCache(lambda pair: remerge(vocabulary, pair[0] + pair[1]) == [*pair], PAIR_LIMIT)

    def __call__(self, left: str, right: str) -> bool:
        return self.memo[left, right]


@lru_cache(maxsize=2)
def reachable(path: str) -> frozenset[str]:
    """The pieces that merging can produce from their own characters; others never occur in an encoding."""
    vocabulary = load(path)
    return frozenset(p for p in vocabulary.ids if len(p) == 1 or remerge(vocabulary, p) == [p])
