"""A SentencePiece model file as bytes and as a table of pieces."""
from __future__ import annotations

import functools

SPACE = "▁"
DEFAULT_MODEL = "piece_bpe_32k.model"


def model_bytes(path: str | None = None) -> bytes:
    """The model's bytes, read on the driver (a tokenizer file, not data; under 1 MB). ``path``:
    a local file; by default the 32k piece model of the installed public tokenizers."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(DEFAULT_MODEL)
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(maxsize=2)
def processor(model: bytes):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def splits_at_spaces(sp) -> bool:
    """Whether every stretch of spaces with the word behind it is segmented on its own: no piece
    has a space behind another character, and the normaliser changes nothing but spaces."""
    if any(SPACE in sp.id_to_piece(i).lstrip(SPACE) for i in range(sp.get_piece_size())):
        return False
    return all(sp.decode(sp.encode(x)) == x for x in ("a  b", " a", "a ", "\ufb01 x", "e\u0301", "\u00bd \u2460 \uff71"))
