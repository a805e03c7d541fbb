"""Cutting texts where no pre-token can cross, and the encoders that use it.

In the pattern of the byte-level vocabularies every alternative is blanks only, or at most one leading
space and then no blank. So a text may be cut before any blank that follows a non-blank, and each
piece be encoded alone. Where blanks come one at a time, that is a split at spaces.
"""

import base64
from collections.abc import Callable

import regex

from postbag.llm.common import Bounded

PIECES = regex.compile(r"\s*\S+|\s+")


def pieces(text: str) -> list[str]:
    """The text cut into pieces that can be encoded alone, in order."""
    if "  " in text or text[-1:].isspace():
        return PIECES.findall(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


class Encoder:
    """Little-endian 32-bit ids of whole texts, from ``encode_piece`` with a bounded memo."""

    def __init__(self, encode_piece: Callable[[str], bytes], limit: int = 300_000):
        self.memo = Bounded(encode_piece, limit)

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, pieces(text)))


def rank_file(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
