"""A byte-level BPE vocabulary from a file of ranks; one encoder a worker."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The vocabulary file; every function that tokenises takes another.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: White space (as the pattern sees it) so long that the pattern's look-ahead would run out of stack.
LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")


@lru_cache(maxsize=4)
def encoder(path: str = RANKS):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(path: str = RANKS) -> Callable[[str], list[int]]:
    """A text's token ids: those of the encoder, for texts of any length.

    The pattern takes a run of white space as one piece, but for its last character if other text follows. Long runs are cut out
    and given to the encoder as such pieces, so the ids are the same."""
    e = encoder(path)

    def encode(text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for run in LONG_SPACE.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += e.encode_ordinary(text[at : run.start()])
            out += e._encode_single_piece(text[run.start() : end].encode())
            at = end
        return e.encode_ordinary(text) if not at else out + e.encode_ordinary(text[at:])

    return encode
