"""Token counts with a public tokenizer's vocabulary file, whose path is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

#: Where the vocabulary files of the public tokenizers lie, unless a caller names another file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the splitting pattern published with the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(vocabulary: str = VOCABULARY):
    """The tokenizer of a rank file; loaded once for each Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counts(texts: list[str | None], vocabulary: str = VOCABULARY) -> list[int]:
    """Tokens of each text; 0 for null. Strings that look like special tokens are ordinary text."""
    encode = encoding(vocabulary).encode_ordinary
    return [len(encode(t)) if t else 0 for t in texts]
