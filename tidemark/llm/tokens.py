"""Token counts in a public vocabulary, from files whose folder is a parameter."""

from __future__ import annotations

import base64
import os

import tiktoken

FOLDER = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the published pattern that splits text before this vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict[tuple[str, str], tiktoken.Encoding] = {}


def encoding(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    """The vocabulary, read once per process."""
    key = (folder, vocabulary)
    if key not in _loaded:
        with open(os.path.join(folder, f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[key] = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[key]
