"""Token ids of whole texts by a public tokenizer file.

A byte-level BPE whose merges come in the order of their ids can be run by rank:
`tiktoken` does that several times faster than `tokenizers` and gives the same ids (the
tests compare them). Any other tokenizer file is run by `tokenizers`. Strings of special
tokens inside a text are ordinary text.
"""

from __future__ import annotations

import json

import numpy as np

#: How a byte-level BPE cuts a text before merging; a fixed value of the file format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranks(path: str) -> dict[bytes, int] | None:
    """Bytes of each token by id, if merging by id is merging in the tokenizer's order."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    model, before = told["model"], told.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or told.get("normalizer"):
        return None
    if before.get("add_prefix_space") or not before.get("use_regex", True) or model.get("ignore_merges"):
        return None
    merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    made = [model["vocab"].get(a + b, -1) for a, b in merges]
    if any(a >= b for a, b in zip(made, made[1:])):
        return None
    letters, special = _byte_letters(), {x["content"] for x in told.get("added_tokens", ())}
    return {
        bytes(letters[c] for c in token): number
        for token, number in model["vocab"].items()
        if token not in special
    }


class Encoder:
    """`ids(text)`: the list of ids of a whole text."""

    def __init__(self, path: str):
        ranks = _ranks(path)
        if ranks is None:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.encode_special_tokens = True
            self.ids = lambda text: whole.encode(text, add_special_tokens=False).ids
        else:
            import tiktoken

            ranked = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.ids = ranked.encode_ordinary

    def packed(self, text: str) -> bytes:
        """The ids, little-endian unsigned 32-bit."""
        return np.array(self.ids(text), "<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """The path of an installed public tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
