"""Token ids of whole texts by a byte-level BPE file of the tokenizers library."""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable

import numpy as np

#: How a byte-level file without a pattern of its own splits text before the merges. A fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """Bytes and rank of each token if the file is plain byte-level BPE whose ids follow its merges, else None."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    plain &= model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    added = {t["content"] for t in spec.get("added_tokens", ())}
    vocab = {t: i for t, i in model.get("vocab", {}).items() if t not in added}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", ())]
    if not plain or len(vocab) != 256 + len(pairs) or any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(pairs)):
        return None
    byte = _byte_of()
    return {bytes(byte[c] for c in t): i for t, i in vocab.items()}


#: A run of white space that tiktoken's splitter, which looks back over all of it, is not given.
LONG_SPACE = re.compile(r"\s{20000}")


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, without special tokens added.

    Where the file allows it, the merges run in tiktoken, which is several times faster and gives the same
    ids; texts that spell out an added token, or have a very long run of white space, are left to the
    tokenizers library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks := merge_ranks(path):
            import tiktoken

            self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast is None or any(a in text for a in self.added) or LONG_SPACE.search(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each file and process."""
    return Encoder(path)


def vocabulary(name: str) -> Callable[[], str]:
    """A function that tells where a public tokenizer's file lies, on the machine that calls it."""

    def path() -> str:
        import public_tokenizers

        return str(public_tokenizers.path(name))

    return path
