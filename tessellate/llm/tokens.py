"""Token ids of the byte-level BPE vocabulary used by packing and counting.

The vocabulary file is the ``tokenizers`` JSON.  Where its merges are in the
order of their ids (so that ids serve as ranks) the same vocabulary is run by
tiktoken, which yields the same ids several times faster; otherwise, and for
texts that tiktoken refuses (long runs of blanks exhaust its pattern's stack),
the ``tokenizers`` library runs it.  Strings of the vocabulary's added tokens in
a text are these tokens where ``added`` is set, as ``tokenizers`` has it unless
told otherwise (packing), and ordinary text where it is not (counting).
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return letters


@lru_cache(maxsize=4)
def encoder(path: str | None = None, added: bool = False):
    """A function text -> uint32 ids, built once per worker process."""
    import public_tokenizers
    import tiktoken

    path = path or vocabulary_path()
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)
    model, tokens = vocabulary["model"], vocabulary.get("added_tokens") or []
    letters = _byte_letters()
    special = {k for k in model["vocab"] if any(c not in letters for c in k) or k == "<|endoftext|>"} | {t["content"] for t in tokens}
    ranks = {bytes(letters[c] for c in k): v for k, v in model["vocab"].items() if k not in special}
    joined = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    order = [model["vocab"][m.replace(" ", "", 1)] for m in joined]
    exact = lru_cache(maxsize=1)(lambda: _tokenizer(path, added))  # made when first needed

    def slowly(text):
        return np.array(exact().encode(text, add_special_tokens=False).ids, np.uint32)

    # tiktoken has no tokens that take the blanks beside them, and its order among several is its own
    plain = len(tokens) <= 1 and not any(t.get(k) for t in tokens for k in ("lstrip", "rstrip", "single_word"))
    if order != sorted(order) or added and not plain:
        return slowly
    t = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                          special_tokens={t["content"]: t["id"] for t in tokens} if added else {})
    allowed = t.special_tokens_set

    def encode(text):
        try:
            return np.asarray(t.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()), np.uint32)
        except ValueError:
            return slowly(text)

    return encode


def _tokenizer(path: str, added: bool):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = not added
    return t
