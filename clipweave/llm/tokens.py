"""Token ids and byte lengths of a public byte-level vocabulary, inside tasks."""

from __future__ import annotations

import base64
import functools

import numpy as np

VOCABULARY = "byte_bpe_50k"
_SPECIAL = "<|endoftext|>"


@functools.lru_cache(maxsize=2)
def _libraries(folder: str | None, name: str):
    """The vocabulary in two libraries that give equal ids; read once in each worker.

    ``folder`` names the place of the vocabulary files; None: that of ``public_tokenizers``.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    place = public_tokenizers.path if folder is None else lambda f: f"{folder}/{f}"
    with open(place(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    full = Tokenizer.from_file(place(f"{name}.json"))
    size = np.zeros(max(ranks.values()) + 2, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    size[-1] = len(_SPECIAL)
    return fast, full, size


def encode(text: str | None, folder: str | None = None, name: str = VOCABULARY) -> np.ndarray:
    """Ids of a whole text as ``tokenizers`` gives them without added special tokens; null is empty.

    ``tiktoken`` gives the same ids several times faster; a text that spells a special token,
    or that its pattern engine cannot handle, goes to ``tokenizers``.
    """
    if not text:
        return np.zeros(0, np.uint32)
    fast, full, _ = _libraries(folder, name)
    if _SPECIAL not in text:
        try:
            return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
        except ValueError:
            pass
    return np.array(full.encode(text, add_special_tokens=False).ids, np.uint32)


def byte_sizes(folder: str | None = None, name: str = VOCABULARY) -> np.ndarray:
    """UTF-8 bytes of each id; the ids of a text cover its bytes without gaps."""
    return _libraries(folder, name)[2]
