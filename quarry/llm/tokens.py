"""Public byte-level BPE tokenizer, loaded once a worker."""

from __future__ import annotations

import base64

#: Text that the vocabulary file names as a special token; texts that contain it go through the `tokenizers` library itself, which
#: makes one id of it.
SPECIAL = "<|endoftext|>"
END_ID = 0
_loaded: dict[tuple[str, str], object] = {}


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Token ids of whole texts. The ranks file has the vocabulary of the json file; both give the same ids."""

    def __init__(self, json_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.json_path, self.plain = public_tokenizers.PATTERN, json_path, None

    def ids(self, text: str) -> list[int]:
        if SPECIAL not in text:
            return self.fast.encode_ordinary(text)
        if self.plain is None:
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_file(self.json_path)
        return self.plain.encode(text, add_special_tokens=False).ids


def encoder(paths: tuple[str, str]) -> Encoder:
    if paths not in _loaded:
        _loaded[paths] = Encoder(*paths)
    return _loaded[paths]
