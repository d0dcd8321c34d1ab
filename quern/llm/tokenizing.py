"""Token ids of a byte-level BPE vocabulary file, for use inside Python workers."""

from __future__ import annotations

import json
import re

#: The pre-tokenizing pattern of byte-level BPE, and Unicode white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
SPACE = "\t-\r \x85\xa0  -     　"
#: The pattern's look-ahead leaves the last blank of a run to what follows; cutting the text there
#: has the same effect and lets the matcher run without look-ahead, which is faster.
_CUT = re.compile(f"(?<=[{SPACE}])(?=[{SPACE}][^{SPACE}])")

_loaded: dict[str, object] = {}


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """``encode(text) -> list of ids``, the same as the file's own library gives without added special tokens.

    Where merges are numbered in vocabulary order (checked on load), ranks and merges say the same and the
    rank-based encoder is used; else, and for texts that hold one of the file's added tokens, the library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, self._path, self._slow = whole["model"], path, None
        vocab, merges = model["vocab"], model["merges"]
        added = [re.escape(t["content"]) for t in whole.get("added_tokens") or [] if t["content"]]
        self._added = re.compile("|".join(added)) if added else None
        pairs = [m if isinstance(m, str) else " ".join(m) for m in merges]
        base = len(vocab) - len(pairs)
        self._fast = None
        if all(vocab.get(p.replace(" ", "", 1), -1) - i in (256, base) for i, p in enumerate(pairs)):
            import tiktoken

            alphabet = _byte_alphabet()
            ranks = {
                bytes(alphabet[c] for c in token): i
                for token, i in vocab.items()
                if all(c in alphabet for c in token) and i < 256 + len(pairs)
            }
            self._fast = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _library(self, text: str) -> list[int]:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self._path)
        return self._slow.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if self._fast is None or (self._added and self._added.search(text)):
            return self._library(text)
        if not _CUT.search(text):
            return self._fast.encode_ordinary(text)
        return [i for part in _CUT.split(text) for i in self._fast.encode_ordinary(part)]


def tokenizer(path: str) -> ByteBpe:
    """One encoder per worker process and file."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]
