"""Token ids of whole texts as the tokenizers library gives them, by remembered words.

``WordwiseEncoder`` cuts a text into the words that the tokenizer's own
pre-tokenizer would give and remembers each word's ids, so the library encodes
every distinct word about once instead of every occurrence. A new word's bytes go straight to the
library's model, as normalisation and pre-tokenisation are done by then. It cuts texts by a
plain regular expression when all their characters are among those for which
that is the same (ASCII and Latin letters); all other texts go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from .common import held

#: Characters on which Python's and the tokenizer's character classes agree and
#: which normalisation leaves alone: ASCII but for the separators 1C-1F, and the
#: Latin letters up to U+017F but for the two whose case changes length or folds oddly.
UNSAFE = re.compile("[^\t-\r -~À-ÖØ-öø-įĲ-ňŊ-ž]")
#: The pre-tokenizers' words on safe characters, spelt out, what is most frequent first: no other alternative begins with a letter.
_LETTERS, _SIGNS, _ENDINGS = "[A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-ž]+", r"[!-/:-@\[-`{-~]+", "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_WORD = re.compile(rf" ?{_LETTERS}|{_ENDINGS}| ?[0-9]+| ?{_SIGNS}|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: The printable character of each byte, as the byte-level pre-tokenizer has it: itself if visible Latin-1, else one from U+0100 on.
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
PRINTABLE = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
LOWER_WORD = re.compile(rf"{_LETTERS}|{_ENDINGS}|[0-9]|{_SIGNS}")


def resolve(name: str) -> str:
    """Where a public vocabulary file is: a path as given, or a name of the installed collection."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class WordwiseEncoder:
    """encode(text) -> ids as a little-endian array of ``dtype``.

    Special tokens' strings in a text get their ids, as the library does by
    default; nothing is added, cut or padded.
    """

    def __init__(self, tokenizer: str, limit: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(resolve(tokenizer))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.lower, self.word = self._cutter(spec)
        added = [x["content"] for x in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.memo: dict[str, bytes] = {}
        self.limit = limit

    @staticmethod
    def _cutter(spec: dict):
        """(lower-case first, pattern), or no pattern where the pre-tokenizer isn't one of the two known."""
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        plain = all(not x.get("normalized") and not x.get("lstrip") and not x.get("rstrip") and not x.get("single_word") for x in spec["added_tokens"])
        if plain and norm is None and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]:
            return False, BYTE_WORD
        steps = [x["type"] for x in (norm or {}).get("normalizers", [])]
        parts = pre.get("pretokenizers", [])
        if plain and steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in parts] == ["Split", "ByteLevel"]:
            split = parts[0]
            known = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
            if split["pattern"].get("Regex") == known and split["invert"] and split["behavior"] == "Removed" and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]:
                return True, LOWER_WORD
        return False, None

    def _encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.word is None or UNSAFE.search(text) or self.special is not None and self.special.search(text):
            return np.frombuffer(self._encode(text), self.dtype)
        if self.lower:
            text = text.lower()
        words = self.word.findall(text)
        found = list(map(self.memo.get, words))
        if None in found:
            at, i = [], -1
            for _ in range(found.count(None)):
                at.append(i := found.index(None, i + 1))
            new = {words[i] for i in at}
            if len(self.memo) + len(new) > self.limit:
                self.memo.clear()
            self._learn(new)
            for i in at:
                found[i] = self.memo[words[i]]
        return np.frombuffer(b"".join(found), self.dtype)

    def _learn(self, words: set[str]) -> None:
        tokenize = self.model.tokenize
        for w in words:
            printable = w.encode().decode("latin-1").translate(PRINTABLE)
            self.memo[w] = array(self.code, [x.id for x in tokenize(printable)]).tobytes()


def encoder_of(tokenizer: str, limit: int = 800_000) -> WordwiseEncoder:
    """One encoder a worker process, so that its memory of words lasts over tasks."""
    return held(("tokens", tokenizer, limit), lambda: WordwiseEncoder(tokenizer, limit))
