"""Exact encoding with a tokenizer that drops white space, through a cache of words.

White space always separates pre-tokens in such a tokenizer and is itself dropped, so a text's ids
are its words' ids one after another. A word is encoded by the library once in each life of the
cache; the cache has a fixed bound, so a worker's memory does not follow the corpus.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

#: The rules of a tokenizer file that this encoder follows. Files with other rules are left to the library.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "decoder": None,
}
#: Words kept before the cache starts anew.
MOST_WORDS = 500_000
#: Longer words are not kept.
LONGEST_KEPT = 64
#: The tokenizer's pre-token rule for words of ASCII bytes without capitals.
ASCII_PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


def byte_letters() -> list[str]:
    """The visible character that byte-level tokenizers write for each byte: itself where it is
    printable, the next one from U+0100 on where it is not."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def by_words(path: str) -> bool:
    """Whether the tokenizer file has the rules under which a text's ids are its words' ids one after another."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    special = [t for t in made.get("added_tokens") or [] if not t["content"].startswith("<|") or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
    return made["model"]["type"] == "BPE" and not made["model"].get("dropout") and not special and all(made.get(k) == v for k, v in RULES.items())


class WordEncoder(dict):
    """Maps a word to its ids as little-endian unsigned 32-bit bytes. With a tokenizer of other rules, whole texts go to the library."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.whole_texts = not by_words(path)
        self.split_piece = self.tok.model.tokenize
        self.letters = byte_letters()
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.names = [(self.tok.id_to_token(i) or "").encode("utf-8") for i in range(size)]

    @staticmethod
    def words(text: str) -> list[bytes]:
        """ASCII capitals are folded here, as the tokenizer does itself, unless the text could hold
        a special token."""
        raw = text.encode("utf-8")
        return raw.split() if b"<|" in raw else raw.lower().split()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.encode_word(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def piece(self, letters: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in self.split_piece(letters)])

    def encode_word(self, word: bytes) -> bytes:
        """Without white space, in any other respect arbitrary."""
        if word.isalpha() and word.islower():
            return self.piece(word.decode())
        if b"<|" not in word and word == word.lower():
            if word.isascii():
                found = ASCII_PIECE.findall(word)
                if len(found) > 1:
                    return b"".join([self[x] for x in found])
                if found and found[0] == word and min(word) > 0x20 and max(word) < 0x7F:
                    return self.piece(word.decode())
            else:
                text = word.decode("utf-8")
                core = text.rstrip(".,;:!?|)]}")
                if core.isalpha() and max(core) < "ɐ" and unicodedata.is_normalized("NFC", core):
                    low = core.lower()
                    if len(low) == len(core):
                        ids = self.piece("".join([self.letters[b] for b in low.encode("utf-8")]))
                        return ids + self[word[len(core.encode("utf-8")) :]] if len(core) < len(text) else ids
        return np.array(self.tok.encode(word.decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.whole_texts:
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, self.words(text)))

    def decode(self, ids) -> bytes:
        """What the library's decode gives where the tokenizer has no decoder: the tokens with a space between."""
        if self.whole_texts:
            return self.tok.decode(list(ids), skip_special_tokens=False).encode("utf-8")
        return b" ".join(map(self.names.__getitem__, ids))


_made: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process."""
    if path not in _made:
        _made[path] = WordEncoder(path)
    return _made[path]
