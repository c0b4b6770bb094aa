"""Cutting a text into the units that a tokenizer file of the kind ``word_bpe_49k.json`` encodes one by one.

The file's rules: normal form C, lower case, then the pattern below; no unit holds white space.
Most texts need only common Latin characters, for which Python's ``re`` cuts alike and faster;
``simple`` says so, and any other text takes the slower way.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import regex

#: Fixed value: the split pattern of the tokenizer file.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+").findall
#: Without the characters in which ``re`` and the pattern, or two lower-casing rules, could differ.
_SIMPLE = re.compile("[\t-\r -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įĲ-ňŊ-ǃ]*").fullmatch


def simple(text: str) -> bool:
    return _SIMPLE(text) is not None


def units(text: str) -> list[str]:
    if simple(text):
        return _FAST(text.lower())
    return PATTERN.findall("".join(c.lower() for c in unicodedata.normalize("NFC", text)))


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Memo(dict):
    """A dictionary that fills itself by ``make`` and starts anew once it holds ``most`` entries."""

    def __init__(self, make, most: int = 400_000):
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.make(key)
        return value
