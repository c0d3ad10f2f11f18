"""Fast exact pre-tokenisation for the two public tokenizers that the operators use.

A pattern module does the work for texts of well-known characters; a text with
any other character goes through the tokenizer's own normaliser and
pre-tokeniser, as character classes differ between Unicode versions.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import islice

import numpy as np
import regex

#: The byte tokenizer's pattern. On KNOWN texts the word characters of ``re`` that
#: are neither digits nor the underscore are exactly the letters.
BYTE_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: The word tokenizer's pattern, for lower-cased text without composed marks.
WORD_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Characters on which all sides agree about letters, digits, white space, case and composition
#: (checked one by one in the tests); four information separators and superscript or
#: fraction digits are not among them.
KNOWN = re.compile("[\\x00-\\x1b\\x20-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u036f\\u2010-\\u2060\\u20a0-\\u20bf\\u3041-\\u3096\\u30a1-\\u30fa]*")

#: White space for ``str.split`` alone.
SEPARATORS = re.compile("[\\x1c-\\x1f]")


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class BytePretokens:
    """Pre-tokens of a byte-level BPE tokenizer; special strings are cut out and counted."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        specials = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None

    def __call__(self, text: str) -> tuple[list[str], int]:
        """(pre-tokens in order, number of special tokens)."""
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            found: list[str] = []
            for part in parts:
                found += self._plain(part)
            return found, len(parts) - 1
        return self._plain(text), 0

    def _plain(self, text: str) -> list[str]:
        if KNOWN.fullmatch(text):
            return BYTE_PATTERN.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def sizes(self, pieces: list[str]) -> list[int]:
        """Number of tokens of each pre-token."""
        found = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        return np.bincount(np.array(found.word_ids, np.int64), minlength=len(pieces)).tolist()


class WordIds(dict):
    """Token ids of texts under a word BPE tokenizer, as little-endian 32-bit strings.

    Pre-tokens never cross white space, so a text is split there and the dictionary
    keeps the ids of each run of other characters. When it reaches ``most`` entries only the
    ``keep`` that it met first stay (frequent ones come early), so memory is bounded.
    """

    def __init__(self, path: str, most: int = 400_000, keep: int = 120_000):
        super().__init__()
        self.tokenizer = load(path)
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.most, self.keep = most, keep

    def __call__(self, text: str) -> bytes:
        if self.special is not None and self.special.search(text):
            return self._encoded(text)
        if KNOWN.fullmatch(text):
            text = unicodedata.normalize("NFC", text).lower()
        elif SEPARATORS.search(text):
            return self._encoded(text)
        return b"".join(map(self.__getitem__, text.split()))

    def _encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, run: str) -> bytes:
        if KNOWN.fullmatch(run):
            plain = unicodedata.normalize("NFC", run).lower()
            tokenize, cut = self.tokenizer.model.tokenize, self.tokenizer.pre_tokenizer.pre_tokenize_str
            if plain.isascii() and plain.isprintable():
                words = [plain] if plain.isalpha() else WORD_PATTERN.findall(plain)
            else:  # other bytes have stand-ins in the vocabulary
                words = [w for w, _ in cut(plain)]
            ids = b"".join([t.id.to_bytes(4, "little") for w in words for t in tokenize(w)])
        else:
            ids = self._encoded(run)
        if len(self) >= self.most:
            first = list(islice(self.items(), self.keep))
            self.clear()
            self.update(first)
        self[run] = ids
        return ids


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for each Python worker, kept from task to task."""
    return WordIds(path)
