"""Token ids of whole texts by a public word-level BPE vocabulary, through the ``tokenizers`` library.

The vocabulary normalises (NFC, white space to blanks, lower case), splits at white space and character classes and merges
within each piece, so a text's ids are those of its words, one after the other. A word that is not known yet goes through the
library's own normaliser, splitter and model; one that recurs is looked up, and so is a piece of a word.

Texts with characters for which this could differ (combining marks, letters outside Latin, control characters, special
tokens) are given to the library as they are.
"""

from __future__ import annotations

import functools
import re
from array import array

from tokenizers import Tokenizer

#: Characters of the words and pieces that a worker keeps.
KEPT = 8_000_000
#: All characters of a text that is encoded word by word: printable ASCII and Latin letters that compose with nothing, and signs.
PLAIN = re.compile("[^\\t\\n\\x0b\\x0c\\r\\x20-\\x7e\\u0085\\u00a0-\\u012f\\u0131-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20bf]")


class Words(dict):
    """Ids of words as little-endian unsigned 32-bit integers, filled on demand and kept up to a bound."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.normal, self.split, self.merge = self.library.normalizer.normalize_str, self.library.pre_tokenizer.pre_tokenize_str, self.library.model.tokenize
        self.pieces: dict[str, bytes] = {}  # by the symbols that the splitter writes for bytes
        self.size = 0

    def _piece(self, symbols: str) -> bytes:
        found = self.pieces.get(symbols)
        if found is None:
            found = self.pieces[symbols] = array("I", [t.id for t in self.merge(symbols)]).tobytes()
            self.size += len(symbols)
        return found

    def __missing__(self, word: str) -> bytes:
        if self.size > KEPT:
            self.clear()
            self.pieces.clear()
            self.size = 0
        if word.isascii() and word.isalpha():  # one piece, whose bytes stand for themselves
            found = array("I", [t.id for t in self.merge(word)]).tobytes()
        else:
            found = b"".join([self._piece(symbols) for symbols, _ in self.split(word if word.isascii() else self.normal(word))])
        self[word] = found
        self.size += len(word)
        return found

    def encode(self, text: str) -> bytes:
        """The text's ids."""
        if PLAIN.search(text) or any(s in text for s in self.special):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, text.lower().split()))


@functools.lru_cache(maxsize=2)
def words(path: str) -> Words:
    """The vocabulary at a path, loaded once a worker."""
    return Words(path)
