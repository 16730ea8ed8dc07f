"""WordPiece over a vocabulary that the caller gives, as a pandas UDF."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

MOST_TOKENS, MOST_WORD = 256, 100
# Letters with marks that are written without; other letters keep their marks.
FOLDED = {"a": "áàâäãåā", "e": "éèêëē", "i": "íìîïī", "o": "óòôöõō", "u": "úùûüū", "c": "ç", "n": "ñ", "y": "ýÿ"}
# Signs that are words of their own, and what parts words.
SIGNS, BLANKS = "!-/:-@\\[-`{-~\u2000-\u206f", " \t\n\r"

_PLAIN = str.maketrans({marked: bare for bare, all_ in FOLDED.items() for marked in all_} | {chr(c): None for c in (*range(32), 0xFFFD) if chr(c) not in BLANKS})
_WORD = re.compile(f"[{SIGNS}]|[^{SIGNS}{BLANKS}]+")
_END = ""  # the key of a piece's id in its node; all others are single characters


class Pieces:
    """A vocabulary as two tries, of pieces that begin a word and of those that go on with one, so a piece is found by one walk."""

    def __init__(self, vocabulary: dict[str, int]):
        self.unknown, self.first, self.last = (vocabulary[t] for t in ("[UNK]", "[CLS]", "[SEP]"))
        self.begin: dict = {}
        self.go_on: dict = {}
        for piece, number in vocabulary.items():
            self._add(self.begin, piece, number)
            if piece.startswith("##"):
                self._add(self.go_on, piece[2:], number)

    @staticmethod
    def _add(root: dict, piece: str, number: int) -> None:
        for c in piece:
            root = root.setdefault(c, {})
        root[_END] = number

    def of_word(self, word: str) -> list[int]:
        """The longest pieces from left to right; the id of the unknown word if some part has none or the word is too long (UTF-16 units)."""
        if len(word.encode("utf-16-le", "surrogatepass")) > 2 * MOST_WORD:
            return [self.unknown]
        ids, at = [], 0
        while at < len(word):
            node, found = self.go_on if at else self.begin, None
            for end in range(at, len(word)):
                node = node.get(word[end])
                if node is None:
                    break
                if _END in node:
                    found, behind = node[_END], end + 1
            if found is None:
                return [self.unknown]
            ids.append(found)
            at = behind
        return ids

    def encode(self, text: str, most: int = MOST_TOKENS) -> list[int]:
        """[CLS], the pieces of the words, [SEP]; no word is looked at once there are enough."""
        ids = [self.first]
        for word in _WORD.finditer(text.lower().translate(_PLAIN)):
            if len(ids) >= most - 1:
                break
            ids += self.of_word(word.group())
        return [*ids[: most - 1], self.last]


def encode(text: str, vocabulary: dict[str, int], most: int = MOST_TOKENS) -> list[int]:
    return Pieces(vocabulary).encode(text, most)


def wordpiece(text: Column, vocabulary: dict[str, int], most: int = MOST_TOKENS) -> Column:
    """Token ids; a null text has those of an empty one. A vocabulary is bounded (tens of thousands of pieces), and goes to the workers with the function."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = Pieces(vocabulary)
        for texts in batches:
            yield texts.fillna("").map(lambda t: pieces.encode(t, most))

    return run(text)
