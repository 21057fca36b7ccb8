"""Token ids of whole texts with a public tokenizer file, word by word.

Both public BPE files cut a text at white space, and between letters or digits
and marks, before they merge. So a text cut before a single space or line
break between two plain characters, or before the first full stop or comma
after a letter or digit, has the ids of its pieces one after the other. The pieces repeat, so each worker
remembers the ids of those it has seen: two generations of a bounded size, of
which the older one goes when the newer is full. Where neither case nor white
space leaves a trace in the ids, the pieces are simply the words, and new words
of plain letters go straight to the merges. Places that are not plain (runs of spaces, other scripts' spaces, combining marks)
are never cut. Special tokens written out in a text are their one id, as by the
library's defaults, and what stands between them is encoded as texts of its own.
"""

from __future__ import annotations

import re
import sys
from array import array
from functools import lru_cache

from tokenizers import Tokenizer

_SAFE = "!-~¡-ɏ"
#: White space that the plain cut must not meet within a text, beside that at its ends, and full stops or commas.
_RUNS = ("  ", " \n", "\n ", "\n\n")
_LOOSE = re.compile("[.,](?<![A-Za-z0-9À-ÖØ-öø-ɏ.,][.,])")
_PIECES = re.compile(r"[ \n]?[^ \n.,]+|[.,][^ \n]*")
#: The same where a line break is a word of its own for the model.
_BROKEN = re.compile(r"\n| ?[^ \n.,]+|[.,][^ \n]*")
#: What a text of words must not hold to be cut at white space, and the same for ASCII.
_UNPLAIN = re.compile("[^ \n!-~¡-įı-ɏ]")  # without İ, whose lower case is two characters
_ASCII = bytes([10, *range(32, 127)])
#: Letters and the marks after them, which are encoded apart.
_MARKED = re.compile(r"([^\W\d_]+)(\W+)")
#: How byte-level models spell the bytes of a text: printable ones as they are, the others from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELT = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_SPACE = chr(_SPELT[32])
_CUT = re.compile(f"(?<=[{_SAFE}])(?=[ \n][{_SAFE}])")
#: Pieces in one of the two generations that a worker remembers: about 33 MB of words, or 130 MB of pieces with
#: their white space and case, of which there are several for a word.
REMEMBERED, REMEMBERED_AS_WRITTEN = 200_000, 800_000


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else b"".join(i.to_bytes(4, "little") for i in ids)


class _Ids(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        added = tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens are only supported where they match a text as it is written")
        self.special = {t.content: i.to_bytes(4, "little") for i, t in added.items()}
        self.parting = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.folds = self.spelt = False
        # Where neither case nor white space leaves a trace in the ids, pieces that differ in them only are one.
        self.folds = len({tuple(tokenizer.encode(t, add_special_tokens=False).ids) for t in ("ab", "Ab", " aB", "\nAB")}) == 1
        # Where case and space count, whether the model takes words with them as byte-level spelling has them.
        letters = "".join(c for c in map(chr, range(0xA1, 0x250)) if c.isalpha() and not _UNPLAIN.search(c))
        tries = ("word", " Word", " q", "zQXj", " aaaaB", " naïve", "Œuvre", letters)
        self.spelt = not self.folds and all(tokenizer.encode(t, add_special_tokens=False).ids == self.spelling(t) for t in tries)
        after = ("word", "Word", "é", "1", "(", "'s", "-", "²", "<")
        alone = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
        self.pieces = _BROKEN if self.spelt and all(alone(f"a\n{t}") == alone("a") + alone("\n") + alone(t) for t in after) else _PIECES
        self.older: dict[str, bytes] = {}

    def keep(self, piece: str, ids: bytes) -> bytes:
        if len(self) >= (REMEMBERED if self.folds else REMEMBERED_AS_WRITTEN):
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def spelling(self, piece: str) -> list[int]:
        """Ids of a word of letters, after a space at most, straight from the merges."""
        word = piece.removeprefix(" ")
        spelt = word if word.isascii() else word.encode().decode("latin-1").translate(_SPELT)
        return [token.id for token in self.model.tokenize(spelt if word == piece else _SPACE + spelt)]

    def __missing__(self, piece: str) -> bytes:
        if piece in self.older:
            return self.keep(piece, self.older[piece])
        if self.folds and piece.isalpha() and piece.islower() and not _UNPLAIN.search(piece):
            # One word as the model gets it: nothing to normalise or to cut.
            return self.keep(piece, _packed(self.spelling(piece)))
        if self.spelt and piece.removeprefix(" ").isalpha() and not _UNPLAIN.search(piece):
            # Letters after a space at most are one word of the model as well.
            return self.keep(piece, _packed(self.spelling(piece)))
        return self.keep(piece, _packed(self.tokenizer.encode(piece, add_special_tokens=False).ids))

    def of_words(self, words: list[str]) -> bytes:
        """Ids of lower-case words; those before marks are remembered without them."""
        found = list(map(self.get, words))
        at = -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            word = words[at]
            parts = None if word[-1].isalpha() else _MARKED.fullmatch(word)
            found[at] = self[parts[1]] + self[parts[2]] if parts else self[word]
        return b"".join(found)


@lru_cache(maxsize=2)
def _ids(path: str) -> _Ids:
    tokenizer = Tokenizer.from_file(path)
    # For pieces between special tokens: in lower case, one may look like a special token and is none.
    tokenizer.encode_special_tokens = True
    return _Ids(tokenizer)


def _unplain(text: str) -> bool:
    return bool(text.encode().translate(None, _ASCII) if text.isascii() else _UNPLAIN.search(text))


def _odd(text: str) -> bool:
    """Whether a text, not empty, holds something that the plain cut must not meet.

    Every test is one scan for a few characters: one pattern of all of them
    would be tried at every place of the text.
    """
    return text[0] in " \n" or text[-1] in " \n" or any(run in text for run in _RUNS) or _unplain(text) or _LOOSE.search(text) is not None


def encode(path: str, text: str | None) -> bytes:
    """The ids of a text without special tokens as little-endian unsigned 32-bit integers; null is empty."""
    if not text:
        return b""
    ids = _ids(path)
    if ids.folds:
        if _unplain(text):
            pieces = _CUT.split(text)
        else:
            return ids.of_words(text.lower().split())
    elif _odd(text):
        pieces = _CUT.split(text)
    else:
        pieces = ids.pieces.findall(text)
    return b"".join(map(ids.__getitem__, pieces))


def encode_whole(path: str, text: str | None) -> bytes:
    """The same for any text: special tokens written out in it are their one id each."""
    special = _ids(path).special
    if not text or not any(content in text for content in special):
        return encode(path, text)
    return b"".join(special[part] if part in special else encode(path, part) for part in _ids(path).parting.split(text))
