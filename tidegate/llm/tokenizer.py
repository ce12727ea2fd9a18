"""Token ids of whole texts with a public tokenizer file, inside Arrow tasks."""

from __future__ import annotations

import os
import re
import string
from functools import cache

import tokenizers

END_ID = 0
ID_BYTES = 4
MEMO_ENTRIES = 450_000  # remembered parts of one generation, two are kept: about 200 MB a worker
LONGEST_KEPT = 64  # characters of a remembered part, which bounds the memory by bytes too
STRETCH = 2**20  # characters of a text whose parts are held at a time

# The white space of Unicode, as the tokenizer's splitting pattern knows it.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
# White space with the characters up to the next white space, less the punctuation after a
# word.  The splitting pattern of a byte-level vocabulary never joins characters across
# these cuts, so a text's ids are those of its parts, one after the other.
_PART = re.compile(
    f"[{_SPACE}]*(?:[{_LETTERS}]+(?=[{_SPACE}.,;:!?]|\\Z)|[^{_SPACE}]+)|[{_SPACE}]+"
)


# Where a long text may be cut: a part always ends between these.
_SEAM = re.compile(f"(?<=[^{_SPACE}]) ")
# A word, or one with a line break in front or marks behind it, is a piece of the splitting
# pattern for each of these, so the model can be asked without splitting again.
_WORD = re.compile(f"(\\n?)( ?[{_LETTERS}]+)([{re.escape(string.punctuation)}]*)")


class _Memo(dict):
    """Ids of parts lately seen, in two generations; others are coded when asked for."""

    def __init__(self, code):
        self.code = code
        self.older: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = self.code(part)
        if len(part) <= LONGEST_KEPT:
            self[part] = ids
        return ids

    def aged(self) -> None:
        self.older = dict(self)
        self.clear()


class Encoder:
    """Ids as little-endian 32-bit integers; parts lately seen are not encoded again."""

    def __init__(self, path: str, entries: int = MEMO_ENTRIES):
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are text
        self.pieces = self.tokenizer.model.tokenize
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.coded = [n.to_bytes(ID_BYTES, "little") for n in range(max(vocabulary.values()) + 1)]
        self.byte_letters = _byte_letters()
        self.entries = entries
        self.memo = _Memo(self._ids)

    def encode(self, text: str | None) -> bytes:
        """All ids of the text, then the end id; memory holds one stretch of parts at a time."""
        known, out, at, text = self.memo.__getitem__, [], 0, text or ""
        while at < len(text):
            seam = _SEAM.search(text, at + STRETCH) if len(text) - at > STRETCH else None
            end = seam.start() if seam else len(text)
            out.append(b"".join(map(known, _PART.findall(text, at, end))))
            if len(self.memo) > self.entries:
                self.memo.aged()
            at = end
        out.append(self.coded[END_ID])
        return b"".join(out)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        return [self.encode(text) for text in texts]

    def _ids(self, part: str) -> bytes:
        word = _WORD.fullmatch(part)
        if word is None:
            found = self.tokenizer.encode_batch_fast([part], add_special_tokens=False)[0].ids
            return b"".join([self.coded[i] for i in found])
        coded, out = self.coded, []
        for piece in word.groups():
            if piece:
                out += [coded[token.id] for token in self.pieces(self._letters(piece))]
        return b"".join(out)

    def _letters(self, piece: str) -> str:
        """The piece's bytes as the vocabulary writes them."""
        if piece.isascii() and piece != "\n":
            return piece.replace(" ", self.byte_letters[0x20])
        return piece.encode().decode("latin-1").translate(self.byte_letters)


def _byte_letters() -> dict[int, str]:
    """The character a byte-level vocabulary writes for each byte: visible ones stand for
    themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)
