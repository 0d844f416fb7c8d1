"""Byte-level BPE over pieces: cut a text where no merge can cross, encode each distinct piece once.

The split pattern of the byte-level vocabularies never lets a match run over a space that follows
a non-space, so a text may be cut before such spaces ("units") and each unit encoded alone; likewise
around line ends, and commas and full stops that white space follows, where no other white space or
sign stands beside them.  Where white space comes in runs that a cut could break, the whole text goes
through the pattern.  The cache is bounded; what falls out of it costs time and never changes a result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
import regex

from psephos.llm.common import one_thread

#: A space inside a run of white space that isn't the last of the run.
_INSIDE_RUN = re.compile(r"\s (?!\S)")
#: Characters whose class may differ between Unicode versions.
_RECENT = re.compile("[鼀-\U0010ffff]")
#: Those, and white space other than blanks and line ends: one look tells that a text has neither.
_UNUSUAL = re.compile("[\0\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000鼀-\U0010ffff]")
#: Full stops and commas that may belong to the piece before them: after a sign, or after white space.
_SIGN_RUN = re.compile(r",(?<=[\W_],)(?=\s)"), re.compile(r"\.(?<=[\W_]\.)(?=\s)")
#: A line end with more white space beside it.
_LINE_RUN = re.compile(r"\n(?:\s|(?<=\s\n))")
#: Units and pieces that each generation of the cache holds, and characters of the longest that is kept:
#: with its ids such a one takes less than a kilobyte, words of ten characters some 200 bytes.
MOST_CACHED, MOST_CHARS = 300_000, 64


class _Cache(dict):
    """Ids of units and pieces in two generations: when the young one is full it becomes the old one,
    and what is used again moves back."""

    def __init__(self, encode: Callable[[str], bytes], most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}
        self.split = regex.compile(public_tokenizers.PATTERN).findall

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit)
        if ids is None:
            if unit.isalpha() or unit[:1] == " " and unit[1:].isalpha():
                ids = self.encode(unit)
            else:
                pieces = self.split(unit)
                ids = self.encode(unit) if len(pieces) == 1 else b"".join([self[p] for p in pieces])
        if len(unit) > MOST_CHARS:
            return ids
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[unit] = ids
        return ids


class PieceEncoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers.

    ``piece`` encodes one match of the split pattern; ``whole`` (if given) encodes a whole text
    and takes the texts that the cuts can't be trusted with.
    """

    def __init__(self, piece: Callable[[str], bytes], whole: Callable[[str], bytes] | None = None, special: tuple[str, ...] = ()):
        self.ids = _Cache(piece, MOST_CACHED)
        self.whole, self.special = whole, special

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        unusual = _UNUSUAL.search(text) is not None
        if self.whole and (any(x in text for x in self.special) or unusual and _RECENT.search(text)):
            return self.whole(text)
        runs = unusual or "  " in text or "\n " in text
        if runs and ("\0" in text or _INSIDE_RUN.search(text)):
            return b"".join(map(self.ids.__getitem__, self.ids.split(text)))
        # The marks behind a sign come with the next cuts where those follow, so that no unit is empty.
        lines = "\n" in text and not _LINE_RUN.search(text)
        if not (_SIGN_RUN[0].search(text) or _SIGN_RUN[1].search(text)):
            text = text.replace(", ", "\0, ").replace(". ", "\0. ").replace(".\n", "\0.\n" if lines else "\0.\0\n")
        if lines:
            text = text.replace("\n", "\0\n\0")
        return b"".join(map(self.ids.__getitem__, text.replace(" ", "\0 ").split("\0")))


_LIBRARY: dict[str, PieceEncoder] = {}


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if it is printable in
    Latin-1, else the next free character from U+0100 on."""
    table, free = {}, 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            table[byte] = chr(byte)
        else:
            table[byte] = chr(free)
            free += 1
    return table


def library_encoder(path: str) -> PieceEncoder:
    """An encoder by the tokenizers library for a byte-level file; one for each worker process."""
    if path not in _LIBRARY:
        one_thread()
        import numpy as np
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        model, alphabet = tokenizer.model, byte_alphabet()

        blank, ids = alphabet[32], [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size() + 1)]

        def piece(text: str) -> bytes:
            word = text[1:] if text[:1] == " " else text
            if word.isascii() and word.isalpha():  # letters stand for themselves
                text = text if word is text else blank + word
            else:
                text = text.encode().decode("latin-1").translate(alphabet)
            return b"".join([ids[t.id] for t in model.tokenize(text)])

        def whole(text: str) -> bytes:
            return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

        special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
        _LIBRARY[path] = PieceEncoder(piece, whole, special)
    return _LIBRARY[path]
