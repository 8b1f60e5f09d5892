"""Cached encoders over public tokenizer files, exact for whole texts.

A text is cut into fragments that encode independently of each other; the ids of fragments are kept in
each Python worker, in stores of bounded size in bytes (``common.Store``), so that a fragment that is
seen again is not encoded again.

``WordEncoder``: for word-end BPE files (white space dropped). White space can never be inside a
token, so the fragments are the runs between spaces and line feeds.

``ForcedBoundaryEncoder``: for byte-level BPE files. A pair of adjacent bytes that occurs inside no
vocabulary token can never be merged over, so a cut there changes nothing (``forced_pairs``). Cuts
are further restricted to places where the pre-tokenizing pattern reads both sides alike:

* never after a byte that may end a white-space character (the pattern looks ahead after space),
* never before an apostrophe (a contraction may only be recognised at the start of a match),
* never inside a UTF-8 character.

The strings of added (special) tokens count as vocabulary tokens, so they are never cut.

Encoders are built lazily in each Python worker from the path alone.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from .common import Store, claim

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes that a generation of a store may take, two of which are kept: fragments as they stand, the
#: words in them, and byte-level fragments.
FRAGMENT_BYTES, WORD_BYTES, BYTE_FRAGMENT_BYTES = 60 << 20, 28 << 20, 60 << 20

_LATIN_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([^A-Za-zÀ-ÖØ-öø-ÿ]*)")
_PLAIN_TAIL = re.compile(r"[.,!?;:#$%&*]*")
_SPACED_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: bytes that print stand for
    themselves, the others are numbered from 256 on."""
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printing else chr(next(rest)) for b in range(256)]


BYTE_CHARS = _byte_chars()
_TO_CHARS = {b: c for b, c in enumerate(BYTE_CHARS)}
_TO_BYTE = {c: b for b, c in enumerate(BYTE_CHARS)}


def default_path(name: str) -> str:
    """Path of a public tokenizer file by name."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """A tokenizer with truncation and padding off."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def token_bytes(tok) -> dict[int, bytes]:
    """The bytes of each id of a byte-level vocabulary; added tokens stand for their own text."""
    added = {i: t.content for i, t in tok.get_added_tokens_decoder().items()}
    out = {}
    for piece, i in tok.get_vocab(with_added_tokens=True).items():
        out[i] = added[i].encode() if i in added else bytes(_TO_BYTE[c] for c in piece)
    return out


def forced_pairs(pieces) -> np.ndarray:
    """``table[256 * a + b]``: True where the bytes a, b stand side by side inside no piece."""
    inside = np.zeros(65536, dtype=bool)
    for piece in pieces:
        if len(piece) > 1:
            x = np.frombuffer(piece, dtype=np.uint8).astype(np.int32)
            inside[x[:-1] * 256 + x[1:]] = True
    return ~inside


#: How the UTF-8 forms of the white-space characters beyond ASCII begin.
_WIDE_SPACE = (b"\xe2\x80", b"\xc2\xa0", b"\xc2\x85", b"\xe3\x80\x80", b"\xe1\x9a\x80", b"\xe2\x81\x9f")


def safe_cuts(table: np.ndarray, wide_space: bool) -> np.ndarray:
    """``table`` without the cuts at which the pre-tokenizing pattern could read a side otherwise.
    ``wide_space``: whether the text may hold white space beyond ASCII."""
    a, b = np.divmod(np.arange(65536), 256)
    ends_space = (a <= 0x20) | (a == 0x7F)
    if wide_space:
        ends_space |= ((a >= 0x80) & (a <= 0x8A)) | np.isin(a, (0x9F, 0xA0, 0xA8, 0xA9, 0xAF))
    inside_char = (b >= 0x80) & (b < 0xC0)
    return table & ~ends_space & ~inside_char & (b != 0x27)


class WordEncoder:
    """Ids of whole texts under a word-end BPE file, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.tok = load(path)
        self.model = self.tok.model
        self.words = Store(self._word, WORD_BYTES)
        self.tails = Store(self._any, WORD_BYTES // 8)
        self.whole = Store(self._fragment, FRAGMENT_BYTES)

    def drop(self) -> None:
        for store in (self.words, self.tails, self.whole):
            store.drop()

    def _any(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes() if text else b""

    def _word(self, low: str) -> bytes:
        """A lower-case word of letters up to U+00FF: one pre-token, so the model alone decides."""
        mapped = low.encode().decode("latin-1").translate(_TO_CHARS)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])

    def _fragment(self, text: str) -> bytes:
        if m := _LATIN_WORD.fullmatch(text):
            word, tail = m.groups()
            if _PLAIN_TAIL.fullmatch(tail):
                return self.words[word.lower()] + self.tails[tail]
        return self._any(text)

    def encode(self, text: str | None) -> bytes:
        """Ids of the text; null counts as empty."""
        if not text:
            return b""
        claim(self)
        return b"".join(map(self.whole.__getitem__, text.replace("\n", " ").split(" ")))


class ForcedBoundaryEncoder:
    """Ids and decoding of whole texts under a byte-level BPE file, by forced-boundary splitting."""

    def __init__(self, path: str):
        self.tok = load(path)
        self.model = self.tok.model
        self.bytes_of = token_bytes(self.tok)
        pairs = forced_pairs(self.bytes_of.values())
        self.cuts = {wide: safe_cuts(pairs, wide) for wide in (False, True)}
        self.names = {i: b"%d" % i for i in self.bytes_of}
        self.known = Store(self._fragment, BYTE_FRAGMENT_BYTES)

    def drop(self) -> None:
        self.known.drop()

    def _fragment(self, frag: bytes) -> bytes:
        if _SPACED_WORD.fullmatch(text := frag.decode()):
            return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(frag.decode("latin-1").translate(_TO_CHARS))])
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def split(self, data: bytes) -> list[bytes]:
        """Fragments of a text's UTF-8 bytes."""
        cuts = self.cuts[any(map(data.__contains__, _WIDE_SPACE))]
        x = np.frombuffer(data, dtype=np.uint8).astype(np.int32)
        at = (np.flatnonzero(cuts[x[:-1] * 256 + x[1:]]) + 1).tolist()
        return [data[i:j] for i, j in zip([0, *at], [*at, len(data)], strict=True)]

    def encode(self, text: str | None) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit bytes; null counts as empty."""
        if not text:
            return b""
        claim(self)
        return b"".join(map(self.known.__getitem__, self.split(text.encode())))

    def decimals(self, ids: bytes) -> bytes:
        """The ids in decimal, joined by commas."""
        return b",".join(map(self.names.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def decode(self, ids: bytes) -> str:
        """The text of the ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@lru_cache(maxsize=4)
def byte_encoder(path: str) -> ForcedBoundaryEncoder:
    return ForcedBoundaryEncoder(path)
