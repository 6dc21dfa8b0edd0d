"""Token ids of whole texts, computed inside tasks with public tokenizer files.

The byte-pair tokenizers here never join bytes across the pieces their own
splitting pattern gives, so the ids of a text are those of its pieces in turn.
Natural text repeats its pieces, hence the encoders keep the ids of pieces
they have met, up to CACHED of them; a full cache starts anew.  One encoder
serves a worker process.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np

CACHED = 600_000

# White space as the splitting patterns of the tokenizers have it.
_RARE_WHITE = "\x85\xa0  -     　"
_WHITE = "\t-\r " + _RARE_WHITE
_ODD_SPACE = re.compile(f"[\x1c-\x1f{_RARE_WHITE}]")
_CHUNK = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_CONTRACTION = "'s|'t|'re|'ve|'m|'ll|'d"
# Words whose lower case and composed form need no tables: printable ASCII and Latin letters.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile(f"{_CONTRACTION}|[^\\W\\d_]+|[0-9]|(?:[^\\w]|_)+")


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class PieceEncoder:
    """Ids, as little-endian unsigned 32-bit numbers, of the pieces of a text in turn."""

    def __init__(self) -> None:
        self._known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str] | None:
        """Where the text may be cut; None if it has to be encoded whole."""
        raise NotImplementedError

    def ids(self, text: str) -> list[int]:
        """What the library gives."""
        raise NotImplementedError

    def piece(self, piece: str) -> bytes:
        return np.array(self.ids(piece), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        pieces = self.pieces(text)
        if pieces is None:
            return self.piece_of_whole(text)
        known = self._known
        found = list(map(known.get, pieces))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    ids = known.get(pieces[i])
                    if ids is None:
                        ids = self.piece(pieces[i])
                        if len(known) >= CACHED:
                            known.clear()
                        known[pieces[i]] = ids
                    found[i] = ids
        return b"".join(found)

    def piece_of_whole(self, text: str) -> bytes:
        return np.array(self.ids(text), "<u4").tobytes()


class WordEncoder(PieceEncoder):
    """For lower-casing tokenizers with word ends, which drop white space (``tokenizers`` files).

    Words between white space are independent of each other.  A plain word is
    split as the tokenizer's pattern does and goes straight to its merges;
    words with any other character, and texts with rare kinds of white space,
    go through the library's whole chain.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self._all = Tokenizer.from_file(path)
        self._merges = self._all.model
        # The byte-level alphabet of Latin letters: their two bytes as the letters that stand for them.
        self._bytes = {c: _byte_letters(chr(c)) for c in range(0xC0, 0x100)}

    def pieces(self, text: str) -> list[str] | None:
        return None if _ODD_SPACE.search(text) else text.split()

    def ids(self, text: str) -> list[int]:
        try:
            return self._all.encode(text, add_special_tokens=False).ids
        except TypeError:
            # The library takes no surrogate; replace those that stand alone, as the byte-level one does.
            text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
            return self._all.encode(text, add_special_tokens=False).ids

    def piece(self, piece: str) -> bytes:
        if "<|" in piece or not _PLAIN.fullmatch(piece):
            return self.piece_of_whole(piece)
        out: list[int] = []
        for part in _PIECE.findall(piece.lower()):
            out += [x.id for x in self._merges.tokenize(part if part.isascii() else part.translate(self._bytes))]
        return np.array(out, "<u4").tobytes()


def _byte_letters(char: str) -> str:
    """A character's UTF-8 bytes as byte-level tokenizers write them (bytes from 0xA1 stand for themselves)."""
    hidden = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)]
    return "".join(chr(0x100 + hidden.index(b)) if b in hidden else chr(b) for b in char.encode())


class ByteEncoder(PieceEncoder):
    """For byte-level tokenizers given as ranks (``tiktoken`` files); special strings are ordinary text."""

    def __init__(self, path: str) -> None:
        super().__init__()
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._all = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.end_id = len(ranks)

    def pieces(self, text: str) -> list[str] | None:
        return _CHUNK.findall(text)

    def ids(self, text: str) -> list[int]:
        return self._all.encode_ordinary(text)

    def decode(self, ids: Iterable[int]) -> str:
        return self._all.decode(list(ids))


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@functools.cache
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


@functools.cache
def _sentence_pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def count_pieces(path: str, texts: list[str], at_once: int = 256) -> Iterator[int]:
    """Token counts as the sentence-piece library gives them, ``at_once`` texts at a time."""
    model = _sentence_pieces(path)
    for i in range(0, len(texts), at_once):
        yield from map(len, model.encode(texts[i : i + at_once], num_threads=1))
