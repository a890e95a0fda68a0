"""Tokenizers behind caches of chunks that tokenize alone as they do inside a text.

A text is cut where its tokenizer always cuts it, whatever stands on either side; equal chunks are then encoded once
and looked up afterwards. A cache holds a bounded number of chunks and starts anew when full.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np

#: Chunks that a cache holds at most: some 250 MB in each Python worker.
CACHE_CHUNKS = 1_200_000
#: Texts are handled in groups of about so many characters, so that lists of their chunks stay small.
GROUP_CHARS = 1_000_000


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def groups(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about GROUP_CHARS together; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= GROUP_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class ChunkCache:
    """What ``encode`` gives for each chunk; ``fixed`` chunks stay for good."""

    def __init__(self, encode: Callable[[list], Iterable], fixed: dict | None = None, cap: int = CACHE_CHUNKS):
        self.encode, self.fixed, self.cap = encode, fixed or {}, cap
        self.known = dict(self.fixed)

    def of(self, chunks: Iterable) -> dict:
        """A dict that holds every one of ``chunks``."""
        wanted = set(chunks)
        missing = list(wanted.difference(self.known))
        if missing and len(self.known) + len(missing) > self.cap + len(self.fixed):
            self.known = dict(self.fixed)
            missing = list(wanted.difference(self.known))
        if missing:
            self.known.update(zip(missing, self.encode(missing), strict=True))
        return self.known


class PieceCounter:
    """Token counts of a sentencepiece BPE model whose pieces hold the space mark only at their front and never a line feed.

    Such a model never merges over a boundary before a space or a line feed, so a text is cut there. Pieces that
    encode alone as themselves are found once; a chunk that is one of them counts 1, the others are merged.
    """

    UNIT = re.compile(r" +[^ \n]*|\n[^ \n]*")
    MARK = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        proper = [p for i, p in enumerate(pieces) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        if any(self.MARK in p.lstrip(self.MARK) or "\n" in p for p in proper):
            raise ValueError("a piece of this model spans words or lines; its counts can't be taken chunk by chunk")
        self.cache = ChunkCache(self._count, self.whole_tokens(proper))

    def whole_tokens(self, pieces: list[str]) -> dict[str, int]:
        """Chunks (a space and a word) that the model itself encodes as one token."""
        words = [p[1:] for p in pieces if p[:1] == self.MARK and len(p) > 1 and p[1] != self.MARK]
        return {f" {w}": 1 for w, ids in zip(words, self.model.encode(words, num_threads=1), strict=True) if len(ids) == 1}

    def _count(self, chunks: list[str]) -> list[int]:
        # The model puts a space before every text, so a chunk's own first space is left out; a line feed gets one too many.
        asked = [c if c[0] == "\n" else c[1:] for c in chunks]
        return [1 if c == " " else len(ids) - (c[0] == "\n") for c, ids in zip(chunks, self.model.encode(asked, num_threads=1), strict=True)]

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for a, b in groups(texts):
            units = [self.UNIT.findall(f" {t}".replace(self.MARK, " ")) if t else [] for t in texts[a:b]]
            known = self.cache.of(u for us in units for u in us)
            out += [sum(map(known.__getitem__, us)) for us in units]
        return out


class IdCache(dict):
    """Ids of chunks, encoded when first asked for; of older chunks those asked for again are kept when half the cap is reached."""

    def __init__(self, encode: Callable[[str | bytes], bytes], cap: int = CACHE_CHUNKS):
        super().__init__()
        self.encode, self.half, self.older = encode, cap // 2, {}

    def __missing__(self, chunk: str | bytes) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.encode(chunk)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[chunk] = ids
        return ids


def _visible_bytes() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a visible character: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class IdEncoder:
    """Ids of a text by a ``tokenizers`` file with byte-level BPE, as little-endian unsigned integers of 2 or 4 bytes.

    ``spaced``: a word keeps the space before it; else white space is dropped and letters are lower case.
    A chunk of Latin letters, with or without marks behind them, is given to the tokenizer's model at once: for those, its
    normalizer and splitter are known (letters are one piece, marks another). Other chunks take the tokenizer's whole way.
    Texts that hold a special token's string are encoded whole.
    """

    #: White space as Unicode's property has it, and so the tokenizer's splitter; Python's own class holds U+001C to U+001F besides.
    WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    CHUNK = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
    #: Texts with none of these, and no white space at an end, have words with one space or line feed between them.
    ODD = ("  ", " \n", "\n ", "\n\n", "\0", *(chr(c) for c in range(0x3001) if chr(c).isspace() and c not in (10, 32)))
    PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|#*$%&]*)")

    def __init__(self, path: str, spaced: bool, cap: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.letter = {2: "H", 4: "I"}[self.dtype.itemsize]
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)), re.IGNORECASE) if special else None
        self.spaced, self.visible = spaced, _visible_bytes()
        self.cache, self.marks = IdCache(self._encode, cap), IdCache(self._whole, 1000)

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def _whole(self, chunk: str) -> bytes:
        return self._bytes(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def _encode(self, key: str | bytes) -> bytes:
        if self.spaced:
            # A key is a word that has a space before it, a line feed and what follows, or after a NUL any chunk as it is.
            chunk = key[1:] if key[0] == "\0" else key if key[0] == "\n" else f" {key}"
            if chunk[0] == "\n" and len(chunk) > 1 and not chunk[1].isspace():  # a line feed alone is a piece of its own
                return self.marks["\n"] + self.cache[f"\0{chunk[1:]}"]
        else:
            chunk = key.decode()
        if not (plain := self.PLAIN.fullmatch(chunk)):
            return self._whole(chunk)
        word, marks = plain.groups()
        seen = (word if self.spaced else word.lower()).encode().decode("latin-1").translate(self.visible)
        ids = self._bytes([t.id for t in self.model.tokenize(seen)])
        return ids + self.marks[marks] if marks else ids

    def _keys(self, text: str) -> list:
        if not self.spaced:
            return text.encode().lower().split()
        if not text:
            return []
        if text[0].isspace() or text[-1].isspace() or any(s in text for s in self.ODD):
            return [f"\0{c}" for c in self.CHUNK.findall(text)]
        words = text.replace("\n", " \n").split(" ")
        words[0] = f"\0{words[0]}"
        return words

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        for text in texts:
            if self.special and self.special.search(text):
                yield self._whole(text)
            else:
                yield b"".join(map(self.cache.__getitem__, self._keys(text)))


_kept: dict = {}


def kept(kind: Callable, *args):
    """One encoder for each Python worker, whatever number of tasks it runs."""
    key = (kind, *args)
    if key not in _kept:
        _kept[key] = kind(*args)
    return _kept[key]
