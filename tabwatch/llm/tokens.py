"""Token ids of whole texts, as the tokenizers library gives them, with a word cache.

Both vocabularies split a text into pieces by a pattern and merge inside each piece alone, so
the ids of a text are the ids of its pieces, one after the other. Texts made only of characters
whose classes are beyond doubt are split here and each distinct piece is encoded by the library
once; any other text, or one that holds a special string, goes through the library whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The pattern of each vocabulary, over characters of the Latin blocks.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBER = "0-9²³¹¼-¾"
BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+"
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+"
#: Characters outside these go through the library (the dotted capital I lowers to two characters).
DOUBTFUL = re.compile("[^\t\n\r -~¡-įı-ɏ‐-‧‰-⁞€]")
#: Runs of white space that hold a space and something more: their split depends on what follows.
LOOSE = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
#: Strings kept by a worker in each of two generations, and the longest of them.
MAX_CACHED = 300_000
MAX_KEPT = 48
_encoders: dict[str, "Encoder"] = {}


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the other bytes take the code points from 256 on in turn."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


class _Kept(dict):
    """string -> its ids as little-endian 32-bit words; strings not asked for lately are dropped."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            ids = self.encode(text)
        if len(text) <= MAX_KEPT:
            if len(self) >= MAX_CACHED:
                self.older = dict(self)
                self.clear()
            self[text] = ids
        return ids


class Encoder:
    """ids of a text for ``byte_bpe_50k.json`` or ``word_bpe_49k.json`` (or any library file,
    then without the cache)."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        name = path.rsplit("/", 1)[-1]
        self.lower = name.startswith("word_bpe")
        self.pattern = re.compile(WORD_PATTERN if self.lower else BYTE_PATTERN) if name.startswith(
            ("word_bpe_49k", "byte_bpe_50k")) else None
        self.model, self.alphabet = self.library.model, byte_alphabet()
        self.pieces = _Kept(self._piece)  # what the pattern matches
        self.chunks = _Kept(self._chunk)  # what stands between spaces

    def forget(self) -> None:
        """Drop all kept strings: a worker lives on after its task and other steps need the memory."""
        for kept in (self.pieces, self.chunks):
            kept.clear()
            kept.older = {}

    def _piece(self, piece: str) -> bytes:
        found = self.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))
        return array("I", [t.id for t in found]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if self.lower:  # a piece is a chunk too: each string is kept once
            parts = self.pattern.findall(chunk)
            return self._piece(chunk) if len(parts) == 1 and parts[0] == chunk else b"".join(map(self.chunks.__getitem__, parts))
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(" " + chunk)))

    def plain(self, text: str) -> bool:
        return (self.pattern is not None and not any(s in text for s in self.special)
                and DOUBTFUL.search(text) is None)

    def ids(self, text: str) -> bytes:
        """All ids, 4 little-endian bytes each."""
        if not self.plain(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.lower:  # no match of the pattern holds white space
            return b"".join(map(self.chunks.__getitem__, text.lower().split()))
        if text[:1] == " " or text[-1:] == " " or any(run in text for run in LOOSE):
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
        # a single space between two other characters always starts a match
        first, *rest = text.split(" ")
        return b"".join([*map(self.pieces.__getitem__, self.pattern.findall(first)), *map(self.chunks.__getitem__, rest)])

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids (unsigned 32-bit) of each text of a binary column.

        Texts are cut at white space and coded as a dictionary by Arrow, so that each distinct
        string of the batch is looked up once; the ids are then gathered by position.
        """
        whole = [x.as_buffer().to_pybytes().decode("utf-8", "replace") for x in texts]
        out: list[np.ndarray | None] = [None] * len(whole)
        fast = []
        for k, text in enumerate(whole):
            if self.plain(text) and (self.lower or not (text[:1] == " " or text[-1:] == " " or any(r in text for r in LOOSE))):
                fast.append(k)
            else:
                out[k] = np.frombuffer(self.ids(text), "<u4")
        if not fast:
            return out
        own = pa.array([whole[k] for k in fast], pa.large_string())
        cut = pc.utf8_split_whitespace(pc.utf8_lower(own)) if self.lower else pc.split_pattern(own, " ")
        ends, coded = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        at, strings = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = [self.chunks[x] for x in strings]
        if not self.lower:  # the first chunk of a text has no space before it
            at = at.copy()
            first = ends[:-1]
            found += [b"".join(map(self.pieces.__getitem__, self.pattern.findall(strings[k]))) for k in at[first].tolist()]
            at[first] = len(strings) + np.arange(len(first), dtype=at.dtype)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        lengths = sizes[at]
        before = np.concatenate(([0], np.cumsum(lengths)))
        ids = ids[np.repeat(starts[at] - before[:-1], lengths) + np.arange(before[-1])]
        for k, lo, hi in zip(fast, before[ends[:-1]].tolist(), before[ends[1:]].tolist()):
            out[k] = ids[lo:hi]
        return out

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Character offsets at which a piece starts (and the end), and the ids before each."""
        if self.plain(text) and not self.lower:
            parts = self.pattern.findall(text)
            get = self.pieces.__getitem__
            at = np.cumsum([0, *map(len, parts)])
            return at, np.cumsum([0, *[len(get(p)) // 4 for p in parts]])
        e = self.library.encode(text, add_special_tokens=False)
        at, before, last = [], [], object()
        for k, (word, (start, _)) in enumerate(zip(e.word_ids, e.offsets)):
            if word is None or word != last:
                at.append(start)
                before.append(k)
            last = word
        return np.array([*at, len(text)], np.int64), np.array([*before, len(e.ids)], np.int64)


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget(path: str) -> None:
    """Drop what this worker's encoder of a file has kept."""
    if path in _encoders:
        _encoders[path].forget()


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
