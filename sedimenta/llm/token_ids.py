"""Exact, cached byte-level BPE encoding with a public tokenizer file.

A byte-level vocabulary whose splitting pattern lets a blank only *start* a piece never merges across a
single blank that stands between two non-blank characters; a single line feed there is a piece of its own.
A text may therefore be cut at both and each chunk be encoded by itself: the ids are those of the whole text.  Chunks repeat, so a worker keeps
their ids in a dictionary.  Unknown chunks of Latin letters are one piece and go straight to the library's
model, others through its whole encoder.  Many texts at once are cut by Arrow, so that a worker's Python sees each
different chunk of them once.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLANK = re.compile(r"(?<=\S) (?=\S)")
_BREAK = re.compile(r"(?<=\S)([ \n])(?=\S)")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # without the apostrophe, which may draw letters to itself
_ENCODERS: dict[tuple[str, int], "ChunkEncoder"] = {}
SLICE = 2 << 20  # characters
CACHE_BYTES = 320 << 20  # of a worker, whatever the input; given back when another operator starts
ENTRY = 200  # bytes of a dictionary's entry, its key and its value beside their contents


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 characters stand for their bytes, the others follow from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Chunks(dict):
    """Ids (little-endian unsigned 32-bit) of chunks behind one lead; ``None`` for chunks that can't stand alone.

    Two generations bound the memory to about ``most`` bytes: what was used since the last turn-over survives
    the next one.
    """

    def __init__(self, whole, piece, lead: str, most: int):
        super().__init__()
        self.whole, self.piece, self.lead, self.most, self.held = whole, piece, lead, most // 2, 0
        self.old: dict[str, bytes | None] = {}

    def __missing__(self, chunk: str) -> bytes | None:
        ids = self.old.get(chunk, b"")
        if ids == b"":
            word = chunk.rstrip(_MARKS)
            if word.isalpha() and (word.isascii() or max(word) < "ɐ"):
                # marks after a letter are a piece of their own
                ids = self.piece(self.lead + word) if word is chunk or word == chunk else self[word] + self.whole(chunk[len(word) :])
            elif not chunk or chunk[:1].isspace() or chunk[-1:].isspace():
                ids = None
            else:
                ids = self.whole(self.lead + chunk)
        self.held += ENTRY + (len(chunk) if chunk.isascii() else len(chunk.encode())) + len(ids or b"")
        if self.held > self.most:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[chunk] = ids
        return ids


class ChunkEncoder:
    """Gives the ids the tokenizers library gives, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, most: int = CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def whole(text: str) -> bytes:
            return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

        marks: dict[str, bytes] = {}

        def short(text: str) -> bytes:
            """Marks come again and again."""
            if len(text) > 2 and (len(text) > 3 or text.strip(_MARKS)):
                return whole(text)
            if text not in marks:
                marks[text] = whole(text)
            return marks[text]

        tokenize, alphabet = tokenizer.model.tokenize, _byte_alphabet()
        blank = alphabet[ord(" ")]

        def piece(text: str) -> bytes:
            """Ids of a text that the splitting pattern leaves whole, letters behind a blank or none."""
            plain = text.replace(" ", blank) if text.isascii() else text.encode().decode("latin-1").translate(alphabet)
            return array("I", [t.id for t in tokenize(plain)]).tobytes()

        self.whole, self.feed = whole, whole("\n")
        self.first, self.rest = _Chunks(short, piece, "", most // 8), _Chunks(short, piece, " ", most)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text; null and empty texts have none.  A very long text is encoded slice by slice."""
        if not text:
            return b""
        if len(text) > SLICE:
            return b"".join(self._slices(text))
        return self._slice(text, False)

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text of an array, as :meth:`encode` gives them.

        All texts are cut at once and each different chunk of them is looked up once.  A chunk that starts a line
        keeps its line feed; a text starts as a line does, and the ids of that feed are left out again.
        """
        if not len(texts):
            return []
        short = pc.fill_null(pc.if_else(pc.greater(pc.binary_length(texts), SLICE), pa.scalar("", texts.type), texts), "").cast(pa.string())
        lines = pc.replace_substring(short, "\n", " \n")
        cut = pc.split_pattern(pc.binary_join_element_wise("\n", lines, ""), " ")
        chunks, bounds = cut.flatten().dictionary_encode(), cut.offsets.to_numpy()
        different = pc.binary_join(pa.ListArray.from_arrays([0, len(chunks.dictionary)], chunks.dictionary), " ")[0].as_py().split(" ")
        rest, line = self.rest, self._line
        ids = pa.array([line(c) if c[:1] == "\n" else rest[c] for c in different], pa.binary()).take(chunks.indices)
        stops = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1)[bounds]
        data = ids.buffers()[2].to_pybytes() if ids.buffers()[2] else b""
        # empty, very long, or white space beside white space
        alone = np.logical_or.reduceat(ids.is_null().to_numpy(zero_copy_only=False), bounds[:-1])
        starts = stops[:-1] + len(self.feed)
        return [
            self.encode(texts[i].as_py()) if other else data[start:stop]
            for i, (start, stop, other) in enumerate(zip(starts.tolist(), stops[1:].tolist(), alone.tolist()))
        ]

    def _line(self, chunk: str) -> bytes | None:
        """Ids of a line feed and of the chunk behind it."""
        ids = self.first[chunk[1:]]
        return None if ids is None else self.feed + ids

    def _slices(self, text: str) -> Iterator[bytes]:
        """Slices start at a blank between other characters."""
        at = 0
        while at < len(text):
            cut = _BLANK.search(text, at + SLICE)
            stop = cut.start() if cut else len(text)
            yield self._slice(text[at:stop], at > 0)
            at = stop + 1

    def _slice(self, text: str, lead: bool) -> bytes:
        first, rest = self.first, self.rest
        try:
            out, heads = [], rest if lead else first
            for line in text.split("\n"):
                head, *tail = line.split(" ")
                out.append(heads[head] + b"".join(map(rest.__getitem__, tail)))
                heads = first
            return self.feed.join(out)
        except TypeError:  # white space beside white space
            pass
        head, *others = _BREAK.split(text)
        out = [self.whole(" " + head if lead else head)]
        for mark, chunk in zip(others[::2], others[1::2]):
            if mark == "\n":
                out.append(self.feed)
            ids = (first if mark == "\n" else rest)[chunk]
            out.append(self.whole(chunk if mark == "\n" else " " + chunk) if ids is None else ids)
        return b"".join(out)


def forget_encoders() -> None:
    """Give back what this worker's encoders hold; workers live on and serve the next operator."""
    if _ENCODERS:
        _ENCODERS.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # another C library keeps it for itself
            ctypes.CDLL(None).malloc_trim(0)


def encoder(path: str, most: int = CACHE_BYTES) -> ChunkEncoder:
    """One encoder for each worker process and tokenizer file."""
    key = (path, most)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, most)
    return _ENCODERS[key]
