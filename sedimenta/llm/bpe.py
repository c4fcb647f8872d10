"""Byte-pair encoding with word ends, and decoding.

``merge`` is the encoder: a priority queue of (rank, position) over a doubly linked list of symbols; entries
whose symbols have changed since they were queued are stale and skipped.  The file's own normaliser and
splitting rule prepare the words.  White space is dropped by the splitting rule, so a text may be cut at
blanks; a worker keeps the result of each chunk and word.  Decoding concatenates the vocabulary strings in
the order of the ids; a file without a decoder puts one blank between them, as its library does.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.common import own_columns, table
from sedimenta.llm.token_ids import tokenizer_path

_MODELS: dict[str, "WordBPE"] = {}


def merge(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply merges, lowest rank first and leftmost among equals; ``ranks`` maps a pair to (rank, merged id)."""
    n = len(symbols)
    if n < 2:
        return symbols
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    queue = []
    for i in range(n - 1):
        found = ranks.get((symbols[i], symbols[i + 1]))
        if found:
            queue.append((found[0], i, found[1]))
    heapify(queue)
    while queue:
        _, i, merged = heappop(queue)
        j = after[i] if symbols[i] >= 0 else n
        if j >= n:
            continue
        found = ranks.get((symbols[i], symbols[j]))
        if not found or found[1] != merged:
            continue  # stale: one of the two symbols has changed
        symbols[i], symbols[j] = merged, -1
        k = after[j]
        after[i] = k
        if k < n:
            before[k] = i
            if right := ranks.get((merged, symbols[k])):
                heappush(queue, (right[0], i, right[1]))
        h = before[i]
        if h >= 0 and (left := ranks.get((symbols[h], merged))):
            heappush(queue, (left[0], h, left[1]))
    return [s for s in symbols if s >= 0]


class WordBPE:
    """A tokenizers file whose BPE marks word ends and whose splitting rule drops white space."""

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocabulary, self.suffix, self.most = model["vocab"], model.get("end_of_word_suffix") or "", most
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocabulary.items()} | {i: s for s, i in self.special.items()}
        self.glue = " " if spec["decoder"] is None else ""
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocabulary[a], self.vocabulary[b]] = (rank, self.vocabulary[a + b])
        tokenizer = Tokenizer.from_file(path)
        self.normalize, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.specials = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.words: dict[str, list[int]] = {}
        self.chunks = _Chunks(self)

    def word(self, word: str) -> list[int]:
        """Ids of one word in the byte alphabet."""
        ids = self.words.get(word)
        if ids is None:
            symbols = [*word[:-1], word[-1] + self.suffix]
            ids = merge([self.vocabulary[s] for s in symbols if s in self.vocabulary], self.ranks)
            if len(self.words) >= self.most:
                self.words.clear()
            self.words[word] = ids
        return ids

    def plain(self, text: str) -> list[int]:
        return [i for word, _ in self.split(self.normalize(text)) for i in self.word(word)]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; special tokens' strings give their ids; null and empty texts give none."""
        ids, at = [], 0
        text = text or ""
        for found in self.specials.finditer(text):
            ids += [*self.plain(text[at : found.start()]), self.special[found[0]]]
            at = found.end()
        return ids + self.plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        return self.glue.join(self.strings[i] for i in ids)


class _Chunks(dict):
    """Of each chunk: ids in decimal, decoded text, number of ids.

    Two generations bound the memory: what was used since the last turn-over survives the next one.
    """

    def __init__(self, model: WordBPE):
        super().__init__()
        self.model = model
        self.old: dict[str, tuple[str, str, int]] = {}
        visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in visible]
        self.alphabet = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}

    def _ids(self, chunk: str) -> list[int]:
        """Latin-1 letters with marks after them need neither the file's normaliser nor its splitting rule."""
        word = chunk.rstrip(".,;:!?")
        if word.isalpha() and (word.isascii() or max(word) < "Ā" and "ª" not in word and "º" not in word):
            ids = self.model.word(word.lower().encode().decode("latin-1").translate(self.alphabet))
            return ids + self.model.word(chunk[len(word) :]) if len(word) < len(chunk) else ids
        return self.model.encode(chunk)

    def __missing__(self, chunk: str) -> tuple[str, str, int]:
        value = self.old.get(chunk)
        if value is None:
            ids = [i for line in chunk.split("\n") for i in self._ids(line)]
            value = (" ".join(map(str, ids)), self.model.decode(ids), len(ids))
        if len(self) >= self.model.most:
            self.old = dict(self)
            self.clear()
        self[chunk] = value
        return value


def model(path: str) -> WordBPE:
    if path not in _MODELS:
        _MODELS[path] = WordBPE(path)
    return _MODELS[path]


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of ``docs(doc_id, text)``.

    Narrow: no shuffle, one batch in memory.  A null text counts as empty and has no ids.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        sha = lambda parts, glue: hashlib.sha256(glue.join(parts).encode()).hexdigest()
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column(1):
                found = [x for x in map(bpe.chunks.__getitem__, (text.as_py() or "").split(" ")) if x[2]]
                counts.append(sum(x[2] for x in found))
                ids.append(sha([x[0] for x in found], " "))
                decoded.append(sha([x[1] for x in found], bpe.glue))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return own_columns(docs, doc_id="doc_id", text="text").mapInArrow(
        digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode the whole ``documents`` table with the public word-end BPE file."""
    return encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES = {"op2_bpe": op2_bpe}
ORACLE_SQL: dict[str, str] = {}
