"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs and digit substitutions to plain letters and every other character to
a blank, so that `1d10t` and `idiot` are one word.  Lexicon entries are whole words and word beginnings; the
weight of an entry is its log-odds among labelled texts.  Matches inside an exception phrase don't count.
The weights of a text's matches are added, normalised by its length, and mapped to 0..1.

The lexicon is learned from a bounded number of labelled rows (``FIT_ROWS``, one for each doc_id); nothing else
bounds it, and scoring covers every row.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.common import free_name, own_columns, table, with_text_column

FIT_ROWS = 16_000  # labelled rows the lexicon is fitted on, at most
CHANCE = 3  # how much rarer than once among all candidates an entry's share must be by chance, in powers of e
THRESHOLD = 0.7
EXPONENTS = (0.1, 0.25, 0.5)
STEMS = range(4, 9)
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clown car", "idiot proof", "pond scum")

# Characters that look like, or are commonly typed for, a plain letter
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "х": "x", "у": "y", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ⅰ": "i", "ꜱ": "s", "@": "a",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}


class _Fold(dict):
    """Code point to folded text, filled in as characters are met."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        plain = HOMOGLYPHS.get(char) or DIGITS.get(char)
        if plain is None:
            wide = unicodedata.normalize("NFKC", char).lower()
            plain = DIGITS.get(wide) or HOMOGLYPHS.get(wide) or (wide if wide.isalnum() else " ")
        self[code] = plain
        return plain


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Lower-cased text of plain letters, digits that stand for none, and single blanks; blanks at both ends."""
    words = unicodedata.normalize("NFC", text or "").lower().translate(_FOLD).split()
    return f" {' '.join(words)} " if words else " "


def features(words: list[str]) -> Iterator[tuple[str, str]]:
    """Candidate entries of a text with the word before each: whole words and word beginnings."""
    before = ""
    for w in words:
        if 3 <= len(w) <= 24:
            yield f" {w} ", before
            for k in STEMS:
                if k > len(w):
                    break
                yield f" {w[:k]}", before
        before = w


class Lexicon:
    """Entries with weights, exception phrases, the length exponent and the cut that maps to the threshold."""

    def __init__(self, weights: dict[str, float], exceptions=EXCEPTIONS, exponent: float = 0.25, cut: float = 1.0):
        self.weights, self.exceptions, self.exponent, self.cut = dict(weights), tuple(exceptions), exponent, cut

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight, entry))
        for phrase in self.exceptions:
            if len(phrase := fold(phrase)) > 1 and phrase not in self.weights:
                found.add_word(phrase, (len(phrase), None, phrase))
        if len(found):
            found.make_automaton()
        return found

    def matches(self, folded: str, automaton) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the counted matches."""
        if not len(automaton):
            return []
        hits, spans = [], []
        for end, (length, weight, _) in automaton.iter(folded):
            (spans if weight is None else hits).append((end + 1 - length, end + 1, weight))
        if spans:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in spans)]
        return hits

    def raw(self, folded: str, automaton) -> float:
        """Weights of the matches over a power of the length in hundreds of words."""
        total = sum(w for _, _, w in self.matches(folded, automaton))
        return total / (1 + folded.count(" ") / 100) ** self.exponent if total else 0.0

    def score(self, raw: float) -> float:
        """0 without matches, ``THRESHOLD`` at the cut, towards 1 above."""
        return -math.expm1(math.log1p(-THRESHOLD) * raw / self.cut)


def _unlearnable(doc_id: str) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``text, toxic`` of labelled rows whose crc32(doc_id) mod 3 isn't 1: all, or ``fit_rows`` of them by hash.

    Rows with a null doc_id, label or text aren't learned from; an id with several labels counts as toxic if any
    is, an id with several texts gives the one with the smallest hash.
    """
    known = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null").filter(~_unlearnable("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = own_columns(docs, doc_id="doc_id", text="text").filter("text is not null")
    texts = texts.join(F.broadcast(known), "doc_id")  # fit_rows ids and labels, 16 bytes each
    return texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Lexicon:
    """Fit the lexicon; without toxic training rows it is empty and every score is 0.

    An entry's support is the smaller of the toxic texts that hold it and the distinct words seen before it
    there, so that copies of one text don't make its words entries.  Entries are kept if their share of
    toxic texts can't be chance among all candidates, then reduced to the longest forms that lose no support.
    """
    from pyspark import StorageLevel

    rows = training_rows(docs, labels, fit_rows).persist(StorageLevel.DISK_ONLY)
    try:
        sizes = {r.t: r.n for r in rows.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
        n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
        if not n_toxic:
            return Lexicon({})

        def toxic_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            docs_with, before = Counter(), Counter()
            for batch in batches:
                for text in batch.column(0):
                    seen: dict[str, int] = {}
                    for entry, word in features(fold(text.as_py()).split()):
                        seen[entry] = seen.get(entry, 0) | 1 << sum(word.encode()) * 31 % 61
                    for entry, bits in seen.items():
                        docs_with[entry] += 1
                        before[entry] |= bits
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(docs_with), pa.string()), pa.array(list(docs_with.values()), pa.int64()), pa.array([before[x] for x in docs_with], pa.int64())],
                names=["entry", "n", "bits"],
            )

        counted = (
            rows.filter("toxic > 0").select("text").mapInArrow(toxic_features, "entry string, n long, bits long")
            .groupBy("entry").agg(F.sum("n").alias("n"), F.bit_count(F.bit_or("bits")).alias("varied"))
            .filter("n >= 3 and varied >= 3")
        )
        counted = counted.select("entry", "n", F.when(F.col("varied") < 30, F.least("n", "varied")).otherwise(F.col("n")).alias("s"))
        counted = counted.persist(StorageLevel.DISK_ONLY)
        candidates = counted.count()
        # even without a clean text an entry needs this support to be beyond chance
        least = bar(candidates) / -math.log(base_rate(n_toxic, n_clean))
        support = {r.entry: (r.n, r.s) for r in counted.filter(F.col("s") >= math.floor(least)).collect()}
        counted.unpersist()
        wanted = set(support)

        def clean_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            docs_with: Counter = Counter()
            for batch in batches:
                for text in batch.column(0):
                    docs_with.update({entry for entry, _ in features(fold(text.as_py()).split())} & wanted)
            yield pa.RecordBatch.from_arrays([pa.array(list(docs_with), pa.string()), pa.array(list(docs_with.values()), pa.int64())], names=["entry", "n"])

        clean = rows.filter("toxic <= 0").select("text").mapInArrow(clean_features, "entry string, n long")
        harmless = {r.entry: r.n for r in clean.groupBy("entry").agg(F.sum("n").alias("n")).collect()}
        weights = select_entries(support, harmless, n_toxic, n_clean, candidates)
        lexicon = Lexicon(weights)
        return calibrate(lexicon, rows)
    finally:
        rows.unpersist()


def base_rate(n_toxic: int, n_clean: int) -> float:
    return (n_toxic + 1) / (n_toxic + n_clean + 2)


def bar(candidates: int) -> float:
    """What an entry's surprise must exceed, by the number of candidates."""
    return math.log(max(2, candidates)) + CHANCE


def select_entries(
    support: dict[str, tuple[int, int]], harmless: dict[str, int], n_toxic: int, n_clean: int, candidates: int | None = None
) -> dict[str, float]:
    """Entries and weights from counts; see :func:`learn`.  ``candidates``: how many there were, if not all are given."""
    base, least = base_rate(n_toxic, n_clean), bar(len(support) if candidates is None else candidates)
    strong = {}
    for entry, (_, s) in support.items():
        bad = harmless.get(entry, 0)
        share = s / (s + bad)
        if share <= max(base, 0.6):
            continue
        surprise = s * math.log(share / base) + (bad * math.log((1 - share) / (1 - base)) if bad else 0)
        if surprise > least:
            strong[entry] = s
    # the longest forms that keep the support of their beginnings, then no entry that begins with another
    kept = dict(strong)
    for entry in sorted(strong, key=len, reverse=True):
        shorter = entry.rstrip(" ")
        while len(shorter) > 1 + STEMS.start:
            if shorter != entry and shorter in kept and strong[entry] >= 0.95 * strong[shorter]:
                del kept[shorter]
            shorter = shorter[:-1]
        if shorter != entry and shorter in kept and strong[entry] >= 0.95 * strong[shorter]:
            del kept[shorter]
    for entry in sorted(kept, key=len, reverse=True):
        if any(entry[:k] in kept for k in range(2, len(entry))):
            del kept[entry]
    odds = lambda e: math.log((support[e][0] + 0.5) / (n_toxic + 1)) - math.log((harmless.get(e, 0) + 0.5) / (n_clean + 1))
    return {e: round(max(0.1, odds(e)), 6) for e in sorted(kept)}


def calibrate(lexicon: Lexicon, rows: DataFrame) -> Lexicon:
    """Learn exception phrases, and choose exponent and cut for the best F1 on the (bounded) training rows."""
    phrases = _phrases(lexicon, rows)
    lexicon = Lexicon(lexicon.weights, (*lexicon.exceptions, *phrases))
    best = None
    for exponent in EXPONENTS:
        trial = Lexicon(lexicon.weights, lexicon.exceptions, exponent)
        scored = sorted(((r.raw, r.toxic) for r in raw_scores(rows, trial, "toxic").collect()), reverse=True)
        total, right = sum(t for _, t in scored), 0
        for i, (raw, toxic) in enumerate(scored):
            right += toxic
            after = scored[i + 1][0] if i + 1 < len(scored) else 0.0
            if raw <= 0 or after == raw:
                continue
            f1 = 2 * right / (i + 1 + total)
            margin = math.log(raw / after) if after > 0 else 9.0
            if best is None or (round(f1, 6), margin) > best[0]:
                best = ((round(f1, 6), margin), exponent, math.sqrt(raw * after) if after > 0 else raw * 0.5)
    return Lexicon(lexicon.weights, lexicon.exceptions, best[1], best[2]) if best else lexicon


def _phrases(lexicon: Lexicon, rows: DataFrame) -> list[str]:
    """Two-word phrases around entries that clean training texts hold (3 at least) and toxic ones don't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            found = []
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                folded, own = fold(text.as_py()), set()
                for a, b, _ in lexicon.matches(folded, automaton):
                    start, stop = folded.rfind(" ", 0, max(a, 0)) + 1, folded.find(" ", b - 1 if folded[b - 1] == " " else b)
                    word = folded[a:stop].strip()
                    left, right = folded[start:a].strip(), folded[stop + 1 :].split(" ", 1)[0]
                    own |= {f"{left} {word}"} if left else set()
                    own |= {f"{word} {right}"} if right else set()
                found += [(p, int(toxic > 0)) for p in own]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([t for _, t in found], pa.int64())], names=["phrase", "toxic"])

    seen = rows.select("text", F.col("toxic").cast("long")).mapInArrow(run, "phrase string, toxic long").groupBy("phrase")
    seen = seen.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).filter("toxic = 0 and n >= 3")
    return sorted(r.phrase for r in seen.collect())


def with_raw(docs: DataFrame, lexicon: Lexicon, name: str) -> DataFrame:
    """``docs`` with its raw scores in column ``name``; narrow."""

    def prepare():
        automaton = lexicon.automaton()
        return lambda texts: [lexicon.raw(fold(t), automaton) for t in texts]

    return with_text_column(docs, name, "double", prepare)


def raw_scores(rows: DataFrame, lexicon: Lexicon, kept: str) -> DataFrame:
    """``raw`` beside column ``kept`` for every row of ``rows(text, ...)``."""
    return with_raw(rows.select("text", F.col(kept).cast("long").alias(kept)), lexicon, "raw").select("raw", kept)


def _score(raw: F.Column, lexicon: Lexicon) -> F.Column:
    return F.least(F.lit(1.0), F.lit(1.0) - F.exp(F.lit(math.log1p(-THRESHOLD)) * raw / F.lit(float(lexicon.cut))))


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text)``.

    Null and empty texts score 0.  A null doc_id isn't held out.  Repeated rows keep a row each; an empty table
    gives no rows; other columns don't matter.
    """
    rows = raw_scores(own_columns(docs, doc_id="doc_id", text="text"), lexicon, "doc_id")
    held_out = F.coalesce(_unlearnable("doc_id"), F.lit(False)).alias("held_out")
    rows = rows.select("doc_id", held_out, _score(F.col("raw"), lexicon).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, unchanged, whatever their columns are called.

    Null and empty texts score 0 and stay, repeated rows share their fate, an empty table stays empty.
    """
    name = free_name(docs, "raw")
    return with_raw(docs, lexicon, name).filter(_score(F.col(name), lexicon) < THRESHOLD).select(*docs.columns)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn the lexicon from the labels that may be learned from, and score the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    return scored(docs, learn(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLE_SQL: dict[str, str] = {}
