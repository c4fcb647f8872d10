"""Quality rules by repetition: suffix array, longest common prefixes, covered fraction and longest repeat.

The suffix array of a text's words is built by prefix doubling over many texts at once: a suffix is keyed by
its document, so suffixes of different documents never tie, and only ties are sorted again.  The ranks of
every doubling step are kept, which gives the longest common prefix of neighbours in the array by binary
descent.  A suffix's deepest longest-common-prefix interval has the larger of its two neighbouring values as
depth: that is the longest repeated run of words that starts there, a maximal repeat.  The union of those
spans over all places gives the covered words.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.common import free_name, own_columns, table, with_text_column

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SPACES = bytes([0x20, *range(0x09, 0x0E)])
SYMBOLS = b"#*$%&|<>"
CHUNK_WORDS = 300_000

MIN_REPEAT = 8  # words; shorter repeats are common turns of phrase
MAX_COVERED = 0.30  # of a text's words; the base rule allows half of them in repeats of three words
MAX_LONGEST = 100  # words


def longest_repeats(words: np.ndarray, document: np.ndarray) -> np.ndarray:
    """For each place, the length of the longest run of words from it that also starts elsewhere in its document.

    ``words`` are integers, ``document`` ascending integers of the same length; occurrences may overlap.
    """
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.int64)
    end = np.searchsorted(document, document, side="right")
    key = document.astype(np.int64) * (int(words.max()) + 1) + words
    sa = np.argsort(key, kind="stable")
    sorted_key = key[sa]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    place = np.arange(n)
    # every step's ranks are kept, at four bytes a word
    rank = np.empty(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, place, 0))
    levels = [rank]
    tied = place[~(new & np.r_[new[1:], True])]
    step = 1
    while len(tied):
        at = sa[tied]
        follow = at + step
        second = np.where(follow < end[at], rank[np.minimum(follow, n - 1)], -1)
        first = rank[at]
        order = np.lexsort((second, first))
        at, first, second = at[order], first[order], second[order]
        sa[tied] = at
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        levels.append(rank)
        tied = tied[~(new & np.r_[new[1:], True])]
        step *= 2
    # longest common prefix of each suffix with the one before it in the array, from the longest step down
    live = 1 + np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]])
    a, b = sa[live - 1], sa[live]
    common = np.zeros(len(live), dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        i, j = a + common, b + common
        inside = (i < end[a]) & (j < end[b])
        i, j = np.minimum(i, n - 1), np.minimum(j, n - 1)
        common += np.where(inside & (levels[level][i] == levels[level][j]), 1 << level, 0)
    lcp = np.zeros(n + 1, dtype=np.int64)
    lcp[live] = common
    best = np.empty(n, dtype=np.int64)
    best[sa] = np.maximum(lcp[:-1], lcp[1:])
    return best


def covered(best: np.ndarray, least: int, length: np.ndarray | int) -> np.ndarray:
    """Which places lie in a span [i, i + length) for an i with ``best[i] >= least``; spans end with their document."""
    n = len(best)
    starts = np.flatnonzero(best >= least)
    ends = starts + (length if np.isscalar(length) else length[starts])
    reach = np.zeros(n + 1, dtype=np.int64)
    np.add.at(reach, starts, 1)
    np.add.at(reach, ends, -1)
    return np.cumsum(reach[:-1]) > 0


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_covered", "repeat_longest")


def _chunk(texts: list[bytes], min_repeat: int) -> list[tuple]:
    """The measures of some texts, worked out together."""
    out, all_words, sizes = [], [], []
    for raw in texts:
        words = WORD.findall(raw)
        characters = len(raw.decode("utf-8", "surrogatepass")) - (len(raw) - len(raw.translate(None, SPACES)))
        lines = [x for x in raw.split(b"\n") if x.translate(None, SPACES)]
        out.append((len(words), characters, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines))))
        all_words += words
        sizes.append(len(words))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in all_words), np.int64, len(all_words))
    best = longest_repeats(ids, np.repeat(np.arange(len(texts)), sizes))
    bounds = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    totals = [np.r_[0, np.cumsum(x)] for x in (covered(best, 3, 3), covered(best, min_repeat, best))]
    rows = []
    for i, row in enumerate(out):
        a, b = bounds[i], bounds[i + 1]
        rows.append((*row, *(int(t[b] - t[a]) for t in totals), int(best[a:b].max()) if b > a else 0))
    return rows


def measure(texts: list[str | None], min_repeat: int = MIN_REPEAT) -> list[dict]:
    """The measures of every text; null texts have no words.  Texts are grouped up to about CHUNK_WORDS words."""
    rows, held, size = [], [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) // 4 > CHUNK_WORDS:
            rows += _chunk(held, min_repeat)
            held, size = [], 0
        held.append(raw)
        size += len(raw) // 4
    rows += _chunk(held, min_repeat) if held else []
    return [dict(zip(FIELDS, r)) for r in rows]


def with_measures(docs: DataFrame, name: str, min_repeat: int = MIN_REPEAT) -> DataFrame:
    """``docs`` with a struct of its texts' measures in column ``name``; narrow.

    ``repeat_covered`` counts words in repeats of at least ``min_repeat`` words, ``repeat_longest`` is the
    longest repeat in words (0 if no word occurs twice).
    """
    ddl = "struct<" + ", ".join(f"{f}: long" for f in FIELDS) + ">"
    return with_text_column(docs, name, ddl, lambda: lambda texts: measure(texts, min_repeat))


def _failed(m: str) -> F.Column:
    """Under 50 words, or over half of the words in 3-word windows found twice."""
    return (F.col(f"{m}.n_words") < 50) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))


def _calm(m: str, max_covered: float, max_longest: int) -> F.Column:
    return (F.col(f"{m}.repeat_covered") <= max_covered * F.col(f"{m}.n_words")) & (F.col(f"{m}.repeat_longest") <= max_longest)


def judged(
    docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST
) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: its measures, ``base_failed`` and ``kept``.

    A text that passes the base rules is kept if the fraction of its words covered by repeats and its longest
    repeat are within the limits.  Empty and null texts fail; repeated rows and doc_ids keep a row each; an empty
    table gives no rows.
    """
    m = with_measures(own_columns(docs, doc_id="doc_id", text="text"), "m", min_repeat)
    kept = ~_failed("m") & _calm("m", max_covered, max_longest)
    return m.select("doc_id", "m.*", _failed("m").alias("base_failed"), kept.alias("kept"))


def without_repetitive(
    docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST
) -> DataFrame:
    """The rows of ``docs`` that :func:`judged` keeps, unchanged, whatever their columns are called.

    Null and empty texts go, repeated rows share their fate, an empty table stays empty.
    """
    m = free_name(docs, "measures")
    kept = ~_failed(m) & _calm(m, max_covered, max_longest)
    return with_measures(docs, m, min_repeat).filter(kept).select(*docs.columns)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition rules over the whole ``documents`` table."""
    return judged(table(spark, sf_dir, "documents")).drop("repeat_longest")


def _windows(name: str, size: int) -> str:
    """SQL: places of windows of ``size`` words that a text has twice or more."""
    return (
        f"{name} AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, hash(list_slice(w, i, i + {size - 1}))) AS n "
        f"FROM (SELECT doc_id, w, unnest(range(1, len(w) - {size - 2})) AS i FROM d)) WHERE n > 1)"
    )


def _covered_words(name: str, size: int) -> str:
    return f"(SELECT doc_id, count(DISTINCT i + k) AS n FROM {name}, range({size}) r(k) GROUP BY doc_id)"


QUERIES = {"op4_quality": op4_quality}
# a word is in a repeat of 8 words or more just when it is in an 8-word window found twice
ORACLE_SQL = {
    "op4_quality": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
{_windows("three", 3)}, {_windows("long", MIN_REPEAT)}, {_windows("too_long", MAX_LONGEST + 1)},
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines,
  coalesce(t.n, 0) AS n_repeat_words, coalesce(c.n, 0) AS repeat_covered, d.doc_id IN (SELECT doc_id FROM too_long) AS too_long
  FROM d LEFT JOIN lines l USING (doc_id) LEFT JOIN {_covered_words("three", 3)} t USING (doc_id) LEFT JOIN {_covered_words("long", MIN_REPEAT)} c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, repeat_covered, base_failed,
  NOT base_failed AND repeat_covered <= {MAX_COVERED} * n_words AND NOT too_long AS kept FROM b
"""
}
