"""Statistics of whole texts that the quality operators share, computed over Arrow batches.

``with_statistics(docs)`` keeps every column of docs and adds one struct column; its name is chosen so that it clashes with none.
Null and empty texts have 0 everywhere.  Fields:

n_words, word_chars (code points in words), n_symbols (characters of ``#*$%&|<>``), n_dup_lines (lines with a word that equal an
earlier line), n_repeat_words (words inside windows of 5 words that occur twice or more in the text), then shares as doubles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lamina.llm import arrow_text as at
from lamina.llm.common import bounded, trimmed

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("log_words", "symbol_share", "bang_share", "upper_share", "digit_share", "dup_line_share", "repeat_share", "type_share", "mean_word", "punct_share", "same_share", "bar_share", "words_per_line")
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
STRUCT = T.StructType([T.StructField(c, T.LongType(), False) for c in COUNTS] + [T.StructField(c, T.DoubleType(), False) for c in SHARES])


def _classes(of: bytes) -> np.ndarray:
    lut = np.zeros(256, np.int64)
    lut[list(of)] = 1
    return lut


_LUTS = {
    "symbol": _classes(SYMBOLS),
    "bang": _classes(b"!"),
    "upper": _classes(bytes(range(65, 91))),
    "lower": _classes(bytes(range(97, 123))),
    "digit": _classes(b"0123456789"),
}


def _byte_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return {name: at.summed(lut[data], offsets - offsets[0]) for name, lut in _LUTS.items()}


def _repeated(word_hash: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True for each word inside a window that occurs twice or more in its text."""
    covered = np.zeros(len(word_hash), bool)
    win, starts = at.windows(word_hash, offsets, WINDOW)
    if len(win):
        key = at.mix(win ^ at.mix(at.owner(offsets)[starts].astype(np.uint64)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        begin = starts[order[twice]]
        for i in range(WINDOW):
            covered[begin + i] = True
    return covered


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Arrays by field for a column of texts without nulls."""
    n = len(texts)
    flat, offsets = at.words(texts)
    n_words = np.diff(offsets)
    code, distinct = at.coded(flat)
    doc = at.owner(offsets)
    chars = np.asarray(pc.utf8_length(distinct)).astype(np.int64)[code] if len(code) else np.zeros(0, np.int64)
    word_hash = at.hashes(distinct)[code] if len(code) else np.zeros(0, np.uint64)
    counts = _byte_counts(texts)
    ends = np.asarray(pc.match_substring_regex(distinct, r"[.,;:?]$")).astype(np.int64)[code] if len(code) else np.zeros(0, np.int64)
    bars = np.asarray(pc.equal(distinct, pa.scalar("|", distinct.type))).astype(np.int64)[code] if len(code) else np.zeros(0, np.int64)
    same = np.zeros(len(code), np.int64)
    if len(code) > 1:
        same[1:] = (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])
    kinds = np.unique(doc * max(len(distinct), 1) + code)
    types = np.bincount(kinds // max(len(distinct), 1), minlength=n) if len(kinds) else np.zeros(n, np.int64)

    parts = pc.split_pattern(texts, "\n")
    lines = parts.flatten()
    line_offsets = np.asarray(parts.offsets).astype(np.int64)
    line_offsets = line_offsets - line_offsets[0]
    wordy = np.asarray(pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0)).astype(bool)
    line_code, _ = at.coded(lines)
    line_doc = at.owner(line_offsets)
    key = (line_doc * (int(line_code.max(initial=0)) + 1) + line_code)[wordy]
    first = np.unique(key, return_index=True)[1]
    n_lines = np.bincount(line_doc[wordy], minlength=n)
    n_dup = n_lines - np.bincount(line_doc[wordy][first], minlength=n)

    n_repeat = at.summed(_repeated(word_hash, offsets).astype(np.int64), offsets)
    word_chars = at.summed(chars, offsets)
    per_word, letters = np.maximum(n_words, 1), np.maximum(counts["upper"] + counts["lower"], 1)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": counts["symbol"], "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "log_words": np.log1p(n_words), "symbol_share": counts["symbol"] / per_word, "bang_share": counts["bang"] / per_word, "upper_share": counts["upper"] / letters,
        "digit_share": counts["digit"] / np.maximum(word_chars, 1), "dup_line_share": n_dup / np.maximum(n_lines, 1), "repeat_share": n_repeat / per_word, "type_share": types / per_word,
        "mean_word": word_chars / per_word, "punct_share": at.summed(ends, offsets) / per_word, "same_share": at.summed(same, offsets) / per_word, "bar_share": at.summed(bars, offsets) / per_word,
        "words_per_line": n_words / np.maximum(n_lines, 1),
    }


def struct_of(stats: dict[str, np.ndarray]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(stats[c].astype(np.int64)) for c in COUNTS] + [pa.array(stats[c].astype(np.float64)) for c in SHARES], names=[*COUNTS, *SHARES])


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_statistics(docs: DataFrame, text_col: str = "text", name: str = "_stats") -> DataFrame:
    """docs with a struct of statistics as its last column.  Narrow: no shuffle, memory bounded by the Arrow batch."""
    bounded(docs.sparkSession)

    def run(batches):
        for batch in batches:
            stats = struct_of(statistics(at.column(batch, text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, stats], names=[*batch.schema.names, name])
        trimmed()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, STRUCT, False)]))
