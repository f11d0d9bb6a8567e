"""Words, lines and shingles of whole Arrow batches of texts, computed in bulk.

Words are runs of anything but ASCII white space (space, tab, line feed, vertical tab, form feed, carriage return).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
#: Constants of the splitmix64 generator.
GAMMA, MIX1, MIX2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer: a bijection of 64-bit words that scatters neighbouring inputs."""
    x = x + GAMMA
    x = (x ^ (x >> U64(30))) * MIX1
    x = (x ^ (x >> U64(27))) * MIX2
    return x ^ (x >> U64(31))


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash for each position from several aligned 64-bit hashes; their order matters."""
    h = mix(parts[0])
    for p in parts[1:]:
        h = mix((h * U64(0x100000001B3)) ^ mix(p))
    return h


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The text column with nulls as empty texts, with 64-bit offsets."""
    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


def words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of the batch in order, and the offsets of each text among them (one more than there are texts)."""
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    flat, offsets = parts.flatten(), np.asarray(parts.offsets).astype(np.int64)
    offsets = offsets - offsets[0]
    real = np.asarray(pc.greater(pc.binary_length(flat), 0))
    before = np.concatenate([[0], np.cumsum(real)])
    return flat.filter(pa.array(real)), before[offsets]


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A code for each word and the distinct words by code."""
    d = pc.dictionary_encode(flat)
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return np.asarray(d.indices).astype(np.int64), d.dictionary


def hashes(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in distinct.to_pylist()), dtype=np.uint64, count=len(distinct))


def owner(offsets: np.ndarray) -> np.ndarray:
    """For each item the number of the text that it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def summed(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums by text; empty texts have 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def windows(word_hash: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of k words inside each text, and where each begins among all words."""
    n = len(word_hash)
    if n < k:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    starts = np.arange(n - k + 1)
    doc = owner(offsets)
    starts = starts[doc[: n - k + 1] == doc[k - 1 :]]
    h = chain([word_hash[i : n - k + 1 + i] for i in range(k)])
    return h[starts], starts


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of distinct k-word shingles as sorted 64-bit hashes, one after another, and the offsets of the texts.

    Words have A-Z lowered.  A text with fewer words than k has its whole sequence as its one shingle; without words the set is empty."""
    flat, offsets = words(texts, lower=True)
    code, distinct = coded(flat)
    h = hashes(distinct)[code] if len(code) else np.zeros(0, U64)
    win, at = windows(h, offsets, k)
    doc = owner(offsets)
    doc_of = doc[at] if len(at) else np.zeros(0, np.int64)
    counts = np.diff(offsets)
    parts, sizes = [], np.zeros(len(texts), np.int64)
    cut = np.searchsorted(doc_of, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        if counts[i] >= k:
            s = np.unique(win[cut[i] : cut[i + 1]])
        elif counts[i]:
            s = chain([np.array([x], U64) for x in h[offsets[i] : offsets[i + 1]]]) ^ U64(counts[i])
        else:
            continue
        parts.append(s)
        sizes[i] = len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(sizes)])
