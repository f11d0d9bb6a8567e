"""SuperMinHash signatures of sets of 64-bit hashes, for many sets at once.

Each element draws, step by step, the next place of a random permutation of the slots and a random fraction; at step j it offers
j + fraction to that place, and each slot keeps its least offer.  As every element spreads its offers over all slots in correlated ranks,
the signature estimates Jaccard similarity with less variance than independent minima.  Steps go over all elements of a batch together, and a
set stops as soon as all its slots hold an offer of an earlier step, for no later offer can be smaller: large sets need about one
step, so the cost for each element is nearly constant.
"""

from __future__ import annotations

import numpy as np

from lamina.llm.arrow_text import mix

U64 = np.uint64
_FRACTION = U64((1 << 48) - 1)
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)
#: At most so many permutation entries are held at once.
_CELLS = 1 << 24


def _draw(h: np.ndarray, step: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """For each element the place to swap with at this step, and its offer as step * 2^48 + fraction."""
    r = mix(h + U64((2 * step + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
    place = step + ((mix(r) >> U64(40)) * U64(slots - step) >> U64(24)).astype(np.int64)
    return place, (U64(step) << U64(48)) | (r & _FRACTION)


def signatures(elements: np.ndarray, offsets: np.ndarray, slots: int) -> np.ndarray:
    """One row of slots for each set: elements[offsets[i]:offsets[i + 1]].  Empty sets have only the largest value."""
    n = len(offsets) - 1
    sig = np.full((n, slots), _EMPTY, U64)
    flat = sig.reshape(-1)
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(n), sizes)
    place, offer = _draw(elements, 0, slots)
    np.minimum.at(flat, doc * slots + place, offer)
    open_ = np.flatnonzero((sizes > 0) & (sig == _EMPTY).any(1))
    if not len(open_):
        return sig
    # step 1 needs no permutation: slot 0 went to the first place drawn
    keep = np.zeros(n, bool)
    keep[open_] = True
    chosen = keep[doc]
    h, d, first = elements[chosen], doc[chosen], place[chosen]
    if slots > 1:
        place, offer = _draw(h, 1, slots)
        np.minimum.at(flat, d * slots + np.where(place == first, 0, place), offer)
    done = ~(sig[open_] == _EMPTY).any(1)
    rest = open_[~done]
    for part in np.array_split(rest, max(1, int(np.ceil(sizes[rest].sum() * slots / _CELLS)))) if len(rest) else []:
        _slowly(elements, offsets, part, flat, sig, slots)
    return sig


def _slowly(elements: np.ndarray, offsets: np.ndarray, sets: np.ndarray, flat: np.ndarray, sig: np.ndarray, slots: int) -> None:
    """Further steps, with the permutations held, for sets that are not full after two."""
    h = np.concatenate([elements[offsets[i] : offsets[i + 1]] for i in sets])
    d = np.repeat(sets, offsets[sets + 1] - offsets[sets])
    perm = np.tile(np.arange(slots, dtype=np.uint8 if slots < 256 else np.int32), (len(h), 1))
    for step in range(slots):
        rows = np.arange(len(h))
        place, offer = _draw(h, step, slots)
        target = perm[rows, place].copy()
        perm[rows, place] = perm[rows, step]
        perm[rows, step] = target
        if step < 2:
            continue
        np.minimum.at(flat, d * slots + target, offer)
        if step % 4 == 1 or step < 8:
            left = (sig == _EMPTY).any(1)[d]
            if not left.any():
                return
            if not left.all():
                h, d, perm = h[left], d[left], perm[left]


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of so many slots, different by band."""
    n, slots = sig.shape
    bands = slots // rows
    key = np.zeros((n, bands), U64) + mix(np.arange(bands, dtype=U64))
    for r in range(rows):
        key = mix((key * U64(0x100000001B3)) ^ sig[:, r : bands * rows : rows])
    return key
