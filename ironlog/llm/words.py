"""Words of whole texts as 64-bit hashes, computed over Arrow buffers without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` odd pseudorandom multipliers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(n, dtype=_U) + _U(seed + 1)) * _U(0x9E3779B97F4A7C15)) | _U(1)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = stream(1, 256)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_PLACE = stream(2, 1 << 12)


def _places(n: int) -> np.ndarray:
    return _PLACE if n <= len(_PLACE) else stream(2, n)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and the n + 1 places where they begin and end."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _windows(data: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about WINDOW bytes that end at white space or at a document's end."""
    a = 0
    while a < len(data):
        b = a + WINDOW
        if b >= len(data):
            b = len(data)
        else:
            stop = edges[np.searchsorted(edges, b)]
            while b < stop and not _IS_SPACE[data[b]]:
                b += 1
        yield a, b
        a = b


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, A-Z lower-cased, and the number of words of each text."""
    data, edges = text_bytes(texts)
    found, counts = [], np.zeros(len(edges) - 1, np.int64)
    for a, b in _windows(data, edges):
        part = data[a:b]
        inside = np.flatnonzero(~_IS_SPACE[part])
        if not len(inside):
            continue
        lo, hi = np.searchsorted(edges, [a, b], "left")
        first = np.empty(len(inside), bool)
        first[0] = True
        np.not_equal(inside[1:], inside[:-1] + 1, out=first[1:])
        at = np.searchsorted(inside, edges[lo:hi] - a)
        at = at[at < len(inside)]
        first[at] = True
        begins = np.flatnonzero(first)
        lengths = np.diff(np.append(begins, len(inside)))
        place = np.arange(len(inside)) - np.repeat(begins, lengths)
        with np.errstate(over="ignore"):
            value = _BYTE[part[inside]] * _places(int(lengths.max()))[place]
            found.append(mix(np.add.reduceat(value, begins) + lengths.astype(_U)))
        owner = np.searchsorted(edges, inside[begins] + a, "right") - 1
        counts += np.bincount(owner, minlength=len(counts))
    return (np.concatenate(found) if found else np.zeros(0, _U)), counts


_STEP = stream(3, 64)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words, and their number per text.

    A text of fewer words, but at least one, has one shingle: all its words.
    """
    ends = np.cumsum(counts)
    begins = ends - counts
    with np.errstate(over="ignore"):
        n = max(0, len(words) - width + 1)
        runs = np.zeros(n, _U)
        for j in range(width):
            runs += words[j : j + n] * _STEP[j]
        runs = mix(runs)
        short = np.flatnonzero((counts > 0) & (counts < width))
        per = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
        out = np.empty(int(per.sum()), _U)
        to = np.cumsum(per) - per
        keep = np.ones(n, bool)
        # runs that begin in the last width - 1 words of a text reach into the next one
        for j in range(1, width):
            gone = ends[counts >= j] - j
            keep[gone[gone < n]] = False
        place = np.ones(len(out), bool)
        place[to[short]] = False
        out[place] = runs[keep]
        for i in short:
            w = words[begins[i] : ends[i]]
            out[to[i]] = mix((w * _STEP[: len(w)]).sum(dtype=_U) + _U(len(w)))[()]
    return out, per
