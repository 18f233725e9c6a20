"""Word n-grams of texts as 64-bit hashes, computed over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

_R, _C = np.uint64(0x9E3779B97F4A7C15), 1_000_003
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes worked on at a time.
SLICE = 1 << 20


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        back = np.uint64(pow(int(_R), -1, 1 << 64))
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _R)]), dtype=np.uint64)
        _inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, back)]), dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def word_hashes(raw: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word (a run of bytes that are not ASCII white space)."""
    data = np.frombuffer(raw, np.uint8) if isinstance(raw, (bytes, bytearray, memoryview)) else raw
    hashes, places, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        while end < len(data) and not _SPACE[data[end - 1]]:
            near = np.flatnonzero(_SPACE[data[end : end + SLICE]])
            end = end + int(near[0]) + 1 if len(near) else min(len(data), end + SLICE)
        part = data[at:end]
        gap = np.concatenate([[True], _SPACE[part], [True]])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        first, last = edge[::2], edge[1::2]
        _grow(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _powers[: len(part)], out=sums[1:])
        h = (sums[last] - sums[first]) * _inverse[first]
        hashes.append(mixed(h + (last - first).astype(np.uint64) * np.uint64(_C)))
        places.append(first + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of one text's word hashes; a shorter text is one n-gram, a text without words has none."""
    k = min(n, len(words))
    if k == 0:
        return words
    out = np.full(len(words) - k + 1, np.uint64(k * 0x632BE59BD9B4E019 % (1 << 64)), np.uint64)
    for i in range(k):
        out = (out ^ words[i : len(words) - k + 1 + i]) * np.uint64(0x9FB21C651E98DF25) + np.uint64(i)
    return mixed(out)


def many_ngrams(texts: list[str | None], n: int):
    """n-gram hashes of each text; short texts are hashed together, as calls cost more than bytes."""
    run, size = [], 0

    def done():
        lengths = np.array([len(r) + 1 for r in run])
        h, at = word_hashes(b"\n".join(run))
        cut = np.searchsorted(at, np.concatenate([[0], np.cumsum(lengths)]))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield ngrams(h[a:b], n)

    for t in texts:
        run.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(run[-1])
        if size >= SLICE // 4:
            yield from done()
            run, size = [], 0
    if run:
        yield from done()
