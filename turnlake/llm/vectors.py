"""Hashed words of whole batches of text, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words as runs outside [\x20\x09-\x0D], and as runs of letters and digits (every byte beyond ASCII counts).
SPACED = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
LETTERS = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])

_BASE = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 19
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers, one to one (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, _PIECE + 4096)
        up, down = np.full(size, _BASE), np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(data: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, 64-bit hash) of every run of bytes in letters; worked through in pieces cut between words."""
    inside = letters[data]
    starts_all, hashes_all, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + _PIECE)
        if end < len(data):
            gap = np.flatnonzero(~inside[end:end + 65536])
            end = end + int(gap[0]) if len(gap) else (end + int(np.argmin(inside[end:])) if not inside[end:].all() else len(data))
        part, within = data[at:end], inside[at:end]
        edge = np.diff(np.concatenate([[False], within, [False]]).view(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(starts):
            up, down = _power(len(part))
            sums = np.concatenate([[np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up)])
            h = (sums[ends] - sums[starts]) * down[starts]
            hashes_all.append(mixed(h + (ends - starts).astype(np.uint64)))
            starts_all.append(starts + at)
        at = end
    if not starts_all:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts_all), np.concatenate(hashes_all)


def groups_of(texts: list[str | None], most_bytes: int) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, lower-cased texts) of consecutive texts, most_bytes together or a single one."""
    first, group, size = 0, [], 0
    for i, t in enumerate(texts):
        b = (t or "").lower().encode("utf-8", "replace")
        if group and size + len(b) > most_bytes:
            yield first, group
            first, group, size = i, [], 0
        group.append(b)
        size += len(b)
    if group:
        yield first, group


def hashed_words(texts: list[bytes], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, offsets (len(texts) + 1) of each text's words)."""
    data = np.frombuffer(b" ".join(texts) or b" ", np.uint8)
    starts, hashes = word_hashes(data, letters)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, begins)


def shingles(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of runs of n words within each text; a shorter text with words has one, of all its words."""
    count = np.diff(offsets)
    width = np.minimum(count, n)
    total = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(total)])
    row = np.repeat(np.arange(len(count)), total)
    at = offsets[:-1][row] + np.arange(len(row)) - out_offsets[:-1][row]
    h = np.zeros(len(row), np.uint64)
    for k in range(n):
        there = k < width[row]
        w = words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else np.zeros(len(row), np.uint64)
        h = np.where(there, mixed(h * _BASE + w), h)
    return h, out_offsets
