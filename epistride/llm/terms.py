"""Hashes of a text's tokens, computed for many texts at once with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Long texts are worked on in parts of about so many bytes, cut between tokens.
PART_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: Byte classes: 0 separates, equal classes in a row make a token.
LETTERS = np.array([1 if chr(c).isalnum() and c < 128 or c >= 128 else 0 for c in range(256)], np.uint8)
LETTERS_AND_MARKS = np.array([0 if c <= 32 else 1 if LETTERS[c] else 2 for c in range(256)], np.uint8)
WORDS = np.array([0 if c == 32 or 9 <= c <= 13 else 1 for c in range(256)], np.uint8)


def _power(kind: str, size: int) -> np.ndarray:
    if len(_powers[kind]) < size:
        step = _BASE if kind == "up" else np.uint64(pow(int(_BASE), -1, 1 << 64))
        factors = np.full(max(size, 1 << 16), step, np.uint64)
        factors[0] = 1
        _powers[kind] = np.cumprod(factors, dtype=np.uint64)
    return _powers[kind]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * _MIX_A
    h = (h ^ h >> np.uint64(27)) * _MIX_B
    return h ^ h >> np.uint64(31)


class Tokens:
    """Token starts and ends in a buffer, and hashes of any of their parts."""

    def __init__(self, data: bytes, classes: np.ndarray) -> None:
        raw = np.frombuffer(data, np.uint8)
        kind = classes[raw]
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        starts = np.r_[0, edge].astype(np.int64) if len(raw) else np.zeros(0, np.int64)
        ends = np.r_[edge, len(raw)].astype(np.int64) if len(raw) else starts
        full = kind[starts] != 0 if len(raw) else np.zeros(0, bool)
        self.starts, self.ends = starts[full], ends[full]
        self._sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw + np.uint64(1)) * _power("up", len(raw))[: len(raw)], out=self._sums[1:])

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, longest: int | None = None, salt: int = 0) -> np.ndarray:
        """Hash of each token, or of its first ``longest`` bytes."""
        ends = self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        plain = (self._sums[ends] - self._sums[self.starts]) * _power("down", len(self._sums))[self.starts]
        return mixed(plain + np.uint64((salt + 1) * int(_MIX_B) & (1 << 64) - 1))


def parts(texts: list[bytes], classes: np.ndarray, limit: int = PART_BYTES) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(buffer, row, offset): texts joined by a separator up to ``limit`` bytes; ``row`` of each text begun at ``offset``.

    A longer text is cut after a separator into parts of its own; a token is
    never cut.
    """
    held: list[bytes] = []
    rows: list[int] = []
    size = 0

    def buffer() -> tuple[bytes, np.ndarray, np.ndarray]:
        at = np.cumsum([0] + [len(t) + 1 for t in held[:-1]])
        return b"\n".join(held), np.array(rows, np.int64), at

    for row, text in enumerate(texts):
        start = 0
        while True:
            piece = text[start:] if start else text
            if len(piece) > limit:
                free = np.flatnonzero(classes[np.frombuffer(text, np.uint8, offset=start + limit)] == 0)
                piece = text[start : start + limit + int(free[0]) + 1] if len(free) else piece
            if held and size + len(piece) > limit:
                yield buffer()
                held, rows, size = [], [], 0
            held.append(piece)
            rows.append(row)
            size += len(piece) + 1
            start += len(piece)
            if start >= len(text):
                break
    if held:
        yield buffer()
