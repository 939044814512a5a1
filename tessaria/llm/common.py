"""Shared helpers of the training-data operators: tables, the shared folder, word hashing.

Words are hashed inside Arrow tasks with numpy over the UTF-8 bytes of a whole text: one prefix sum gives every
word's hash and another every window's, so no Python loop runs over words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, shared_dir  # noqa: F401

M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, in a session whose Arrow batches hold at most `rows` rows: texts are long, and a worker holds a batch at a time."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
    return df


def carried(carry: tuple[str, ...], taken: tuple[str, ...]) -> list[F.Column]:
    """The columns to carry; one that is named like an output gets `_carried` after its name."""
    return [F.col(f"`{c}`").alias(f"{c}_carried" if c in taken else c) for c in carry]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only_ids(df: DataFrame, ids: DataFrame, key: str, n_ids: int, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows of df whose key is in ids. Up to broadcast_rows longs (8 MB) the ids are broadcast, else both sides shuffle."""
    return df.join(F.broadcast(ids) if n_ids <= broadcast_rows else ids, key, "left_semi")


# ---- word hashing ---------------------------------------------------------------------------------------------------

def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Separators of words `[^\x20\x09-\x0D]+`.
SPACES = _table(bytes([0x20, *range(0x09, 0x0E)]))
#: Separators of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of text whose A-Z are in lower case.
MARKS = _table(bytes(b for b in range(128) if not chr(b).isalnum()))

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_Q = np.uint64(0xC2B2AE3D27D4EB4F | 1)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown as longer texts come."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 14, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


_WORD, _WINDOW, _WINDOW2 = _Powers(_P), _Powers(_Q), _Powers(np.uint64(0x165667B19E3779F9 | 1))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(raw: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words' starts and ends."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~separators[raw]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of each word, A-Z taken as a-z if fold is set."""
    up, down = _WORD.get(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _BYTE)[raw] * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each run of k words; second: an independent one."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = (_WINDOW2 if second else _WINDOW).get(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((mix(words ^ np.uint64(0x5851F42D4C957F2D)) if second else words) * up[:n], out=total[1:])
    return mix((total[k:] - total[: n - k + 1]) * down[: n - k + 1] + np.uint64(k))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost smallest of each w neighbours."""
    return np.argmin(np.lib.stride_tricks.sliding_window_view(x, w), axis=1) + np.arange(len(x) - w + 1)


def raw_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
