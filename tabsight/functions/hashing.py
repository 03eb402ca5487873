"""Spark's ``xxhash64`` over integer columns in numpy: the same hashes, many at once in a task.

``xxhash64(a, b, ...)`` hashes every value with the hash of those before it as
seed, so a hash made by Spark can be carried on here.
"""

from __future__ import annotations

import numpy as np

_P1, _P2, _P3, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_FOUR, _LOW = np.uint64(4), 0xFFFFFFFF


def hash_ints(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Signed hashes of 32-bit ``values`` after columns whose hashes are ``seeds`` (signed or not; shapes broadcast)."""
    words = (np.atleast_1d(values).astype(np.int64) & _LOW).astype(np.uint64)
    h = (np.asarray(seeds).astype(np.int64).view(np.uint64) + (_P5 + _FOUR)) ^ (words * _P1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    return h.view(np.int64)
