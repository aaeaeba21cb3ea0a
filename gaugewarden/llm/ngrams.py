"""Counts of hashed byte trigrams."""

import numpy as np

#: Lower case of A-Z; digits, controls, ASCII punctuation and spaces become one space.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)
_KEEP = np.arange(256, dtype=np.uint8)
#: Odd multiplier of the hash.
_MIX = np.uint32(2654435761)


def trigrams(text: str, dims: int, fold: bool):
    """The text's hashed byte trigrams in order, each below ``dims`` (a power of two), as arrays of a bounded piece each.

    With ``fold`` only letters and their boundaries count; else bytes are taken
    as they are. Long texts are read in pieces that overlap by two bytes.
    """
    data = np.frombuffer(f" {text} ".encode(), np.uint8)
    table = _FOLD if fold else _KEEP
    shift = np.uint32(32 - dims.bit_length() + 1)
    for i in range(0, max(1, len(data) - 2), 1 << 20):
        b = table[data[i:i + (1 << 20) + 2]].astype(np.uint32)
        h = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * _MIX >> shift
        yield h[b[1:-1] != 32] if fold else h  # the middle byte is a letter


def trigram_counts(text: str, dims: int, fold: bool) -> np.ndarray:
    """``dims`` counts of the text's ``trigrams``, as 32-bit floats."""
    out = np.zeros(dims, np.float32)
    for h in trigrams(text, dims, fold):
        out += np.bincount(h, minlength=dims)
    return out
