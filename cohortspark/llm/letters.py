"""Texts as arrays of letters: what a reader takes for the same letter gets the same code, everything else is dropped."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SIZE = 0x110000
#: Scripts without case or decomposition, whose letters stand for themselves.
_PLAIN_RANGES = ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x32000))
_SCANNED_RANGES = ((0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x10000), (0x10000, 0x10800), (0x1D400, 0x1D800))
_table: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Code of each code point: letters and digits without case, accents and width; 0 for what isn't read as a letter."""
    global _table
    if _table is None:
        table = np.zeros(_SIZE, dtype=np.uint32)
        for low, high in _PLAIN_RANGES:
            table[low:high] = np.arange(low, high, dtype=np.uint32)
        for low, high in _SCANNED_RANGES:
            for code in range(low, high):
                category = unicodedata.category(chr(code))
                if category[0] not in "LN" and category not in ("Mc", "Mn") or category == "Lm":
                    continue
                if category == "Mn" and not 0x0900 <= code < 0x0F00:  # marks count in scripts that write vowels as marks
                    continue
                base = unicodedata.normalize("NFKD", chr(code)).casefold()
                base = "".join(c for c in base if not 0x300 <= ord(c) < 0x370 and ord(c) not in (0x3099, 0x309A, 0x93C) and not 0x64B <= ord(c) < 0x660)
                if base and (base[0].isalnum() or category[0] == "M"):
                    table[code] = ord(base[0])
        _table = table
    return _table


def letters(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = letter_table()[codes]
    return found[found > 0]


def is_dense(codes: np.ndarray) -> np.ndarray:
    """Ideographs, kana and syllable blocks: scripts of which a few letters say as much as a dozen elsewhere."""
    return ((codes >= 0x3040) & (codes < 0xA000)) | ((codes >= 0xAC00) & (codes < 0xD7A4)) | (codes >= 0x20000)


def pieces(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `most` characters of a column, or of one row: bounds a task's memory."""
    lengths = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)
