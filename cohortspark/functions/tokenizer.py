"""Quote-aware tokenizer of delimited records: a finite-state machine run over whole Arrow batches.

All records of a batch form one array of code points that is cut into chunks of equal length. Each
chunk's effect on every possible start state is composed step by step (a chunk is a function from
state to state), the functions are composed across chunks by a prefix scan, and with the start states
known all chunks are walked at once. A record may span any number of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

_OTHER, _SEP, _QUOTE, _END, _PAD = range(5)
_START, _PLAIN, _QUOTED, _CLOSED, _BROKEN = range(5)
_CHUNK = 256

# rows: class of the character; columns: state before it
_NEXT = np.array(
    [
        [_PLAIN, _PLAIN, _QUOTED, _BROKEN, _BROKEN],
        [_START, _START, _QUOTED, _START, _BROKEN],
        [_QUOTED, _BROKEN, _CLOSED, _QUOTED, _BROKEN],
        [_START, _START, _START, _START, _START],
        [_START, _PLAIN, _QUOTED, _CLOSED, _BROKEN],
    ],
    dtype=np.uint8,
)


def states_before(classes: np.ndarray) -> np.ndarray:
    """State before each character, the first being a field's start."""
    n = len(classes)
    chunks = max(1, -(-n // _CHUNK))
    grid = np.full(chunks * _CHUNK, _PAD, dtype=np.uint8)
    grid[:n] = classes
    grid = grid.reshape(chunks, _CHUNK)
    effect = np.tile(np.arange(5, dtype=np.uint8), (chunks, 1))
    for j in range(_CHUNK):
        effect = _NEXT[grid[:, j, None], effect]
    step = 1
    while step < chunks:  # prefix scan: effect[i] becomes the effect of chunks 0..i
        effect[step:] = np.take_along_axis(effect[step:], effect[:-step].copy(), axis=1)
        step *= 2
    state = np.empty(chunks, dtype=np.uint8)
    state[0] = _START
    state[1:] = effect[:-1, _START]
    before = np.empty((chunks, _CHUNK), dtype=np.uint8)
    for j in range(_CHUNK):
        before[:, j] = state
        state = _NEXT[grid[:, j], state]
    return before.reshape(-1)[:n]


def _fields(record: str, sep: str, cuts: np.ndarray) -> list[str]:
    if '"' not in record:
        return record.split(sep)
    out, begin = [], 0
    for cut in [*cuts.tolist(), len(record)]:
        field = record[begin:cut]
        out.append(field[1:-1].replace('""', '"') if field.startswith('"') else field)
        begin = cut + 1
    return out


def tokenize(records: list[str], seps: list[str]) -> tuple[list[int | None], list[list[str] | None], list[list[int] | None]]:
    """Of each record the offset (code points) at which its quoting breaks, or its fields.

    A quote left open breaks at the record's end. Line breaks are characters like any other. A null record has no fields. The
    third list has the offsets at which the fields of records with quotes start; elsewhere these follow from the fields.
    """
    texts = [r if r is not None else "" for r in records]
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + 1
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sep = np.repeat(np.fromiter((ord(s[0]) if s else 0x110000 for s in seps), np.uint32, len(seps)), lengths)
    classes = np.zeros(len(codes), dtype=np.uint8)
    classes[codes == sep] = _SEP
    classes[codes == 34] = _QUOTE
    ends = np.cumsum(lengths) - 1
    classes[ends] = _END
    before = states_before(classes)
    starts = ends - lengths + 1
    after = _NEXT[classes, before]
    broke = np.flatnonzero(((after == _BROKEN) & (before != _BROKEN)) | ((classes == _END) & (before == _QUOTED)))
    at = np.searchsorted(ends, broke)
    broken_at: list[int | None] = [None] * len(texts)
    for record, place in zip(at[::-1].tolist(), broke[::-1].tolist()):  # backwards: the first place stays
        broken_at[record] = place - int(starts[record])
    cuts = np.flatnonzero((classes == _SEP) & (after == _START))
    first, last = np.searchsorted(cuts, starts), np.searchsorted(cuts, ends)
    fields: list[list[str] | None] = [
        None if records[i] is None or broken_at[i] is not None else _fields(texts[i], seps[i] or "\0", cuts[first[i] : last[i]] - starts[i])
        for i in range(len(texts))
    ]
    begins: list[list[int] | None] = [
        [0, *(cuts[first[i] : last[i]] - starts[i] + 1).tolist()] if fields[i] is not None and '"' in texts[i] else None for i in range(len(texts))
    ]
    return broken_at, fields, begins


TOKENS = T.StructType([T.StructField("broken_at", T.IntegerType()), T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("starts", T.ArrayType(T.IntegerType()))])


@pandas_udf(TOKENS)
def tokenized(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Column form of `tokenize`: raw record and separator to (offset of the break, fields, their starts)."""
    for records, seps in batches:
        broken_at, fields, starts = tokenize([None if pd.isna(r) else r for r in records], ["" if pd.isna(s) else s for s in seps])
        yield pd.DataFrame({"broken_at": pd.array(broken_at, dtype="Int32"), "fields": fields, "starts": starts})


#: Not deterministic in name only: the optimizer may then neither repeat it nor move a filter below it.
tokenized = tokenized.asNondeterministic()
