"""Token sets of whole texts in numpy, for operators that run over documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tapeloom.llm import setjoin

#: Words whose hash a worker keeps; beyond, it starts anew. Bounds memory only.
CACHED_WORDS = 500_000
#: Rows of a batch whose token sets a worker holds at once.
ROWS = 1_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Distinct hashes (57 bits, sorted) of the five-word shingles of a text, A-Z lowered."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def _word(self, w: bytes) -> int:
        h = self.known.get(w)
        if h is None:
            h = self.known[w] = xxhash.xxh64_intdigest(w)
        return h

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
        if not words:
            return np.empty(0, np.int64)
        h = np.fromiter(map(self._word, words), np.uint64, len(words))
        width = min(setjoin.SHINGLE, len(words))
        n = len(words) - width + 1
        out = np.full(n, width, np.uint64)
        for i in range(width):
            out = (out ^ h[i : i + n]) * _MIX
            out ^= out >> np.uint64(29)
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        return np.unique((out >> np.uint64(7)).astype(np.int64))


def ordered(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Tokens in rarity order; ``table``: magnitudes by slot, of low tokens, then of the others."""
    slot = hashes & (setjoin.RARITY_SLOTS - 1)
    slot[np.searchsorted(hashes, setjoin.LOW) :] += setjoin.RARITY_SLOTS
    return np.sort((table[slot].astype(np.int64) << 57) | hashes)


def counts(sets: DataFrame, least: int = 0) -> DataFrame:
    """(t, c) of the tokens from ``least`` on, ``sets`` with one column of packed tokens; equal tokens of a batch are added up at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _flat(batch.column(0))
            t, c = np.unique(found[found >= least], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(c.astype(np.int64))], names=["t", "c"])

    return sets.mapInArrow(run, "t long, c long")


def _lists(parts: list[np.ndarray | None]) -> pa.Array:
    full = [np.empty(0, np.int64) if x is None else x for x in parts]
    ends = np.cumsum([0, *map(len, full)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *full])), mask=pa.array([x is None for x in parts], pa.bool_()))


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches`` in pieces of ROWS, which bounds the token sets held at once."""
    return (batch.slice(i, ROWS) for batch in batches for i in range(0, batch.num_rows, ROWS))


def _packed(parts: list[np.ndarray]) -> pa.Array:
    """Tokens of each part as bytes, which the JVM passes on in one piece."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32) * np.int32(8)
    return pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate([np.empty(0, np.int64), *parts]))])


def _unpacked(packed: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.int64) for x in packed]


def _flat(packed: pa.Array) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *_unpacked(packed)])


def _names(parts: list[np.ndarray | None]) -> list[pa.Array]:
    """Two 64-bit hashes of each part, as signed numbers."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    return [pa.array([None if x is None else signed(xxhash.xxh64_intdigest(x.tobytes(), seed)) for x in parts], pa.int64()) for seed in (1, 2)]


def _prefix_size(n: int) -> int:
    return n - -(-setjoin.NUM * n // setjoin.DEN) + 1


def _low(hashes: np.ndarray) -> np.ndarray:
    return hashes[: np.searchsorted(hashes, setjoin.LOW)]


def _head(low: np.ndarray, n: int, table: np.ndarray) -> np.ndarray | None:
    """Prefix of a set of n tokens, if its rare low ones fill it."""
    rare = low[table[low & (setjoin.RARITY_SLOTS - 1)] == 0]
    return rare[: _prefix_size(n)] if len(rare) >= min(n, _prefix_size(n)) else None


def low_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, s1, s2 (name of the set), low (its low tokens, packed); ``docs``: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler()
        for batch in _small(batches):
            sets = [make(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int32()), *_names(sets), _packed([_low(s) for s in sets])], names=["doc_id", "n", "s1", "s2", "low"])

    return docs.mapInArrow(run, "doc_id long, n int, s1 long, s2 long, low binary")


def prefixes(sets: DataFrame, table: np.ndarray) -> DataFrame:
    """``low_sets`` with p1, p2 (name of the prefix) and prefix in place of low; ``table``: magnitudes of low tokens by slot.

    Where the rare low tokens do not fill a prefix, other tokens enter, whose frequency ``table`` does not know: such an
    open row has no prefix yet, see ``open_sets`` and ``settled``.
    """
    shared = sets.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            heads = [_head(low, n, shared.value) for low, n in zip(_unpacked(batch.column(4)), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *_names(heads), _lists(heads)], names=["doc_id", "n", "s1", "s2", "p1", "p2", "prefix"])

    return sets.select("doc_id", "n", "s1", "s2", "low").mapInArrow(run, "doc_id long, n int, s1 long, s2 long, p1 long, p2 long, prefix array<bigint>")


def open_sets(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """doc_id, n, s1, s2, tokens (packed) of the rows that ``prefixes`` leaves open; ``docs``: doc_id, text."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler()
        for batch in _small(batches):
            found = [(i, s) for i, s in enumerate(map(make, batch.column(1).to_pylist())) if _head(_low(s), len(s), shared.value) is None]
            sets = [s for _, s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([i for i, _ in found], pa.int64())), pa.array([len(s) for s in sets], pa.int32()), *_names(sets), _packed(sets)], names=["doc_id", "n", "s1", "s2", "tokens"])

    return docs.mapInArrow(run, "doc_id long, n int, s1 long, s2 long, tokens binary")


#: Columns of a set's mark: 512 bits, each the parity of the tokens that fall on it. Marks differ in at most as many bits as the sets have tokens that are not common.
MARK = [f"g{i}" for i in range(8)]


def _marks(sets: list[np.ndarray]) -> list[pa.Array]:
    bits = np.array([np.bincount(s & (64 * len(MARK) - 1), minlength=64 * len(MARK)) & 1 for s in sets], np.uint8).reshape(-1, 64 * len(MARK))
    return [pa.array(c) for c in np.packbits(bits, axis=1).view(np.int64).T]


def settled(opened: DataFrame, table: np.ndarray) -> DataFrame:
    """``open_sets`` with their prefix and mark; ``table`` as in ``ordered``."""
    shared = opened.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            sets = _unpacked(batch.column(4))
            heads = [ordered(s, shared.value)[: _prefix_size(len(s))] for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *_names(heads), _lists(heads), *_marks(sets)], names=["doc_id", "n", "s1", "s2", "p1", "p2", "prefix", *MARK])

    marks = ", ".join(f"{c} long" for c in MARK)
    return opened.select("doc_id", "n", "s1", "s2", "tokens").mapInArrow(run, f"doc_id long, n int, s1 long, s2 long, p1 long, p2 long, prefix array<bigint>, {marks}")


def token_sets(docs: DataFrame) -> DataFrame:
    """id, tokens; ``docs``: id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler()
        for batch in _small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([make(x) for x in batch.column(1).to_pylist()])], names=["id", "tokens"])

    return docs.mapInArrow(run, "id long, tokens array<bigint>")
