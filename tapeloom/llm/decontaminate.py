"""Benchmark decontamination: a broadcast hash set of test windows, a scan of whole texts, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import whole
from tapeloom.session import materialize

#: Words of a window; a shorter item is one window.
WINDOW = 10
#: Words of test text that one broadcast holds (about 24 bytes a window and the text). More test text is scanned in several blocks.
BLOCK_WORDS = 2_000_000
#: An item longer than this enters as pieces that overlap by WINDOW - 1 words, so a block stays near its bound.
PIECE_WORDS = 50_000
#: Bytes of text hashed at once; bounds a worker's arrays, not what is read.
CHUNK = 1 << 19
_FILTER_BITS = 22


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per byte: is it part of a word, its lower case (A-Z only), its random value. Bytes of non-ASCII letters are word bytes."""
    code = np.arange(256)
    upper = (code >= 65) & (code <= 90)
    lower = np.where(upper, code + 32, code).astype(np.uint8)
    word = (lower >= 128) | ((lower >= 48) & (lower <= 57)) | ((lower >= 97) & (lower <= 122))
    value = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)[lower]
    return word, lower, value


_IN_WORD, _LOWER, _VALUE = _tables()
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)


class Words:
    """Words of a run of bytes: start, end and a 64-bit hash of each, found by whole-array steps."""

    def __init__(self) -> None:
        self.power = self.back = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) <= n:
            size = max(n + 1, CHUNK + 1)
            grow = lambda x: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, x, np.uint64))])
            self.power, self.back = grow(_BASE), grow(_UNBASE)

    def _part(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = np.concatenate([[False], _IN_WORD[data], [False]])
        first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        at = cuts[cuts < len(data)]
        first[at] = inside[1:-1][at]  # a text starts here, whatever stands before it
        last[at[at > 0] - 1] = inside[1:-1][at[at > 0] - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self._powers(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * self.power[: len(data)], out=total[1:])
        mark = (total[end] - total[start]) * self.back[start]
        mark ^= mark >> np.uint64(32)
        return start, end, mark * _STEP

    def __call__(self, data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``texts``: offsets where texts start. Long data is cut where no word stands, so a worker's arrays stay small."""
        parts, at = [], 0
        while at < len(data):
            stop = min(at + CHUNK, len(data))
            if stop < len(data):
                gap = np.flatnonzero(~_IN_WORD[data[at:stop]])
                while not len(gap) and stop < len(data):  # one word longer than a chunk
                    more = np.flatnonzero(~_IN_WORD[data[stop : stop + CHUNK]])
                    gap, stop = more + (stop - at), min(stop + CHUNK, len(data))
                stop = at + int(gap[-1]) + 1 if len(gap) else len(data)
            s, e, h = self._part(data[at:stop], texts[(texts >= at) & (texts < stop)] - at)
            parts.append((s + at, e + at, h))
            at = stop
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        return tuple(np.concatenate(p) for p in zip(*parts))


def longer(window: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of windows one word longer."""
    out = (window ^ word) * _BASE
    return out ^ (out >> np.uint64(29))


def windows(word: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, hash of the k words from each place) for k = 1..most."""
    out = np.zeros(len(word), np.uint64)
    for k in range(1, most + 1):
        n = len(word) - k + 1
        if n <= 0:
            return
        out = longer(out[:n], word[k - 1 :])
        yield k, out


@dataclass
class Block:
    """Test windows of one block: per window length the sorted hashes with their places, a bit filter, and the texts."""

    hashes: dict[int, np.ndarray]
    #: by window length: piece and first word of each hash
    places: dict[int, np.ndarray]
    seen: np.ndarray
    #: by piece: item, its words joined by blanks, where they start (and one past the end)
    items: list[str]
    texts: list[bytes]
    starts: list[np.ndarray]

    def window(self, piece: int, first: int, k: int) -> bytes:
        at = self.starts[piece]
        return self.texts[piece][at[first] : at[first + k] - 1]


def block(rows: list[tuple[str, bytes, int]]) -> Block:
    """``rows``: (item, words joined by blanks, length of a window)."""
    find, hashes, places, starts = Words(), {}, {}, []
    for piece, (_, text, k) in enumerate(rows):
        start, _, word = find(np.frombuffer(text, np.uint8), np.zeros(1, np.int64))
        starts.append(np.append(start, len(text) + 1).astype(np.int32))
        for size, found in windows(word, k):
            if size == k:
                hashes.setdefault(k, []).append(found)
                places.setdefault(k, []).append(np.stack([np.full(len(found), piece), np.arange(len(found))], 1))
    seen = np.zeros(1 << _FILTER_BITS, bool)
    for k in hashes:
        h, p = np.concatenate(hashes[k]), np.concatenate(places[k])
        order = np.argsort(h, kind="stable")
        hashes[k], places[k] = h[order], p[order].astype(np.int32)
        seen[(h & np.uint64(len(seen) - 1)).astype(np.int64)] = True
    return Block(hashes, places, seen, [r[0] for r in rows], [r[1] for r in rows], starts)


class Scanner:
    """Hits of a block in texts: the hash set proposes, the words decide."""

    def __init__(self, test: Block) -> None:
        self.test, self.find = test, Words()
        self.most = max(test.hashes, default=0)
        #: items of the windows verified so far, at most one entry a window of the block
        self.known: dict[bytes, frozenset[str]] = {}

    def _items(self, text: bytes, k: int, low: int, high: int) -> frozenset[str]:
        found = self.known.get(text)
        if found is None:
            found = frozenset(self.test.items[p] for p, first in self.test.places[k][low:high].tolist() if self.test.window(p, first, k) == text)
            if found:
                self.known[text] = found
        return found

    def __call__(self, data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, set[str]]]:
        """Start and end of words (bytes), the text each lies in, whether it is hit, and by text the items found.

        ``texts``: offsets where texts start, ascending (empty texts share one with the next).
        """
        start, end, word = self.find(data, texts)
        owner = np.searchsorted(texts, start, side="right") - 1
        edge = np.zeros(len(start) + 1, np.int32)
        items: dict[int, set[str]] = {}
        mask = np.uint64(len(self.test.seen) - 1)
        for k, found in windows(word, self.most):
            known = self.test.hashes.get(k)
            if known is None:
                continue
            at = np.flatnonzero(self.test.seen[(found & mask).astype(np.int64)])
            at = at[owner[at] == owner[at + k - 1]]
            low, high = np.searchsorted(known, found[at], "left"), np.searchsorted(known, found[at], "right")
            some = high > low
            for i, a, b in zip(at[some].tolist(), low[some].tolist(), high[some].tolist()):
                text = b" ".join([_LOWER[data[start[j] : end[j]]].tobytes() for j in range(i, i + k)])
                names = self._items(text, k, a, b)
                if names:
                    edge[i] += 1
                    edge[i + k] -= 1
                    items.setdefault(int(owner[i]), set()).update(names)
        return start, end, owner, np.cumsum(edge[:-1]) > 0, items


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the texts, one more than texts) of a column in runs of about CHUNK bytes; a null is empty."""
    if not len(column):
        return
    column = column.fill_null("").cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK, "right")) - 1)
        yield row, data[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop


def _runs(hit: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of hit words inside one text."""
    same = np.concatenate([[False], (owner[1:] == owner[:-1]) & hit[1:] & hit[:-1]])[: len(hit)]
    first = np.flatnonzero(hit & ~same)
    last = np.flatnonzero(hit & ~np.concatenate([same[1:], [False]])[: len(hit)])
    return first, last


def _items(bench: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, words, k, n): normalised test texts, long ones in overlapping pieces."""
    piece = PIECE_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Words()
        for batch in batches:
            out: list[tuple] = []
            for i, value in enumerate(batch.column(1).to_pylist()):
                data = np.frombuffer((value or "").encode(), np.uint8)
                start, end, _ = find(data, np.zeros(1, np.int64))
                name, k = batch.column(0)[i].as_py(), min(WINDOW, len(start))
                for a in range(0, max(len(start) - k + 1, 0) if k else 0, piece):
                    b = min(a + piece + k - 1, len(start))
                    out.append((name, b" ".join(_LOWER[data[s:e]].tobytes() for s, e in zip(start[a:b], end[a:b])), k, b - a))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.int32(), pa.int64()))], names=["item", "words", "k", "n"])

    named = bench.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), whole(text).alias("text"))
    return named.mapInArrow(run, "item string, words binary, k int, n long")


def test_blocks(bench: DataFrame, item_id: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS) -> list[DataFrame]:
    """The test set as tables (item, words, k) of about ``block_words`` words each, by hash of the piece; one in the usual case."""
    rows = materialize(_items(bench, item_id, text).distinct(), "test-items")
    total = rows.agg(F.sum("n")).first()[0] or 0
    count = -(-total // block_words)
    if count <= 1:
        return [rows] if total else []
    deal = F.pmod(F.xxhash64("words"), F.lit(count))
    return [rows.where(deal == b) for b in range(count)]


def _broadcast(part: DataFrame):
    rows = part.select("item", "words", "k").orderBy("item", "words").toArrow()
    cols = [rows.column(c).to_pylist() for c in ("item", "words", "k")]
    return part.sparkSession.sparkContext.broadcast(block(list(zip(*cols))))


def scan(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, span_start, span_end (arrays, code points, end exclusive), items (sorted strings).

    Words are runs of 0-9, a-z (A-Z lowered) and characters beyond ASCII. A window is WINDOW consecutive words of a test
    item; an item of fewer words is one window. A word inside any occurrence of a window is hit; spans go from the first to the
    last word of a run of hit ones. Null and empty texts have no words; so has a null item. Test rows that share an item_id are
    one item, a null item_id is the item "". Ids of documents may be null or repeat: every row is judged by its own text. An
    empty test set hits nothing; no documents give no rows.

    The test windows' hashes are broadcast, at most about ``block_words`` words of test text at once; a larger
    test set is scanned block by block, the rows written in between. Texts never leave their task, and
    nothing is shuffled. Each hash hit is held against the words of the item, so results are exact.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(_FOUND).fields])
    return _passes(rows, 1, bench, item_id, item_text, block_words, "scan", found)


def clean(docs: DataFrame, bench: DataFrame, text: str = "text", remove: str = "spans", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the hit spans (``remove="spans"``) or without hit documents (``"documents"``), columns as given, of any name.

    A span is cut out from its first to its last word. Rows without a hit stay as they are, null texts too. One pass per
    block of the test set, without a key and without a shuffle; hits of all blocks are found before anything is cut.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    return _passes(docs, docs.columns.index(text), bench, item_id, item_text, block_words, remove, docs.schema)


_FOUND = "n_words long, n_hit long, span_start array<int>, span_end array<int>, items array<string>"


def _passes(rows: DataFrame, at: int, bench: DataFrame, item_id: str, item_text: str, block_words: int, finish: str, schema: T.StructType) -> DataFrame:
    """A pass per block; between passes rows carry the hits (first and last word of each run) and items so far in two columns at their end."""
    spark, blocks = rows.sparkSession, test_blocks(bench, item_id, item_text, block_words)
    for i, part in enumerate(blocks or [None]):
        shared = _broadcast(part) if part is not None else spark.sparkContext.broadcast(block([]))
        if i + 1 < len(blocks):
            free = [_free(f"_{name}", rows.columns) for name in ("hits", "items")] if not i else rows.columns[-2:]
            fields = rows.schema.fields if not i else rows.schema.fields[:-2]
            carried = T.StructType([*fields, T.StructField(free[0], T.ArrayType(T.IntegerType())), T.StructField(free[1], T.ArrayType(T.StringType()))])
            rows = materialize(rows.mapInArrow(_pass(shared, at, i > 0, "carry", carried.names), carried), "scanned")
        else:
            rows = rows.mapInArrow(_pass(shared, at, i > 0, finish, schema.names), schema)
    return rows


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def _pass(shared, at: int, carries: bool, finish: str, out: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Scanner(shared.value)
        for batch in batches:
            own = batch.columns[:-2] if carries else batch.columns
            for row, data, offsets in _texts(batch.column(at)):
                n = len(offsets) - 1
                columns = [c.slice(row, n) for c in own]
                start, end, owner, hit, items = look(data, offsets[:-1])
                base = np.searchsorted(owner, np.arange(n + 1))
                if carries:
                    for i, flat in enumerate(batch.column(len(own)).slice(row, n).to_pylist()):
                        for a, b in zip(flat[::2], flat[1::2]):
                            hit[base[i] + a : base[i] + b + 1] = True
                    for i, names in enumerate(batch.column(len(own) + 1).slice(row, n).to_pylist()):
                        if names:
                            items.setdefault(i, set()).update(names)
                first, last = _runs(hit, owner)
                cut = np.searchsorted(first, base).astype(np.int32)
                if finish == "documents":
                    stays = np.ones(n, bool)
                    stays[owner[first]] = False
                    yield pa.RecordBatch.from_arrays([c.filter(pa.array(stays)) for c in columns], names=out)
                elif finish == "spans":
                    texts = columns[at].to_pylist()
                    for i in np.unique(owner[first]).tolist():
                        left, done = [], offsets[i]
                        for j in range(cut[i], cut[i + 1]):
                            left.append(data[done : start[first[j]]])
                            done = end[last[j]]
                        texts[i] = np.concatenate([*left, data[done : offsets[i + 1]]]).tobytes().decode()
                    columns[at] = pa.array(texts, columns[at].type)
                    yield pa.RecordBatch.from_arrays(columns, names=out)
                else:
                    names = pa.array([sorted(items.get(i, ())) for i in range(n)], pa.list_(pa.string()))
                    if finish == "carry":
                        flat = np.stack([first - base[owner[first]], last - base[owner[first]]], 1).ravel().astype(np.int32)
                        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(cut * 2), pa.array(flat)), names], names=out)
                        continue
                    points = np.cumsum(np.concatenate([[0], (data & 0xC0) != 0x80])) if len(first) else np.zeros(1, np.int64)
                    shift = points[offsets[owner[first]]]
                    spans = [pa.ListArray.from_arrays(pa.array(cut), pa.array((points[x] - shift).astype(np.int32))) for x in (start[first], end[last])]
                    n_hit = np.bincount(owner[hit], minlength=n).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([columns[0], pa.array(np.diff(base)), pa.array(n_hit), *spans, names], names=out)

    return run


def digests(found: DataFrame) -> DataFrame:
    """The digest columns of a scan: n_items, items_sha256, contaminated."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
