"""Best-fit packing of token sequences after a dominance reduction on the length histogram."""

from __future__ import annotations

import bisect
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import whole
from tapeloom.session import materialize

CAPACITY = 4096
END_ID = 1
#: Words that a Python worker keeps with their ids; beyond, it starts anew. Bounds memory only.
CACHED_WORDS = 400_000
#: Rows of one length that are numbered in one task, about.
RANK_ROWS = 200_000


class _ByteLetters(dict):
    """Letters that the vocabulary has for the bytes of a character."""

    def __missing__(self, code: int) -> str:
        from tokenizers.pre_tokenizers import ByteLevel

        found = self[code] = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(code))[0][0]
        return found


#: Letters and marks below U+0250 without blanks: normal form C already, lowered to one character each, of settled categories.
_PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")
#: Marks that end words; a run of them is one piece of its own.
_STOPS = ".,;:!?"


class WordEncoder:
    """Ids of a text, word by word from a cache.

    The vocabulary splits at white space first and drops it, so the ids of a text are those of its
    parts between spaces and line ends, one after the other. A part not seen yet is lowered and split by the
    pattern in the tokenizer's file, and its pieces go to the file's model; far fewer pieces than parts are
    distinct. Parts with other characters than ``_PLAIN``, or with a special token, and all parts of
    a file of another make go through the whole tokenizer in one batch.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ids: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}
        self.letters = _ByteLetters()
        self.split, self.special = self._make()

    def _make(self) -> tuple[regex.Pattern | None, list[str]]:
        """The file's own split pattern, None where the file does more than lower, split and spell bytes."""
        made = json.loads(self.tokenizer.to_str())
        special = [t["content"] for t in made["added_tokens"]]
        kinds = [[x["type"] for x in (made[k] or {}).get(v, [])] for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        if kinds != [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] or made["post_processor"] or made["truncation"]:
            return None, special
        split, spell = made["pre_tokenizer"]["pretokenizers"]
        if not split["invert"] or split["behavior"] != "Removed" or spell["add_prefix_space"] or spell["use_regex"]:
            return None, special
        return regex.compile(split["pattern"]["Regex"]), special

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            spelt = piece if piece.isascii() else piece.translate(self.letters)
            found = self.pieces[piece] = struct.pack(f"<{len(ids)}I", *ids) if (ids := [t.id for t in self.tokenizer.model.tokenize(spelt)]) else b""
        return found

    def _learn(self, parts: list[str]) -> None:
        plain = self.split is not None and _PLAIN.fullmatch("".join(parts)) and not self._special("\n".join(parts))
        odd = []
        for x in parts:
            if not plain and (self.split is None or not _PLAIN.fullmatch(x) or self._special(x)):
                odd.append(x)
                continue
            low = x.lower()
            if low.isalpha():
                self.ids[x] = self._piece(low)
            elif (core := low.rstrip(_STOPS)).isalpha():
                self.ids[x] = self._piece(core) + self._piece(low[len(core) :])
            else:
                self.ids[x] = b"".join(map(self._piece, self.split.findall(low)))
        if odd:
            found = self.tokenizer.encode_batch(odd, add_special_tokens=False)
            self.ids.update((w, np.asarray(e.ids, "<u4").tobytes()) for w, e in zip(odd, found, strict=True))

    def _special(self, x: str) -> bool:
        return any(t in x for t in self.special)

    def __call__(self, text: str) -> bytes:
        parts = text.replace("\n", " ").split(" ")
        new = [w for w in set(parts) if w not in self.ids]
        if new:
            self._learn(new)
        out = b"".join(map(self.ids.__getitem__, parts))
        if len(self.ids) > CACHED_WORDS:
            self.ids = {"": b""}
        if len(self.pieces) > CACHED_WORDS:
            self.pieces = {}
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str | None) -> WordEncoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None,
           capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32 (and ids, if asked).

    A document is its ids followed by the end id; null text counts as empty and gives the end
    id alone. Only documents above ``capacity`` are cut, the last piece may be shorter. Rows that repeat
    give their pieces again. ``vocabulary``: path of a tokenizer file each worker can open.
    """
    kind = docs.schema[doc_id].dataType
    fields = [T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    end = int(END_ID).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        for batch in batches:
            row, no, start, length, crc, ids = [], [], [], [], [], []
            for i, x in enumerate(batch.column(1)):
                data = memoryview(encode(x.as_py()) + end)
                n = len(data) // 4
                for k, s in enumerate(range(0, n, capacity)):
                    e = min(n, s + capacity)
                    part = data[4 * s : 4 * e]
                    row.append(i), no.append(k), start.append(s), length.append(e - s), crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(bytes(part))
            out = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int64()),
                   pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if keep_ids:
                out.append(pa.array(ids, pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text")).mapInArrow(run, T.StructType(fields))


def reduce_lengths(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Martello-Toth reduction on a histogram: fixes bins, lowers ``counts``, returns (copies, lengths).

    For the largest length j that is left and the room r beside it, a filling is fixed when it
    dominates every other filling of that bin (each alternative set can be split into
    parts that fit in place of its members):

    * nothing fits beside j: {j};
    * a length equal to r exists: {j, r}, as every alternative sums to r at most;
    * no two lengths fit together: {j, k}, k the largest that fits;
    * no three fit: {j, k} if k is at least the largest sum of two that fit; else {j, k, b}, b
      the largest that fits beside k, if no two lengths above b fit together.

    Lengths where no rule holds are left for best fit.
    """
    fixed: list[tuple[int, list[int]]] = []
    again = True
    while again and counts:
        again = False
        sizes = sorted(counts)
        for j in sorted(counts, reverse=True):
            while counts.get(j):
                r = capacity - j
                small = sizes[0]
                n = counts[j]
                if r < small:
                    put = [j]
                elif counts.get(r, 0) > (r == j):
                    put = [j, r]
                else:
                    i = bisect.bisect_right(sizes, r) - 1
                    while i >= 0 and counts.get(sizes[i], 0) <= (sizes[i] == j):
                        i -= 1
                    if i < 0:
                        put = [j]
                    else:
                        k = sizes[i]
                        # lengths beside j, without j's own copy
                        two = 2 * small if counts[small] - (small == j) > 1 else small + (sizes[1] if len(sizes) > 1 else capacity)
                        if r < two:
                            put = [j, k]
                        elif r < 3 * small and j > r:
                            b = r - k
                            at = bisect.bisect_right(sizes, b) - 1
                            best_two = _largest_pair(sizes, counts, r)
                            if k >= best_two:
                                put = [j, k]
                            elif at >= 0 and (sizes[at] != k or counts[k] > 1):
                                above = sizes[at + 1 : at + 3]
                                pair = (2 * above[0] if counts[above[0]] > 1 else sum(above) if len(above) > 1 else capacity) if above else capacity
                                put = [j, k, sizes[at]] if pair > r else None
                            else:
                                put = None
                        else:
                            put = None
                if put is None:
                    break
                need = {x: put.count(x) for x in put}
                times = min(counts[x] // c for x, c in need.items())
                fixed.append((times, put))
                again = True
                for x, c in need.items():
                    counts[x] -= times * c
                    if not counts[x]:
                        del counts[x]
                        sizes.remove(x)
                if not sizes:
                    return fixed
    return fixed


def _largest_pair(sizes: list[int], counts: dict[int, int], room: int) -> int:
    """Largest sum of two lengths within ``room``, two pointers over the sorted lengths."""
    lo, hi, best = 0, bisect.bisect_right(sizes, room) - 1, 0
    while lo <= hi:
        if lo == hi and counts[sizes[lo]] < 2:
            break
        s = sizes[lo] + sizes[hi]
        if s <= room:
            best = max(best, s)
            lo += 1
        else:
            hi -= 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Best fit over a histogram, longest first: each length goes to the fullest bin that takes it.

    Bins of equal filling are handled as one group with a count, so the work depends on the
    number of different lengths and not on the number of documents.
    """
    open_bins: dict[int, list[list]] = {}  # room -> groups [copies, lengths]
    rooms: list[int] = []
    done: list[tuple[int, list[int]]] = []

    def add(room: int, copies: int, lengths: list[int]) -> None:
        if not copies:
            return
        if not room:
            done.append((copies, lengths))
            return
        if room not in open_bins:
            open_bins[room] = []
            bisect.insort(rooms, room)
        open_bins[room].append([copies, lengths])

    for j in sorted(counts, reverse=True):
        n = counts[j]
        while n:
            i = bisect.bisect_left(rooms, j)
            if i == len(rooms):
                each = capacity // j
                add(capacity - each * j, n // each, [j] * each)
                if n % each:
                    add(capacity - n % each * j, 1, [j] * (n % each))
                break
            room = rooms[i]
            copies, lengths = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(i)
            each = room // j
            full = min(copies, n // each)
            part = n - full * each if full < copies else 0
            add(room - each * j, full, lengths + [j] * each)
            if full < copies and part:
                part = min(part, each)
                add(room - part * j, 1, lengths + [j] * part)
            else:
                part = 0
            add(room, copies - full - (part > 0), lengths)
            n -= full * each + part
    return done + [(c, x) for groups in open_bins.values() for c, x in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Slots for every rank of every length: key, first sequence, copies per sequence, offset.

    A slot row covers the ranks from its own to the next row's of the same length. Rows are bounded
    by the number of different lengths, hence by ``capacity``, at any number of documents.
    """
    left = {int(k): int(v) for k, v in counts.items()}
    bins = reduce_lengths(left, capacity)
    bins += best_fit(left, capacity)
    used: dict[int, int] = {}
    rows = []
    sequence = 0
    for copies, lengths in bins:
        offset = 0
        for x in sorted(set(lengths), reverse=True):
            k = lengths.count(x)
            rows.append((x, used.get(x, 0), sequence, k, offset))
            used[x] = used.get(x, 0) + copies * k
            offset += k * x
        sequence += copies
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "offset"), table.T, strict=True)) | {"sequences": np.int64(sequence)}


def pack(parts: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to every row of ``parts`` (a written table with a column length, 1 to capacity).

    Which documents share a sequence depends on lengths only. So the histogram of lengths (at
    most ``capacity`` rows, whatever the corpus) goes to the driver, is reduced and packed
    there, and each piece finds its place by its rank among the pieces of its length. Ranks are
    counted in hash groups and added up, so a length that a third of all pieces have is spread
    over many tasks. Sequences are as few as packing the whole corpus at once gives.
    """
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.sparkContext.broadcast(plan(counts, capacity))
    groups = max(64, -(-sum(counts.values()) // RANK_ROWS))
    keyed = parts.withColumn("_g", F.pmod(F.xxhash64(*order), F.lit(groups)).cast("int"))
    before = Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("length", "_g").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("length", "_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("length", "_g").orderBy(*order))
    ranked = keyed.withColumn("_in", inside).join(starts, ["length", "_g"])
    ranked = ranked.select(*parts.columns, (F.col("_start") + F.col("_in") - 1).cast("long").alias("_rank"))
    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        width = int(s["rank"].max(initial=0)) + 1
        keys = s["length"] * width + s["rank"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.searchsorted(keys, length * width + np.minimum(rank, width - 1), "right") - 1
            i = rank - s["rank"][at]
            out = [batch.column(k) for k in range(batch.num_columns - 1)]
            out.append(pa.array(s["sequence"][at] + i // s["each"][at]))
            out.append(pa.array(s["offset"][at] + i % s["each"][at] * length))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None,
                   capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset. An empty table gives no rows.

    Tokens are made once; the pieces (short rows, ids only if asked) are written to the shared
    folder before lengths are counted, so a lost executor cannot change them.
    """
    parts = materialize(pieces(docs, doc_id, text, vocabulary, capacity, keep_ids), "pieces")
    return pack(parts, capacity)
