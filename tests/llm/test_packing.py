"""Packing: ids equal the tokenizer's, sequences are gapless, few, and the reduction loses no bin."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tapeloom.llm import packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_word_cache_equals_tokenizer():
    tok = Tokenizer.from_file(VOCABULARY)
    encode = packing.WordEncoder(VOCABULARY)
    texts = ["", " ", "It's 3 o'clock\n\nÀ LA carte\t x　y", "é ́a <|endoftext|>end <|startoftext|>", "ΑΣ ΣΑΣ\r\n z", "漢字かな \U0001f600!!! don't"]
    for x in texts:
        assert np.frombuffer(encode(x), "<u4").tolist() == tok.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_pieces_equal_tokenizer(seed):
    """Parts of every make: plain, with stops, contractions, special tokens, and characters beyond the plain ones."""
    rng = random.Random(seed)
    bits = [*"abcXYZ019'’.,!-—<|>\t\x0b\x0c\x1c\x85\xa0 \n\xad", *map(chr, range(0xA0, 0x260)), *"Σς\u0301\u200b中\U0001f600ﬁ",
            "'s", "'ll", "'T", "<|endoftext|>", "don't", "I'VE", "<|startoftext|>", "word,", "Word...", "..."]
    texts = ["".join(rng.choices(bits, k=rng.randrange(40))) for _ in range(3000)]
    encode = packing.WordEncoder(VOCABULARY)
    found = Tokenizer.from_file(VOCABULARY).encode_batch(texts, add_special_tokens=False)
    for x, e in zip(texts, found, strict=True):
        assert np.frombuffer(encode(x), "<u4").tolist() == e.ids, ascii(x)


def check_layout(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_layout(spark, edge_docs):
    tok = Tokenizer.from_file(VOCABULARY)
    rows = packing.pack_documents(edge_docs, keep_ids=True, capacity=512).collect()
    docs = edge_docs.select("doc_id", "text").collect()
    assert sum(r["length"] for r in rows) == sum(len(tok.encode(d["text"] or "", add_special_tokens=False).ids) + 1 for d in docs)
    check_layout(rows, 512)
    long = sorted((r for r in rows if r["doc_id"] == 6), key=lambda r: r["piece"])
    ids = tok.encode(next(d["text"] for d in docs if d["doc_id"] == 6), add_special_tokens=False).ids + [1]
    assert [r["start"] for r in long] == list(range(0, len(ids), 512))
    assert all(r["length"] == 512 for r in long[:-1])
    for r in long:
        part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["ids"] == part and r["ids_crc32"] == zlib.crc32(part)
    empty = [r for r in rows if r["doc_id"] in (3, 4, 5)]
    assert [(r["length"], r["start"]) for r in empty] == [(1, 0)] * 3


def test_empty_table(no_docs):
    assert packing.pack_documents(no_docs).count() == 0


def least_bins(lengths, capacity):
    """Brute force over set partitions, for few items."""
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in sorted(set(range(len(rooms)))):
            if rooms[k] >= lengths[i]:
                rooms[k] -= lengths[i]
                go(i + 1, rooms)
                rooms[k] += lengths[i]
        go(i + 1, rooms + [capacity - lengths[i]])

    go(0, [])
    return best


def histogram(lengths):
    return {x: lengths.count(x) for x in set(lengths)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=8), st.sampled_from([30, 31]))
def test_reduction_keeps_an_optimum(lengths, capacity):
    left = histogram(lengths)
    fixed = packing.reduce_lengths(left, capacity)
    rest = [x for x, n in left.items() for _ in range(n)]
    used = [x for n, put in fixed for x in put * n]
    assert sorted(used + rest) == sorted(lengths)
    assert all(sum(put) <= capacity for _, put in fixed)
    assert sum(n for n, _ in fixed) + (least_bins(sorted(rest, reverse=True), capacity) if rest else 0) == least_bins(sorted(lengths, reverse=True), capacity)


def plain_best_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - x)
        else:
            rooms.append(capacity - x)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_grouped_best_fit_equals_plain(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 60 if seed % 2 else 100) for _ in range(400)]
    bins = packing.best_fit(histogram(lengths), 100)
    assert sorted(x for n, put in bins for x in put * n) == sorted(lengths)
    assert sum(n for n, _ in bins) == plain_best_fit(lengths, 100)


def test_hot_length(spark):
    from pyspark.sql import functions as F

    parts = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 3 == 0, F.lit(40)).otherwise(F.col("id") % 90 + 1).cast("long").alias("length"))
    rows = packing.pack(parts, 100).collect()
    assert len(rows) == 3000
    assert check_layout(rows, 100) <= plain_best_fit([r["length"] for r in rows], 100)
