"""Benchmark decontamination against brute force over words."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tapeloom.llm import decontaminate

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return [(m.group(), m.start(), m.end()) for m in WORD.finditer((text or "").translate(UPPER))]


def brute(docs, bench):
    tests = {}
    for item, text in bench:
        w = [x for x, _, _ in words(text)]
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            tests.setdefault(tuple(w[i : i + k]), set()).add("" if item is None else str(item))
    sizes = {len(t) for t in tests}
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, items = [False] * len(w), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                found = tests.get(tuple(x for x, _, _ in w[i : i + k]))
                if found:
                    items |= found
                    hit[i : i + k] = [True] * k
        spans, i = [], 0
        while i < len(w):
            j = i
            while j < len(w) and hit[j]:
                j += 1
            if j > i:
                spans.append((w[i][1], w[j - 1][2]))
            i = j + 1
        out.append((doc_id, len(w), sum(hit), spans, sorted(items)))
    return out


def plain(df):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(zip(r.span_start, r.span_end)), list(r["items"])) for r in df.collect()), key=key)


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(5)
    vocabulary = ["Ab", "c9", "été", "漢字", "x", "Y", "zz", "0", "\U0001f600", "q"] + [f"w{i}" for i in range(60)]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "\x7f", "_"]) for _ in range(n))
    bench = [(i, text(rng.randint(10, 40))) for i in range(30)] + [(None, text(12)), (40, "x zz q w1"), (41, "Ünique"), (42, ""), (43, None), (44, " - "), (7, text(11))]
    bench += [(50, bench[3][1]), (51, bench[3][1].upper()), (3, bench[3][1])]
    docs = []
    for i in range(120):
        parts = [text(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 3)):
            item = rng.choice(bench)[1] or ""
            w = [x for x, _, _ in words(item)]
            a = rng.randint(0, max(0, len(w) - 1))
            parts += [" ".join(w[a : a + rng.randint(1, 30)]).upper(), text(rng.randint(0, 8))]
        docs.append((i if i % 9 else None, "; ".join(parts)))
    docs += docs[:5] + [(500, None), (501, ""), (502, "ünique"), (503, " ".join(f"w{i % 60}" for i in range(80_000)) + " " + bench[0][1] * 3)]
    docs += [(504, "y" * 1_300_000 + " Ünique " + bench[1][1]), (505, bench[2][1])]
    return docs, bench


@pytest.mark.parametrize("size", [decontaminate.BLOCK_WORDS, 150])
def test_hits(spark, case, size):
    docs, bench = case
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    if size < 1000:
        assert len(decontaminate.test_blocks(b, block_words=size)) > 3
    found = decontaminate.scan(d, b, block_words=size)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert plain(found) == sorted(brute(docs, bench), key=key)


@pytest.mark.parametrize("size", [decontaminate.BLOCK_WORDS, 150])
def test_cut(spark, case, size):
    docs, bench = case
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"_hits": F.lit(1), "items": F.lit("x"), "n_hit": F.lit(2.0)})
    b = spark.createDataFrame(bench, "item_id long, text string")
    want, stays = [], []
    for (doc_id, text), (_, _, n_hit, spans, _) in zip(docs, brute(docs, bench)):
        for a, e in reversed(spans):
            text = text[:a] + text[e:]
        want.append((doc_id, text, 1, "x", 2.0))
        if not n_hit:
            stays.append((doc_id, text, 1, "x", 2.0))
    key = lambda r: tuple((x is None, x or 0) for x in r[:1]) + (r[1] or "",)
    for how, rows in (("spans", want), ("documents", stays)):
        got = decontaminate.clean(d, b, remove=how, block_words=size)
        assert got.columns == d.columns
        assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(rows, key=key)


def test_long_items_meet_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    item = " ".join(f"v{i}" for i in range(60))
    docs = [(i, " ".join(f"v{j}" for j in range(i, i + 10))) for i in range(51)]
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontaminate._items(b, "item_id", "text").count() > 7
    got = decontaminate.scan(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()
    assert all(r.n_hit == 10 and r["items"] == ["1"] for r in got)


def test_edges(spark, edge_docs, no_docs):
    b = spark.createDataFrame([(1, "Quick brown fox"), (2, None)], "item_id long, text string").withColumn("items", F.lit("clash"))
    got = {(r.doc_id, r.n_hit) for r in decontaminate.scan(edge_docs, b).collect()}
    assert (1, 3) in got and (2, 3) in got and (None, 0) in got and (3, 0) in got
    assert decontaminate.scan(edge_docs, b).count() == edge_docs.count()
    assert decontaminate.scan(no_docs, b).count() == 0
    none = b.where("item_id > 9")
    assert decontaminate.scan(edge_docs, none).where("n_hit > 0").count() == 0
    assert decontaminate.clean(edge_docs, none).count() == edge_docs.count()
    assert decontaminate.digests(decontaminate.scan(edge_docs, b)).columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    with pytest.raises(ValueError):
        decontaminate.clean(edge_docs, b, remove="words")
