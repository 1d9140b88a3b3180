"""Line dedup, Jaccard join, fingerprints, licence scan and the pipeline's stages against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import fingerprints, licenses, line_dedup, ngram_join, shingles

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = (text or "").translate(LOWER)
    w = w.encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def match(a, b):
    return bool(a) and bool(b) and 4 * len(a & b) >= 3 * len(a | b)


@pytest.fixture(scope="module")
def near_docs(spark):
    """A class of near copies linked in a chain, copies, shared passages, and loners."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows, base = [], [rng.choice(vocabulary) for _ in range(120)]
    for i in range(60):
        rows.append(" ".join(base))
        base = list(base)
        for _ in range(2):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
    for i in range(60):
        own = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90)))
        rows.append(f"{own}\n{passage}" if i % 2 else own)
    rows += rows[:20] + ["a b c", "A B C", "a b c d", None, "", " "]
    rng.shuffle(rows)
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("id", F.lit(1))


def brute_components(rows):
    sets = {i: shingle_set(x) for i, x in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if match(sets[a], sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_join_equals_brute_force(near_docs):
    want = brute_components([(r["doc_id"], r["text"]) for r in near_docs.collect()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.classes(near_docs).collect()}
    assert got == want


def test_join_keeps_rows_without_an_id_apart(spark):
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    rows = [(1, a), (2, b), (None, a + " end"), (None, b + " end"), (None, "alone " * 9), (None, "all alone " * 9), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in ngram_join.classes(df).collect())
    assert got == Counter({(1, 1): 1, (2, 2): 1, (None, 1): 1, (None, 2): 1, (None, None): 3})


def test_fingerprints_follow_row_by_row(spark):
    rows = [(5, "aa bb"), (5, "cc dd"), (None, "ee ff"), (None, "gg hh"), (1, "ii jj")]
    got = fingerprints.compare(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r["doc_id"] for r in got) == Counter({5: 2, None: 2, 1: 1})
    assert len({r["fingerprint"] for r in got}) == 5 and len({r["edited_sha256"] for r in got}) == 5
    takes = {hashlib.sha256((x[:3] + y[:2]).encode()).hexdigest() for x in ("aa bb", "cc dd", "ee ff", "gg hh", "ii jj") for y in ("aa", "cc", "ee", "gg", "ii") if x[:2] != y}
    assert all(r["edited_sha256"] in takes for r in got)


def test_join_edges(edge_docs, no_docs):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.classes(edge_docs).collect())
    assert got[(1, 5, 1)] == 1 and got[(2, 5, 1)] == 2 and got[(3, 0, 3)] == got[(4, 0, 4)] == got[(5, 0, 5)] == 1
    assert sum(got.values()) == edge_docs.count() and any(k[0] is None for k in got)
    assert ngram_join.classes(no_docs).count() == 0


def test_shingler_lowers_ascii_only():
    make = shingles.Shingler()
    assert (make("A B\tC D E") == make("a b c d e")).all() and len(make("É b c d e f")) == 2
    assert not set(make("É b c d e")) & set(make("é b c d e"))


def test_lines_equal_brute_force(near_docs):
    lines = [((r["doc_id"], k), shingle_set(x)) for r in sorted(near_docs.collect()) for k, x in enumerate((r["text"] or "").split("\n"))]
    lines = [(at, s) for at, s in lines if s]
    want = {at: (len(s), any(match(s, t) for _, t in lines[:i])) for i, (at, s) in enumerate(lines)}
    got = {(r["doc_id"], r["line"]): (r["n_shingles"], r["removed"]) for r in line_dedup.flags(near_docs).collect()}
    assert got == want
    kept = {r["doc_id"]: r["text"] for r in line_dedup.clean(near_docs).collect()}
    for r in near_docs.collect():
        parts = (r["text"] or "").split("\n")
        left = [x for k, x in enumerate(parts) if not want.get((r["doc_id"], k), (0, False))[1]]
        gone = not any(shingle_set(x) for x in left) and any(shingle_set(x) for x in parts)
        assert (r["doc_id"] not in kept) == gone
        if not gone and r["text"] is not None:
            assert kept[r["doc_id"]] == "\n".join(left)


def test_lines_edges(edge_docs, no_docs):
    assert line_dedup.clean(edge_docs).columns == edge_docs.columns
    assert line_dedup.flags(no_docs).count() == 0 and line_dedup.clean(no_docs).count() == 0


def brute_clean(docs):
    """(doc_id, text) after line dedup; rows of one doc_id, or of none, are different documents in the given order."""
    out, earlier = [], []
    for i, text in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        stays, had = [], False
        for x in (text or "").split("\n"):
            s = shingle_set(x)
            had = had or bool(s)
            stays.append((x, bool(s), not any(match(s, e) for e in earlier)))
            earlier.append(s)
        if not had or any(word and new for _, word, new in stays):
            out.append((i, text if text is None else "\n".join(x for x, _, new in stays if new)))
    return sorted(out, key=str)


def test_lines_of_rows_that_share_an_id(spark, edge_docs):
    rows = [(None, "one two three four five six\nonly in the first of these"), (None, "a line of its own here\nsecond line is its own"), (7, "one two three four five six"),
            (3, "alpha beta gamma delta eps"), (3, "unique in the second three\nalpha beta gamma delta eps"), (None, "nothing else\nsecond line is its own"), (9, "")]
    got = [(r["doc_id"], r["text"]) for r in line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()]
    assert sorted(got, key=str) == brute_clean(rows)
    got = [(r["doc_id"], r["text"]) for r in line_dedup.clean(edge_docs.coalesce(1)).collect()]
    assert sorted(got, key=str) == brute_clean([(r["doc_id"], r["text"]) for r in edge_docs.collect()])


def test_fingerprints(near_docs):
    got = {r["doc_id"]: r for r in fingerprints.compare(near_docs).collect()}
    rows = sorted(((r["doc_id"], r["text"] or "") for r in near_docs.collect()), reverse=True)
    off = []
    for i, (k, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[k]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = Counter(text.split()), Counter(edited.split())
        off.append(r["near_edited"] - (sum((a & b).values()) / sum((a | b).values()) if a | b else 1.0))
    assert abs(np.mean(off)) < 0.05 and np.std(off) < 0.12
    by_text = {}
    for k, text in rows:
        assert by_text.setdefault(text, got[k]["fingerprint"]) == got[k]["fingerprint"]


def test_fingerprint_edges(edge_docs, no_docs):
    rows = fingerprints.compare(edge_docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in edge_docs.collect())
    assert fingerprints.compare(no_docs).count() == 0


def test_license_scan(spark, edge_docs, no_docs):
    mit = dict(licenses.TEMPLATES)["MIT"]
    rows = [(1, "some text\nlicensed under the apache license version 2.0\nend"), (2, "x\n\n" + mit.replace(". ", ".\n").replace("OTHER DEALINGS", "ANY DEALINGS") + "\n\ny"), (3, "Licensed to drive."), (4, "All Rights RESERVED"), (5, None)]
    got = {(r["doc_id"], r["unit"]): r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("m", F.lit(1))).collect()}
    assert set(got) == {(1, "line"), (1, "paragraph"), (2, "paragraph"), (2, "text"), (4, "line")}
    assert got[1, "line"]["license"] == "Apache-2.0-line" and got[1, "line"]["dice"] == 1.0 and got[1, "line"]["place"] == 1
    assert got[2, "paragraph"]["license"] == "MIT" and 0.9 < got[2, "paragraph"]["dice"] < 1
    assert licenses.scan(no_docs).count() == 0 and licenses.scan(edge_docs).count() == 0


def test_license_inside_text(spark):
    mit, apache = dict(licenses.TEMPLATES)["MIT"], dict(licenses.TEMPLATES)["Apache-2.0-line"]
    parts = mit.replace(" The above", "\n\nThe above").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    other = " ".join(f"other{i} word" for i in range(150))
    rows = [(1, f"{other}\n\n{parts}\n\n{other}"), (2, f"We wrote this in May. {apache} Please send your notes to us."),
            (None, f"{apache}\n{other} {apache} {other}"), (None, other), (3, f"{other}\n{apache}\n\n{other}\nx {parts} y"),
            (4, f"{other} {dict(licenses.TEMPLATES)['Apache-2.0']} {other}")]
    got = sorted(((r["doc_id"] or 0, r["unit"], r["place"], r["license"], round(r["dice"], 2)) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    line = len(apache.replace(".", " ").split())
    assert [g for g in got if g[1] == "passage"] == [(0, "passage", line + 300, "Apache-2.0-line", 1.0), (1, "passage", 300, "MIT", 1.0), (2, "passage", 5, "Apache-2.0-line", 1.0), (3, "passage", 601 + line, "MIT", 1.0), (4, "passage", 300, "Apache-2.0", 1.0), (4, "passage", 300, "Apache-2.0-line", 1.0)]
    assert [g[:4] for g in got if g[1] == "line"] == [(0, "line", 0, "Apache-2.0-line"), (3, "line", 1, "Apache-2.0-line")]


def test_license_whole_texts(spark):
    """The wording as licence files have it, with numbers, title and copyright line."""
    at = dict(licenses.TEMPLATES)
    head = "BSD 2-Clause License\n\nCopyright (c) 2020, Some Body\nAll rights reserved.\n\n"
    two = at["BSD-2-Clause"].replace("met: ", "met:\n\n1. ").replace("disclaimer. Redistributions", "disclaimer.\n\n2. Redistributions").replace("distribution. THIS", "distribution.\n\nTHIS")
    three = "Copyright (c) 1998 Some Body and Others.\nAll rights reserved.\n\n" + at["BSD-3-Clause"].replace("met: ", "met:\n1. ").replace("disclaimer. Redistributions", "disclaimer.\n2. Redistributions").replace("distribution. Neither", "distribution.\n3. Neither")
    isc = "Copyright 2021 A B\n\n" + at["ISC"].replace("copies. ", "copies.\n\n")
    rows = [(1, head + two), (2, three), (3, isc)] + [(4 + i, at[k]) for i, k in enumerate(WHOLE)]
    got = {r["doc_id"]: (r["license"], r["dice"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("unit = 'text'").collect()}
    assert [got[i][0] for i in (1, 2, 3)] == ["BSD-2-Clause", "BSD-3-Clause", "ISC"] and all(got[i][1] > 0.9 for i in (1, 2, 3))
    assert [got[4 + i] for i in range(len(WHOLE))] == [(k, 1.0) for k in WHOLE]


WHOLE = ("Apache-2.0-text", "GPL-2.0-text", "GPL-3.0-text", "LGPL-2.1-text", "LGPL-3.0-text", "MPL-2.0-text", "Unlicense")


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labelled = docs.where("lang IS NOT NULL").count()
    first = corpus_pipeline.language(spark, docs, "")
    assert first.count() >= 0.98 * labelled and first.columns == docs.columns
    near = corpus_pipeline.near_copies(spark, docs, "")
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"] for r in near.collect()} == {root for _, root in want.values()}


def test_pipeline_rows_without_or_with_shared_ids(spark, edge_docs, tmp_path):
    import corpus_pipeline
    from tapeloom.llm import langid, mixing

    def plain(df):
        return Counter((r["doc_id"], r["text"]) for r in df.collect())

    more = spark.createDataFrame([(None, "the quick brown fox jumps over a lazy cat"), (None, None), (5, "ein schneller brauner fuchs und wort7")], "doc_id long, text string")
    docs = edge_docs.unionByName(more, allowMissingColumns=True).coalesce(1)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    numbered = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = langid.predict(numbered, langid.train(docs.where(~langid.held_out(F.col("doc_id"))))).collect()
    first = corpus_pipeline.language(spark, docs, "")
    assert plain(first) == Counter(rows[r["doc_id"]] for r in found if r["lang_pred"] != "und" and r["score"] >= 0.3)
    assert any(k is None for k, _ in plain(first)) and first.columns == docs.columns

    assert sorted(plain(corpus_pipeline.lines(spark, docs, "")).elements(), key=str) == brute_clean(rows)

    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    sets = [shingle_set(rows[k][1]) for k in order]
    root = list(range(len(order)))
    for _ in order:
        for b in range(len(order)):
            root[b] = min([root[b]] + [root[a] for a in range(len(order)) if match(sets[a], sets[b])])
    assert plain(corpus_pipeline.near_copies(spark, docs, "")) == Counter(rows[k] for i, k in enumerate(order) if root[i] == i)

    size = lambda t: len((t or "").split())
    want = {r["source"]: int(r["target"] + 1e-9) for r in mixing.mix(docs).collect()}
    mixed = corpus_pipeline.mix(spark, docs, "").collect()
    assert {s: sum(size(r["text"]) for r in mixed if r["source"] == s) for s in want} == want
    have, drawn = Counter(), Counter(r["doc_id"] for r in mixed)
    for i, _ in rows:
        have[i] += 1
    assert all(n <= 2 * have[i] for i, n in drawn.items())

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    step = docs
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, "")
    assert len(packed) == step.count() > 0


def test_license_in_a_very_long_text(spark):
    """Thousands of stray template bigrams, one notice among them: starts meet near ends only."""
    import time

    apache = dict(licenses.TEMPLATES)["Apache-2.0-line"]
    stray = " ".join(f"other{i} under the word{i} in compliance" for i in range(12_000))
    docs = spark.createDataFrame([(1, f"{stray} {apache} {stray}"), (2, stray)], "doc_id long, text string")
    t0 = time.time()
    got = [(r["doc_id"], r["unit"], r["license"]) for r in licenses.scan(docs).collect()]
    assert (1, "passage", "Apache-2.0-line") in got and all(d == 1 for d, _, _ in got)
    assert time.time() - t0 < 240


def test_license_units_of_near_texts_only(spark):
    """Only texts with enough bigrams of a template are cut into units; a line that just reaches the least likeness is found among them."""
    from pathlib import Path

    from tapeloom.session import shared_dir

    templates = spark.createDataFrame([("five", "one two three four five six"), ("long", " ".join(f"t{i}" for i in range(201)))], "license string, template string")
    rows = [(1, "two three four five"), (2, "two three four"), (3, "x two three\ny three four\nz four five"), (None, "other words"), (5, None), (6, "one"),
            (7, " ".join(f"t{i}" for i in range(121))), (8, " ".join(f"t{i}" for i in range(120))), (9, "t0 t1 " * 300), (9, "a\nTwo, three\tFOUR-five")]
    written = lambda: set(Path(shared_dir(spark).removeprefix("file:")).glob("license-near-texts-*"))
    before = written()
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates).collect()
    assert sorted((r["doc_id"], r["unit"], r["place"], r["license"], r["dice"]) for r in got) == [(1, "line", 0, "five", 0.75), (7, "line", 0, "long", 0.75), (9, "line", 1, "five", 0.75)]
    near = spark.read.parquet(*map(str, written() - before))
    assert sorted(r["doc_id"] for r in near.collect()) == [1, 3, 7, 9]


def test_fingerprints_shuffle_texts_once(spark, tmp_path, monkeypatch):
    """The join with the next document and the one with its characters read one shuffle of the texts."""
    plans, write = [], fingerprints.materialize
    monkeypatch.setattr(fingerprints, "materialize", lambda df, label="stage": (plans.append((label, df)), write(df, label))[1])
    rows = [(i, f"word{i} and word{i % 7}") for i in range(40)] + [(None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = fingerprints.compare(spark.read.parquet(f"{tmp_path}/d")).collect()
        plan = dict(plans)["signatures"]
        plan.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(got) == 41 and sum(r["doc_id"] is None for r in got) == 1
    final = plan._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0]
    assert "ReusedExchange" in final and "cast(key" not in final


@pytest.mark.parametrize("run", [line_dedup.flags, ngram_join.classes])
def test_common_passage_makes_no_long_list(spark, monkeypatch, run):
    """A passage that all texts share: its tokens go last wherever their hashes lie, and what was written on the way is gone."""
    from pathlib import Path

    from tapeloom.llm import setjoin
    from tapeloom.session import shared_dir

    lists, write = [], setjoin.materialize

    def keep(df, label="stage"):
        out = write(df, label)
        if label == "postings":
            lists.extend(r["count"] for r in out.groupBy("token").count().collect())
        return out

    for module in (setjoin, line_dedup, ngram_join):
        monkeypatch.setattr(module, "materialize", keep)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [" ".join(f"o{k}x{i}" for i in range(40)) + " " + passage for k in range(300)]
    rows = [*enumerate(texts), (300, texts[7] + " end"), (301, texts[7]), (302, None), (None, texts[9] + " end")]
    written = lambda: set(Path(shared_dir(spark).removeprefix("file:")).glob("p*-*"))  # noqa: E731  pairs, postings
    before = written()
    got = run(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    if run is line_dedup.flags:
        assert {r["doc_id"] for r in got if r["removed"]} == {300, 301, None} and len(got) == 303
    else:
        assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] != r["component_id"]} == {(300, 7), (301, 7), (None, 9)}
    if run is line_dedup.flags:  # documents know the frequency of a part of their tokens only
        assert max(lists) <= 2 * setjoin.FREQUENT
    assert not [p for p in written() - before if p.name.startswith(("pairs", "postings"))]


def test_join_lists_hold_no_common_passage(spark, monkeypatch):
    """Tokens of a passage that all texts share go last also where their hashes are high, if their texts run out of rare low ones."""
    lists, write = [], ngram_join.materialize

    def keep(df, label="stage"):
        out = write(df, label)
        if label == "postings":
            lists.extend(r["count"] for r in out.groupBy("token").count().collect())
        return out

    monkeypatch.setattr(ngram_join, "materialize", keep)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [" ".join(f"o{k}x{i}" for i in range(40)) + " " + passage for k in range(200)]
    rows = [*enumerate(texts), (200, texts[7] + " end"), (201, passage), (202, passage + " end")]
    got = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] != r["component_id"]} == {(200, 7), (202, 201)}
    assert len(got) == 203 and max(lists) <= 24


def test_join_long_lists_of_near_copies(spark, monkeypatch):
    """Copies with few to many changes, some linked to few others: stars of long lists and marks lose no link."""
    monkeypatch.setattr(ngram_join, "LONG", 3)
    monkeypatch.setattr(ngram_join, "STARS", 1)
    rng, rows = random.Random(5), []
    base = [f"w{i}" for i in range(90)]
    for i in range(110):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(90)] = f"e{i}x{rng.randrange(9)}"
        rows.append(" ".join(words))
    rows = [*enumerate(rows), *((200 + i, " ".join(base[i:] + [f"z{k}" for k in range(i)])) for i in range(0, 60, 3))]
    got = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_components(rows)
    assert len(set(c for _, c in want.values())) > 2
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
