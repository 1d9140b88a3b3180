"""The Merkle manifest against a plain recursive computation."""

from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(x):
    return sha256(x.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """Root of ``nodes`` and for each its siblings [(on the left, hex)], and None for a lone step."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            steps[k].append((i % 2 == 1, nodes[i ^ 1]) if i ^ 1 < len(nodes) else None)
        nodes = [h("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return nodes[0], steps


def brute(rows, changed):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    part = {}
    for g in names:
        members = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        part[g] = (members, *climb([leaf(r) for r in members]))
    root, tops = climb([part[g][1] for g in names])
    out = []
    for g, top in zip(names, tops):
        members, sub, steps = part[g]
        for r, own in zip(members, steps):
            node = leaf(changed(r))
            for s in own + top:
                node = h(node) if s is None else h(s[1] + node if s[0] else node + s[1])
            out.append((r[0], leaf(r), sub, root, h("".join(s[1] for s in own + top if s)), node, node == root))
    return sorted(out, key=str)


def got(spark, rows, claimed=None, clash=()):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df = df.withColumns({c: F.lit("x") for c in clash}) if clash else df
    return merkle.proofs(merkle.build(df, FIELDS, claimed=claimed))


@pytest.mark.parametrize("levels", [1, 2, 3, 5, 9, 12])
def test_layout_is_a_permutation_of_whole_subtrees(levels):
    places = [merkle.address(levels, d, np.arange(1 << d)) for d in range(levels)]
    assert sorted(np.concatenate(places)) == list(range((1 << levels) - 1))
    if levels > 2:  # a bottom tree of the first cut lies in one run
        top, low = levels // 2, levels - levels // 2
        for tree in range(1 << top):
            own = np.concatenate([merkle.address(levels, top + d, (tree << d) + np.arange(1 << d)) for d in range(low)])
            assert sorted(own) == list(range((1 << top) - 1 + tree * ((1 << low) - 1), (1 << top) - 1 + (tree + 1) * ((1 << low) - 1)))


@pytest.mark.parametrize("height", [1, 2, 8])
def test_manifest(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    if height != 8:
        # workers read the module's own height: run the functions of the tasks here
        for n in (1, 2, 3, 5, 6, 9, 17):
            nodes, level = [h(str(i)) for i in range(n)], []
            want, steps = climb(nodes)
            rows = [bytes.fromhex(x) for x in nodes]
            while True:
                cut = [rows[i : i + (1 << height)] for i in range(0, len(rows), 1 << height)]
                trees = [merkle.grow(np.frombuffer(b"".join(c), np.uint8).reshape(-1, 32), merkle._levels(len(rows), len(c))) for c in cut]
                level.append((trees, [len(c) for c in cut]))
                if len(rows) <= 1 << height:
                    break
                rows = [t[0].tobytes() for t in trees]
            assert trees[0][0].tobytes().hex() == want
            path = [b""]
            for trees, sizes in reversed(level):
                path = [own.tobytes() + p for t, m, p in zip(trees, sizes, path) for own in merkle.paths(t, m)]
            for x, p, s in zip(nodes, path, steps):
                assert merkle.fold(bytes.fromhex(x), p) == (h("".join(y[1] for y in s if y)), want)
        return
    rows = [(i, f"s{i % 3}", "en", i * 3, f"text {i} é") for i in range(700)] + [(i, None, "de", None, "") for i in range(257)]
    rows += [(i, "s", None, 1, None) for i in range(5)] + [(9, "s", "", 1, "lone"), (1, "s", "漢", 2, "\U0001f600"), (None, "s", "fr", 2, "a"), (None, "s", "fr", 2, "a"), (None, "s", "fr", 3, "b")]
    rows += [(7, "x", "l" + str(i), 0, "") for i in range(30)]
    claim = {"n_chars": F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    change = lambda r: (*r[:3], r[3] + 1, r[4]) if r[0] is not None and r[0] % 5 == 0 and r[3] is not None else r
    found = got(spark, rows, claim, ("g", "id", "digest", "at", "n", "row", "claim", "block", "root"))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, change)


def test_small_and_empty(spark, edge_docs, no_docs):
    one = [(3, None, "en", 1, "a")]
    assert [tuple(r) for r in got(spark, one).collect()] == brute(one, lambda r: r)
    assert got(spark, one).first().proof_sha256 == h("")
    assert got(spark, []).count() == 0
    found = merkle.proofs(merkle.build(edge_docs, FIELDS))
    assert found.count() == edge_docs.count() and found.where(~F.col("verified")).count() == 0
    assert merkle.build(no_docs, FIELDS).root().count() == 0


def test_tampered_rows_fail_alone(spark):
    rows = [(i, "s", "en", i, str(i)) for i in range(40)]
    claim = {"text": F.when(F.col("doc_id") == 17, F.lit("other")).otherwise(F.col("text"))}
    bad = got(spark, rows, claim).where(~F.col("verified")).collect()
    assert [r.doc_id for r in bad] == [17]
