"""Language scores against a plain computation, many labels, sampled training."""

import math
import random
from collections import Counter, defaultdict

from tapeloom.llm import langid

SCHEMA = "doc_id long, text string, lang string"


def brute(train, texts):
    """(language, score) of every text: the same smoothing, worked out word by word."""
    counts = defaultdict(Counter)
    for text, lang in train:
        if text is None or lang is None:
            continue
        for w in langid.words_of(text):
            counts[lang, 0][w] += 1
    langs = sorted({k[0] for k in counts})
    for lang in langs:
        for w, n in counts[lang, 0].items():
            for o in langid.ORDERS:
                for g in langid.grams_of(w, o):
                    counts[lang, o][g] += n
    terms = {o: set().union(*(counts[x, o] for x in langs)) for o in (0, *langid.ORDERS)}
    log = lambda x, o, t: math.log((counts[x, o][t] + 0.5) / (sum(counts[x, o].values()) + 0.5 * len(terms[o])))

    def word(w, x):
        if w in terms[0]:
            return log(x, 0, w)
        for o in langid.ORDERS:
            known = [g for g in langid.grams_of(w, o) if g in terms[o]]
            if known:
                return sum(log(x, o, g) for g in known) / len(known)
        return 0.0

    for text in texts:
        ws = langid.words_of(text or "")
        if not ws:
            yield "und", 0.0
            continue
        mean = [sum(word(w, x) for w in ws) / len(ws) for x in langs]
        e = [math.exp((m - max(mean)) * min(len(ws), 20)) for m in mean]
        yield langs[e.index(max(e))], max(e) / sum(e)


def test_scores_equal_a_plain_computation(spark):
    rng = random.Random(8)
    bags = {x: [f"{x}{a}{b}" for a in "aeiou" for b in "klmst"] + ["und", "le", "mit"] for x in ("ka", "ke", "li")}
    text = lambda x: " ".join(rng.choice(bags[x]) for _ in range(rng.randint(1, 12)))
    train = [(text(x), x) for x in bags for _ in range(25)] + [(None, "ka"), ("12 - 3", "li"), ("solo", None)]
    texts = [text(rng.choice(list(bags))) for _ in range(60)] + ["kaat kett", "zzz", "ka", "", None, "漢字 kaakk", "Und LE mit"] + ["kaxxyl " * 30]
    model = langid.train(spark.createDataFrame([(i, *r) for i, r in enumerate(train)], SCHEMA))
    found = langid.predict(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA), model).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in found}
    for i, (lang, score) in enumerate(brute(train, texts)):
        assert math.isclose(got[i][1], score, abs_tol=1e-4), (texts[i], got[i], lang, score)
        assert got[i][0] == lang or abs(score - got[i][1]) < 1e-6 and score < 0.52, (texts[i], got[i], lang)


def test_a_thousand_labels_keep_their_words(spark):
    letters = "abcdefghijklmnopqrst"
    name = lambda i: "".join(letters[(i // 20**k) % 20] for k in range(4))
    rows = [(i, " ".join(f"{name(i)}{name(j)}" for j in range(30)), f"l{i:04d}") for i in range(1000)]
    model = langid.train(spark.createDataFrame(rows, SCHEMA))
    assert len(model.langs) == 1000 and sum(k[0] == "0" for k in model.at) == 30_000
    test = [(i, f"{name(i)}{name(3)} {name(i)}{name(7)}", None) for i in range(0, 1000, 7)]
    for r in langid.predict(spark.createDataFrame(test, SCHEMA), model).collect():
        assert r.lang_pred == f"l{r.doc_id:04d}"


def test_counts_are_true_in_every_language(spark):
    rows = [(i, "common word", "big") for i in range(500)] + [(1000 + i, "common rare", "small") for i in range(5)]
    model = langid.train(spark.createDataFrame(rows, SCHEMA))
    big, small = (math.exp(x) for x in model.scores("0common"))
    assert abs(big - 500.5 / 1001.5) < 1e-6 and abs(small - 5.5 / 11.5) < 1e-6


def test_sample_is_bounded_and_fair(spark):
    rows = [(i, f"wort{i % 300}", "hot") for i in range(20_000)] + [(30_000 + i, f"mot{i}", "cold") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).select("lang", "text")
    got = Counter(r["lang"] for r in langid.sample(df, 1000).collect())
    assert got["cold"] == 40 and 350 < got["hot"] < 650
    assert langid.sample(df.where("lang = 'none'"), 10).count() == 0
    same = spark.createDataFrame([("x", "one text")] * 3000, "lang string, text string")  # copies do not stand or fall together
    assert 50 < langid.sample(same, 100).count() < 150
