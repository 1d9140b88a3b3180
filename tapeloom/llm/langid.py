"""Language identification: known words first, shorter and shorter character n-grams for the rest."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import sized, whole
from tapeloom.session import materialize

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Labelled rows that the model is fitted on, about, in equal parts over the languages; a language with fewer gives all it has. Every
#: word and n-gram of these rows is in the model with its count in every language.
SAMPLE_ROWS = 20_000
ORDERS = (4, 3, 2, 1)
#: Entries of a worker's tables before they are written out or emptied (of scores: divided by the languages). Bounds memory only.
HELD = 300_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters."""
    found = LETTERS.findall(text.lower())
    return found if not found or found[0].isalpha() else [w for w in found if any(c.isalpha() for c in w)]


def grams_of(word: str, order: int) -> list[str]:
    padded = f"<{word}>" if order > 1 else word
    return [padded[i : i + order] for i in range(max(1, len(padded) - order + 1))]


def _counted(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts per (lang, order, term) of what the task reads, written out whenever the table is full."""
        held: dict[str, Counter] = {}
        full = 0

        def out():
            for lang, counts in held.items():
                for order in {k[0] for k in counts} if kind == "gram" else {0}:
                    items = [(k[1], n) for k, n in counts.items() if k[0] == order] if kind == "gram" else list(counts.items())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(items), pa.string()), pa.array([order] * len(items), pa.int32()),
                         pa.array([x for x, _ in items], pa.string()), pa.array([n for _, n in items], pa.int64())],
                        names=["lang", "order", "term", "n"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = held.setdefault(row[0], Counter())
                had = len(counts)
                if kind == "word":
                    counts.update(words_of(row[1]))
                else:
                    for order in ORDERS:
                        for g in grams_of(row[1], order):
                            counts[order, g] += row[2]
                full += len(counts) - had
                if full > HELD:
                    yield from out()
                    held, full = {}, 0
        yield from out()

    return run


@dataclass
class Model:
    """Counts as logarithms: per term the languages that have it, per order what all others get."""

    langs: list[str]
    #: order and term -> place
    at: dict[str, int]
    #: languages of the term at place i: ``who[ends[i] : ends[i + 1]]``, with their log frequencies
    ends: np.ndarray
    who: np.ndarray
    logs: np.ndarray
    #: log frequency of a term that a language lacks, by order
    lacks: dict[int, np.ndarray]

    def scores(self, key: str) -> np.ndarray | None:
        """Log frequency of a term in every language, or None if no language has it."""
        i = self.at.get(key)
        return None if i is None else self.row(i, int(key[0]))

    def row(self, i: int, order: int) -> np.ndarray:
        out = self.lacks[order].copy()
        out[self.who[self.ends[i] : self.ends[i + 1]]] = self.logs[self.ends[i] : self.ends[i + 1]]
        return out


def sample(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the rows (lang, text), in equal parts over the languages, by a hash of the text and the row's number; all if there are fewer."""
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_rows"))
    n = sizes.count()
    sizes = sized(sizes.withColumn("_part", F.lit(most) / F.lit(max(1, n)) / F.col("_rows")), n)
    lot = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1 << 30)) / (1 << 30)
    return rows.withColumn("_lot", lot).join(sizes, "lang").where(F.col("_lot") < F.col("_part")).select("lang", "text")


def train(docs: DataFrame, lang: str = "lang", text: str = "text", most: int = SAMPLE_ROWS) -> Model:
    """The model of documents with a non-null ``lang`` and text, fitted on about ``most`` of them.

    A term's share in a language is (count + 1/2) / (all counts + half the number of terms of its order). Counts
    are made in Spark; what comes to the driver is bounded by the words of the sampled rows.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = sample(rows, most)
    schema = "lang string, order int, term string, n long"
    words = rows.mapInArrow(_counted("word"), schema).groupBy("lang", "order", "term").agg(F.sum("n").alias("n"))
    words = materialize(words, "words")
    grams = words.select("lang", "term", "n").mapInArrow(_counted("gram"), schema).groupBy("lang", "order", "term").agg(F.sum("n").alias("n"))
    table = words.unionByName(grams).orderBy("order", "term", "lang").toArrow().to_pandas()
    langs = sorted(table["lang"].unique().tolist())
    who = table["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int32)
    order, n = table["order"].to_numpy(), table["n"].to_numpy(float)
    first = np.flatnonzero(((table["order"] != table["order"].shift()) | (table["term"] != table["term"].shift())).to_numpy())
    at = {f"{o}{t}": i for i, (o, t) in enumerate(zip(order[first].tolist(), table["term"].iloc[first].tolist()))}
    logs, lacks = np.zeros(len(n), np.float32), {}
    for o in (0, *ORDERS):
        here = order == o
        total = np.bincount(who[here], n[here], minlength=len(langs)) + 0.5 * max(1, int((order[first] == o).sum()))
        logs[here] = np.log((n[here] + 0.5) / total[who[here]])
        lacks[o] = np.log(0.5 / total).astype(np.float32)
    return Model(langs, at, np.append(first, len(n)), who, logs, lacks)


class _Scores(dict):
    """Word -> row of ``table``, made when a word is first met: its own log frequencies, or by backoff if no language has it."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.end = model, 0
        #: rows of the n-grams met so far: at most those of the model, and emptied with the words
        self.grams: dict[int, np.ndarray] = {}
        self.table = np.zeros((1024, len(model.langs)), np.float32)

    def _backoff(self, word: str) -> np.ndarray:
        for order in ORDERS:
            places = [i for g in grams_of(word, order) if (i := self.model.at.get(f"{order}{g}")) is not None]
            if places:
                return sum(self._gram(i, order) for i in places) / len(places)
        return np.zeros(len(self.model.langs), np.float32)

    def _gram(self, i: int, order: int) -> np.ndarray:
        row = self.grams.get(i)
        if row is None:
            row = self.grams[i] = self.model.row(i, order)
        return row

    def __missing__(self, word: str) -> int:
        score = self.model.scores(f"0{word}")
        if self.end == len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        self.table[self.end] = self._backoff(word) if score is None else score
        self[word] = self.end
        self.end += 1
        return self.end - 1


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score; only the text is looked at.

    ``und`` with score 0 for a null text, a text without any letter, or an empty model. Otherwise the
    language with the largest mean score over all words of the text (first by name on a tie); the score is its
    softmax share, sharper with more words. Text in unknown letters gets a share near one over the number of languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = shared.value.langs
        scores = _Scores(shared.value) if langs else None
        for batch in batches:
            best, share = [], []
            for x in batch.column(1):
                words = words_of(x.as_py())
                if not words or scores is None:
                    best.append(UNKNOWN), share.append(0.0)
                    continue
                rows = np.fromiter(map(scores.__getitem__, words), np.int64, len(words))
                mean = scores.table[rows].mean(0, dtype=np.float64)
                p = np.exp((mean - mean.max()) * min(len(words), 20))
                k = int(np.argmax(mean))
                best.append(langs[k]), share.append(float(p[k] / p.sum()))
                if scores.end * len(langs) > 4 * HELD:
                    scores = _Scores(shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(share, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text")).mapInArrow(run, schema)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learns from the labelled documents that are not held out, predicts for all: doc_id, held_out, lang_pred, score."""
    model = train(docs.where(~held_out(F.col(doc_id))), lang, text)
    return predict(docs, model, doc_id, text).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
