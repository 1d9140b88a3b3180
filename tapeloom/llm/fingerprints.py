"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import SPACE, keyed, whole
from tapeloom.session import materialize

SAMPLES = 64
#: Samples that one row of the aggregate makes; more make a method too long to be compiled.
_TOGETHER = 8
#: Bits of each uniform number, and of a sample.
_BITS, _LOW = 12, 20
#: In keys a null doc_id is this number, and its row is less by NO_ID, so below zero.
_LAST, NO_ID = (1 << 63) - 1, 1 << 62


def log_table(spark: SparkSession) -> Column:
    """Minus the logs of the uniform numbers, as one array that every sample looks its logs up in."""
    one = -F.ln((F.col("id") + 0.5) / float(1 << _BITS))
    rows = spark.range(1 << _BITS).agg(F.transform(F.sort_array(F.collect_list(F.struct("id", one.alias("x")))), lambda v: v["x"]).alias("a"))
    return materialize(rows, "logs").scalar()


def weighted_terms(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``terms``: array of struct(h, w), hash of each different word of ``text`` and how often it occurs."""
    df = df.withColumn("_w", F.sort_array(F.transform(F.array_remove(F.split(text, SPACE), ""), lambda w: F.xxhash64(w))))
    index = F.when(F.size("_w") > 0, F.sequence(F.lit(0), F.size("_w") - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_at", F.filter(index, lambda i: (i == 0) | (F.get(F.col("_w"), i) != F.get(F.col("_w"), F.greatest(i - 1, F.lit(0))))))
    last = F.size("_w")
    df = df.withColumn("terms", F.transform("_at", lambda p, k: F.struct(
        F.get(F.col("_w"), p).alias("h"), (F.coalesce(F.get(F.col("_at"), k + 1), last) - p).alias("w"))))
    return df.drop("_w", "_at")


def signatures(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """``keys`` and ``sig`` (array of SAMPLES numbers) from rows with ``keys`` and ``terms``; ``by``: those of the keys that rows are dealt by.

    For sample j a term of weight w draws r and c from Gamma(2, 1) (minus the log of a product of two
    uniform numbers) and b from [0, 1), all from a hash of term and j; t = floor(ln w / r + b), and the term with the least ln c - r (t - b) - r wins. The sample is
    its hash with t; two documents agree on it with the probability sum of min / sum of max of their
    weights. The least is taken over whole numbers that hold the rounded value above, the sample below.
    """
    flat = rows.select(*keys, F.explode_outer("terms").alias("_t"))
    flat = flat.select(*keys, F.col("_t.h").alias("_h"), F.ln(F.col("_t.w").cast("double")).alias("_lw"))
    starts = range(0, SAMPLES, _TOGETHER)
    logs = log_table(rows.sparkSession)
    flat = flat.select("*", F.explode(F.array(*[F.lit(j) for j in starts])).alias("_j"))

    def sample(j: Column) -> Column:
        u = F.xxhash64("_h", j)
        bits = lambda k: F.shiftrightunsigned(u, _BITS * k).bitwiseAND(F.lit((1 << _BITS) - 1))
        part = lambda k: F.get(logs, bits(k).cast("int"))
        r, log_c, b = part(0) + part(1), F.ln(part(2) + part(3)), (bits(4) + 0.5) / float(1 << _BITS)
        t = F.floor(F.col("_lw") / r + b)
        value = log_c - r * (t - b) - r
        high = F.shiftleft(((value + 64.0) * float(1 << 33)).cast("long"), _LOW)
        low = F.col("_h").bitwiseXOR(t * F.lit(0x9E377)).bitwiseAND(F.lit((1 << _LOW) - 1))
        return high.bitwiseOR(low)  # null without a term, as _lw is

    least = flat.groupBy(*keys, "_j").agg(*[F.min(sample(F.col("_j") + k)).alias(f"_s{k}") for k in range(_TOGETHER)])
    one = lambda c: F.coalesce(F.col(c), F.lit(-1).cast("long")).bitwiseAND(F.lit((1 << _LOW) - 1)).cast("int")
    least = least.select(*keys, "_j", *[one(f"_s{k}").alias(f"_s{k}") for k in range(_TOGETHER)]).repartition(*by)
    whole_sig = least.groupBy(*keys).agg(*[F.max(F.when(F.col("_j") == j, F.col(f"_s{k}"))).alias(f"_s{j + k}") for j in starts for k in range(_TOGETHER)])
    return whole_sig.select(*keys, F.array(*[F.col(f"_s{j}") for j in range(SAMPLES)]).alias("sig"))


def as_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), 5, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of samples on which two signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(SAMPLES))


def successors(ids: DataFrame) -> DataFrame:
    """key, next: structs (id, row) of each row and of the next by descending id, then row, null last; after the last comes the first. ``ids``: different keys.

    Ids are dealt by range; the order inside a range is a window there, and one row per range carries its
    first id to the range before.
    """
    down = [F.col("key.id").desc_nulls_last(), F.col("key.row").desc()]
    cut = ids.repartitionByRange(*down).withColumn("_range", F.spark_partition_id())
    cut = materialize(cut, "ranges")
    inside = Window.partitionBy("_range").orderBy(*down)
    along = Window.orderBy("_range")
    heads = cut.groupBy("_range").agg(F.max("key").alias("_head"))
    heads = heads.withColumn("_following", F.coalesce(F.lead("_head").over(along), F.first("_head").over(along)))
    rows = cut.withColumn("_next", F.lead("key").over(inside))
    return rows.join(heads, "_range").select("key", F.coalesce("_next", "_following").alias("next"))


def compare(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document's, by descending doc_id; the first follows the last. Null text counts as empty. A fingerprint is
    SAMPLES samples of the words and their counts; texts without a word share one, and are alike to
    each other only. A row is a document: rows that share a doc_id, or have none, follow each other by their
    numbers, written for them; without a doc_id they are last in order. An empty table gives no rows.

    Texts are shuffled once by doc_id; the next document then sends only the characters that its neighbour takes.
    Words are counted inside each row, and samples of a row's words are combined in the task that reads
    them; only signatures travel after that. The key is two plain numbers, never null: a struct is cast where one side has been
    written, and then the texts are shuffled twice.
    """
    row = F.lit(0).cast("long")
    if docs.groupBy(doc_id).count().where("count > 1").limit(1).count():
        docs, name = keyed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
        doc_id, text, row = "doc_id", "text", F.col(name)
    row = F.when(F.col(doc_id).isNull(), row - F.lit(NO_ID)).otherwise(row)
    number = lambda c: F.coalesce(c, F.lit(_LAST).cast("long"))
    texts = docs.select(number(F.col(doc_id).cast("long")).alias("id"), row.alias("row"), whole(text).alias("text"))
    order = successors(docs.select(F.struct(F.col(doc_id).cast("long").alias("id"), row.alias("row")).alias("key")))
    order = order.select(number(F.col("key.id")).alias("id"), "key.row", number(F.col("next.id")).alias("next_id"), F.col("next.row").alias("next_row"))
    order = materialize(order, "successors")
    key = ["id", "row"]
    half = F.floor(F.length("text") / 2).cast("int")
    taken = texts.select(*key, half.alias("_n")).join(order, key).select(F.col("next_id").alias("id"), F.col("next_row").alias("row"), F.col("id").alias("_id"), F.col("row").alias("_row"), "_n")
    tail = texts.join(taken, key).select(F.col("_id").alias("id"), F.col("_row").alias("row"), F.substr("text", F.lit(1), F.col("_n")).alias("_tail"))
    n = F.length("text")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.col("_tail"))
    both = texts.join(tail, key).select(*key, n.cast("long").alias("n_chars"), "text", edited.alias("_edited"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("body")), F.struct(F.lit(1).alias("side"), F.col("_edited").alias("body")))
    own = [*key, "n_chars", "sha"]
    rows = both.select(*key, "n_chars", F.unhex(F.sha2("_edited", 256)).alias("sha"), F.explode_outer(sides).alias("_x"))
    rows = weighted_terms(rows.select(*own, "_x.side", "_x.body"), F.col("body")).drop("body")
    sig = signatures(rows, [*own, "side"], key)
    pick = lambda k: F.max(F.when(F.col("side") == k, F.col("sig")))
    sig = materialize(sig.groupBy(*own).agg(pick(0).alias("sig"), pick(1).alias("edited_sig")), "signatures")
    following = sig.select(F.col("id").alias("next_id"), F.col("row").alias("next_row"), F.col("sig").alias("next_sig"))
    out = sig.join(order.join(following, ["next_id", "next_row"]).select(*key, "next_sig"), key)
    return out.select(
        F.when(F.col("row") >= 0, F.col("id")).alias("doc_id"), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"),
        as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))
