"""Mixing sources to target weights with a hypergeometric splitting tree over blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import free, keyed, let, n_words, whole
from tapeloom.session import materialize

#: Words in a block of a source, about; and blocks drawn into one output shard, about.
BLOCK_WORDS = 1 << 19
SHARD_BLOCKS = 16


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: _s (rank, 1 first), source, source_size, target.

    Sources by code point, null last, weigh ``weights`` in turn. They share ``share`` times all
    sizes by weight; none gets above ``most`` times its own size, what is over goes to the others by
    weight until none is above. That end point is one level x with target = min(cap, x * weight):
    with sources in order of cap / weight, x is the largest of "what is left after the caps before, over
    the weights from here on". The windows run over one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("_s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("_w", F.element_at(turn, (F.col("_s") - 1) % len(weights) + 1)).withColumn("_cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_s")
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    capped = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("_x", (total - capped) / rest)
    level = level.withColumn("_x", F.max("_x").over(Window.partitionBy()))
    return level.select("_s", "source", "source_size", F.least("_cap", F.col("_x") * F.col("_w")).alias("target"))


def _uniform(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) / F.lit(float(1 << 52))


def hypergeometric(pool: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Marked items among ``drawn`` of ``pool`` when ``marked`` of it are; by inversion of ``u``.

    Outcomes are walked from the mode up and then down, by the ratio of neighbouring
    probabilities, as far as 14 deviations: what lies beyond is below double precision.
    """

    def bounds(s: Column) -> Column:
        lo, hi = F.greatest(F.lit(0.0), s["take"] - (s["pool"] - s["mark"])), F.least(s["mark"], s["take"])
        mode = F.least(F.greatest(F.floor((s["take"] + 1) * (s["mark"] + 1) / (s["pool"] + 2)).cast("double"), lo), hi)
        p = s["mark"] / F.greatest(s["pool"], F.lit(1.0))
        reach = F.ceil(14 * F.sqrt(s["take"] * p * (1 - p)) + 20).cast("double")
        return F.struct(s["pool"].alias("pool"), s["mark"].alias("mark"), s["take"].alias("take"), mode.alias("mode"),
                        F.greatest(lo, mode - reach).alias("lo"), F.least(hi, mode + reach).alias("hi"))

    def steps(a: Column, b: Column) -> Column:
        return F.when(b >= a, F.sequence(a.cast("long"), b.cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def up(s: Column, x: Column) -> Column:  # P(x + 1) / P(x)
        return (s["mark"] - x) * (s["take"] - x) / ((x + 1) * (s["pool"] - s["mark"] - s["take"] + x + 1))

    def down(s: Column, x: Column) -> Column:  # P(x - 1) / P(x)
        return x * (s["pool"] - s["mark"] - s["take"] + x) / ((s["mark"] - x + 1) * (s["take"] - x + 1))

    def walk(s: Column, start: Column, aim: Column) -> Column:
        """After both walks: sum of weights, and the outcome at which the sum passes ``aim``."""

        def state(w: Column, cum: Column, pick: Column) -> Column:
            return F.struct(w.alias("w"), cum.alias("cum"), pick.alias("pick"))

        def go(acc: Column, x: Column, ratio: Column, to: Column) -> Column:
            w = acc["w"] * ratio
            return state(w, acc["cum"] + w, F.when(acc["pick"].isNull() & (aim <= acc["cum"] + w), to).otherwise(acc["pick"]))

        first = state(F.lit(1.0), F.lit(1.0), F.when(aim <= 1.0, s["mode"]).cast("double"))
        rising = F.aggregate(steps(s["mode"], s["hi"] - 1), first, lambda a, x: go(a, x, up(s, x.cast("double")), x.cast("double") + 1))
        turned = F.transform(F.array(rising), lambda a: state(F.lit(1.0), a["cum"], a["pick"]))[0]
        falling = F.reverse(steps(s["lo"] + 1, s["mode"]))
        return F.aggregate(falling, turned, lambda a, x: go(a, x, down(s, x.cast("double")), x.cast("double") - 1))

    def draw(s: Column) -> Column:
        total = walk(s, s["mode"], F.lit(float("inf")))["cum"]
        return let(total, lambda t: F.coalesce(walk(s, s["mode"], u * t)["pick"], s["mode"]))

    given = F.struct(pool.cast("double").alias("pool"), marked.cast("double").alias("mark"), drawn.cast("double").alias("take"))
    return let(given, lambda g: let(bounds(g), draw)).cast("long")


def split_tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """Exact draws of every (source, shard): _s, shard, first (rank of its first draw), draws.

    ``quotas``: one row per source with _s (1, 2, ...) and draws. A node holds the vector of
    draws left for it; half of all its draws go left, and how many of each source is a multivariate
    hypergeometric draw, made source by source. 2 ** ``levels`` shards of equal size (to one draw)
    come out and the quotas are met exactly. A node is one row, its vector one number per source.
    """
    nodes = quotas.agg(F.transform(F.sort_array(F.collect_list(F.struct("_s", "draws"))), lambda x: x["draws"]).alias("q")).select(
        F.lit(0).cast("long").alias("node"), "q")

    def part_at(level: int):
        def part(acc: Column, k: Column) -> Column:
            u = _uniform(F.lit(seed), F.lit(level), F.col("node"), F.size(acc["left"]))
            return let(hypergeometric(acc["pool"], k, acc["need"], u), lambda x: F.struct(
                F.concat(acc["left"], F.array(x)).alias("left"), (acc["need"] - x).alias("need"), (acc["pool"] - k).alias("pool")))

        return part

    for level in range(levels):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        start = F.struct(F.array().cast("array<bigint>").alias("left"), F.floor(total / 2).cast("long").alias("need"), total.alias("pool"))
        halves = nodes.select("node", "q", F.aggregate("q", start, part_at(level))["left"].alias("l"))
        sides = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("l").alias("q")),
                        F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("q", "l", lambda a, b: a - b).alias("q")))
        nodes = halves.select(F.explode(sides).alias("side")).select("side.node", "side.q")
    flat = nodes.select(F.col("node").alias("shard"), F.posexplode("q").alias("_i", "draws")).select((F.col("_i") + 1).alias("_s"), "shard", "draws")
    before = Window.partitionBy("_s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return flat.withColumn("first", F.coalesce(F.sum("draws").over(before), F.lit(0)) + 1)


def _key(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 11,
        weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
        block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, passes, part, taken, draws.

    ``size`` counts words (null text: 0). A source's quota is its target in whole words. It is met by
    whole passes over the source (``passes`` of each document) and the first blocks of one more
    permuted pass; the block at the border is walked document by document, and the last one gives
    its first ``part`` words, so the taken words equal the quota. ``taken`` = passes * size + part.
    A source is cut into blocks of about ``block_words`` by a hash of the doc_id; null counts as a
    source, weighed last. ``draws`` lists struct(shard, words): where each draw of the document goes,
    words null for a whole copy. The shards come from ``split_tree``; every draw of a permuted
    list of a source's blocks belongs to one shard. Equal input gives equal results, as every
    random choice is a hash of its place and ``seed``. Rows that repeat a doc_id are taken one by
    one; ``row`` names a key of the rows that is carried along and settles ties of the order; an empty
    table gives no rows; a document without words is drawn but gives none.

    Text is read once, for the sizes. Totals, blocks and quotas are aggregates combined map-side;
    documents only meet their block's row, and only border blocks (one per source, of bounded
    words) are ordered.
    """
    also = [F.col(row)] if row else []
    sizes = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(whole(text)).alias("size"), *also), "sizes")
    goal = targets(sizes, weights, share, most)
    quota, size = F.floor("target").cast("long"), F.col("source_size")
    goal = goal.withColumn("passes", F.when(size > 0, F.floor(quota / size)).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("rest", quota - F.col("passes") * size)
    goal = materialize(goal.withColumn("blocks", F.greatest(F.lit(1), F.ceil(size / F.lit(block_words))).cast("long")), "goals")

    g = goal.withColumnRenamed("source", "_source")
    place = F.conv(F.substring(_key(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    rows = sizes.join(g, sizes["source"].eqNullSafe(g["_source"])).withColumn("block", F.pmod(place, F.col("blocks"))).drop("_source")

    blocks = rows.groupBy("_s", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    turn = Window.partitionBy("_s").orderBy(_key(seed, F.lit("rest"), F.col("block")), "block")
    before = F.coalesce(F.sum("words").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("_room", F.greatest(F.col("rest") - before, F.lit(0)))
    upto = F.when((F.col("_room") > 0) & (F.col("_room") < F.col("words")), F.col("_room"))
    more = (F.col("_room") >= F.col("words")) & (F.col("words") > 0)
    blocks = materialize(blocks.select("_s", "block", (F.col("passes") + more.cast("long")).alias("passes"), upto.alias("upto")), "blocks")

    copies = F.flatten(F.array(F.array_repeat(F.lit(None).cast("long"), F.col("passes").cast("int")),
                               F.when(F.col("upto").isNotNull(), F.array("upto")).otherwise(F.array().cast("array<bigint>"))))
    drawn = blocks.select("_s", "block", F.posexplode(copies).alias("pass", "words"))
    lot = Window.partitionBy("_s").orderBy(_key(seed, F.lit("draw"), F.col("pass"), F.col("block")), "block", "pass")
    drawn = drawn.withColumn("draw", F.row_number().over(lot).cast("long"))
    quotas = goal.select("_s").join(drawn.groupBy("_s").agg(F.count(F.lit(1)).alias("draws")), "_s", "left").na.fill({"draws": 0})
    all_draws = blocks.agg(F.sum(F.col("passes") + F.col("upto").isNotNull().cast("long"))).first()[0] or 0
    levels = max(0, (-(-all_draws // shard_blocks) - 1).bit_length())
    shards = split_tree(quotas, levels, seed).where("draws > 0")
    shards = shards.select("_s", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("draws") - 1)).alias("draw"))
    placed = drawn.join(shards, ["_s", "draw"]).groupBy("_s", "block").agg(
        F.sort_array(F.collect_list(F.struct("shard", "words"))).alias("draws"), F.max("words").alias("upto"),
        F.sum(F.col("words").isNull().cast("long")).alias("whole"))

    rows = rows.drop("passes", "rest", "blocks").join(placed, ["_s", "block"], "left")
    none = F.array().cast(placed.schema["draws"].dataType)
    rows = rows.select("doc_id", "source", "size", "source_size", "target", "_s", "block", "upto", F.coalesce("whole", F.lit(0)).alias("passes"), F.coalesce("draws", none).alias("draws"), *also)
    border = Window.partitionBy("_s", "block").orderBy(_key(seed, F.lit("cut"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "doc_id", "size", *also)
    ahead = F.coalesce(F.sum("size").over(border.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = rows.where(F.col("upto").isNotNull()).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("upto") - ahead)))
    plain = rows.where(F.col("upto").isNull()).withColumn("part", F.lit(0).cast("long"))
    out = cut.unionByName(plain)
    # a cut block's draw holds the document's own words, and nothing where the border lies before it
    own = F.transform("draws", lambda d: F.struct(d["shard"].alias("shard"), F.when(d["words"].isNotNull(), F.col("part")).alias("words")))
    own = F.filter(own, lambda d: d["words"].isNull() | (d["words"] > 0))
    return out.select("doc_id", "source", "size", "source_size", "target", "passes", "part",
                      (F.col("passes") * F.col("size") + F.col("part")).alias("taken"), own.alias("draws"), *also)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: the columns of ``docs`` and, last, the shard (``_shard``, with underscores added if ``docs`` has such a
    column): a row for each draw of a document, shuffled inside each shard.

    A document that is drawn in part gives its first words. Rows meet their own draws by a written row key,
    so doc_ids may be null or repeat. Shards are hashed to tasks and ordered by a hash there; no order spans tasks.
    """
    seed = options.get("seed", 11)
    docs, row = keyed(docs)
    columns = [c for c in docs.columns if c != row]
    draw, body, shard, lot = (free(n, docs.columns) for n in ("_draw", "_text", "_shard", "_lot"))
    chosen = mix(docs, doc_id, text, source, row=row, **options).where(F.size("draws") > 0)
    rows = docs.join(chosen.select(row, F.explode("draws").alias(draw)), row)
    words = F.col(draw)["words"]
    cut = F.when(words.isNull() | (words >= n_words(whole(text))), F.col(text)).otherwise(first_words(F.col(text), words))
    rows = rows.withColumn(body, cut).withColumn(shard, F.col(draw)["shard"]).withColumn(lot, _key(seed, F.col(shard), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    rows = rows.repartition(shard).sortWithinPartitions(shard, lot, row)
    keep = [F.col(body).alias(c) if c == text else F.col(c) for c in columns]
    return rows.select(*keep, shard)
