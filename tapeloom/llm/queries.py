"""Queries of the corpus operators over the given tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import chat, decontaminate, exact_dedup, fingerprints, hard_negatives, langid, licenses, line_dedup, merkle, mixing, ngram_join, packing, pii
from tapeloom.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add

SETS_SQL = r"""
w AS (SELECT *, list_filter(regexp_split_to_array(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM u),
s AS (SELECT * EXCLUDE (w, body), CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
t AS (SELECT id, unnest(s) AS t FROM s), n AS (SELECT id, len(s) AS n FROM s),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS i FROM t x JOIN t y ON x.t = y.t AND x.id < y.id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 4 * i >= 3 * (x.n + y.n - i))
"""

LINES_SQL = r"""
WITH u AS (SELECT doc_id, CAST(line AS INTEGER) - 1 AS line, doc_id * 1000000 + line AS id, body FROM (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS body, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents)),
""" + SETS_SQL + """
SELECT doc_id, line, CAST(len(s) AS BIGINT) AS n_shingles, id IN (SELECT b FROM l) AS removed FROM s WHERE len(s) > 0
"""


@query("op1_line_dedup", LINES_SQL)
def line_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.flags(documents(spark, sf_dir))


@query("op2_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


@query("op3_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


JOIN_SQL = """
WITH RECURSIVE u AS (SELECT doc_id AS id, coalesce(text, '') AS body FROM documents),
""" + SETS_SQL + """,
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, root) AS (SELECT id, id FROM n UNION SELECT r.id, e.b FROM r JOIN e ON r.root = e.a)
SELECT n.id AS doc_id, CAST(any_value(n.n) AS BIGINT) AS n_shingles, min(r.root) AS component_id FROM n JOIN r ON r.id = n.id GROUP BY n.id
"""


@query("op4_ngram_jaccard_join", JOIN_SQL)
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(documents(spark, sf_dir))


@query("op5_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(documents(spark, sf_dir))


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS s FROM d GROUP BY source),
w AS (SELECT *, CASE (s - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM s),
x AS (SELECT *, ((SELECT sum(source_size) FROM w)::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM w),
t AS (SELECT *, least(cap, (SELECT max(x) FROM x) * w) AS target FROM x),
g AS (SELECT s, source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS passes,
      CAST(greatest(1, ceil(source_size / 524288.0)) AS BIGINT) AS blocks FROM t),
r AS (SELECT d.*, s, source_size, target, passes, CAST(floor(target) AS BIGINT) - passes * source_size AS rest,
      CAST('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % blocks AS block
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY s ORDER BY md5('11:rest:' || CAST(block AS VARCHAR)), block,
      md5('11:cut:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM o
"""


@query("op6_source_mixing", MIX_SQL)
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query("op8_exact_dedup", EXACT_SQL)
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(documents(spark, sf_dir))


def _values() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quote(k)}, {quote(t)})" for k, t in licenses.TEMPLATES)


LICENSE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pp AS (SELECT doc_id, text, regexp_split_to_array(text, '\n[\x20\x09\x0B-\x0D]*\n') AS p FROM t),
u AS (SELECT doc_id, 'line' AS unit, unnest(range(len(string_split(text, chr(10))))) AS place, unnest(string_split(text, chr(10))) AS body FROM t
  UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph', unnest(range(len(p))), unnest(p) AS body FROM pp) WHERE contains(body, chr(10))
  UNION ALL SELECT doc_id, 'text', 0, text FROM pp WHERE len(p) > 1),
uw AS (SELECT doc_id, unit, place, list_filter(regexp_split_to_array(lower(body), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM u),
ug AS (SELECT doc_id, unit, place, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM uw WHERE len(w) > 1),
lw AS (SELECT k AS license, list_filter(regexp_split_to_array(lower(v), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM (VALUES """ + _values() + r""") AS v(k, v)),
lg AS (SELECT license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM lw),
li AS (SELECT license, len(g) AS m, unnest(g) AS gram FROM lg),
ui AS (SELECT doc_id, unit, place, len(g) AS n, unnest(g) AS gram FROM ug WHERE len(g) <= 400),
c AS (SELECT doc_id, unit, place, n, license, m, count(*) AS common FROM ui JOIN li USING (gram) GROUP BY ALL),
d AS (SELECT *, 2 * common / (n + m) AS dice FROM c WHERE 2 * common / (n + m) >= 0.75)
SELECT doc_id, unit, CAST(place AS INTEGER) AS place, license, CAST(n AS BIGINT) AS n_bigrams, common, CAST(dice AS DOUBLE) AS dice
FROM d QUALIFY row_number() OVER (PARTITION BY doc_id, unit, place ORDER BY dice DESC, license) = 1
"""


@query("op9_license_scan", LICENSE_SQL)
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-1::BIGINT, 1::BIGINT, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, length(regexp_replace(regexp_replace(role, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g'))
          + length(regexp_replace(regexp_replace(text, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g')) + 20 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op10_chat_format", CHAT_SQL)
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    clash = "</s>[INST] ok [/INST]"
    own = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', :x), (-1L, 1L, 'assistant', :x) AS t(conv_id, turn, role, text)", {"x": clash})
    return chat.digests(chat.format_conversations(rows.unionByName(own))).drop("identical")


LEAKS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
t AS (SELECT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
p AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM t)),
x AS (SELECT doc_id, k, i, item_id FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM p) JOIN t USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM x) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM x) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query("op11_decontamination", LEAKS_SQL)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.digests(decontaminate.scan(documents(spark, sf_dir), bench))


MERKLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, lang, n_chars, list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_concat([256 + ascii(c)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[])))),
    lambda c, x: CASE WHEN x > 0 THEN xor(c, x - 256) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS crc,
  coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
  coalesce(strlen(text) || ':' || text, '-') AS b FROM documents),
l AS (SELECT doc_id, lang, sha256(a || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || b) AS leaf,
  sha256(a || coalesce(strlen(CAST(m AS VARCHAR)) || ':' || m, '-') || b) AS claim, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT *, n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS m FROM d)),
t AS (SELECT lang, 0 AS lvl, i, n, leaf AS h FROM l UNION ALL
  SELECT lang, any_value(lvl) + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lang, i // 2),
s AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, i, n, h FROM s UNION ALL
  SELECT any_value(lvl) + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY i // 2),
v AS (SELECT l.doc_id, z.lvl AS k, l.i >> z.lvl AS j, t.h FROM l JOIN (SELECT DISTINCT lang, lvl FROM t WHERE n > 1) z ON z.lang IS NOT DISTINCT FROM l.lang
    LEFT JOIN t ON t.lang IS NOT DISTINCT FROM l.lang AND t.lvl = z.lvl AND t.i = xor(l.i >> z.lvl, 1)
  UNION ALL SELECT l.doc_id, 1000 + z.lvl, s.i >> z.lvl, u.h FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN (SELECT DISTINCT lvl FROM u WHERE n > 1) z
    LEFT JOIN u ON u.lvl = z.lvl AND u.i = xor(s.i >> z.lvl, 1)),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS step FROM v),
f AS (SELECT doc_id, 0::BIGINT AS step, claim AS h FROM l UNION ALL
  SELECT f.doc_id, f.step + 1, sha256(CASE WHEN w.h IS NULL THEN f.h WHEN w.j % 2 = 1 THEN w.h || f.h ELSE f.h || w.h END) FROM f JOIN w ON w.doc_id = f.doc_id AND w.step = f.step + 1)
SELECT l.doc_id, l.leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root,
  sha256(coalesce((SELECT string_agg(w.h, '' ORDER BY w.k) FROM w WHERE w.doc_id = l.doc_id), '')) AS proof_sha256, g.h AS folded_root, g.h = (SELECT h FROM u WHERE n = 1) AS verified
FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN (SELECT doc_id, arg_max(h, step) AS h FROM f GROUP BY doc_id) g ON g.doc_id = l.doc_id
"""


@query("op12_merkle_manifest", MERKLE_SQL)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    claimed = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return merkle.proofs(merkle.build(documents(spark, sf_dir), ["doc_id", "source", "lang", "n_chars", "text"], claimed=claimed))


NEGATIVES_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def mined_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", noisy), lambda i: i % 50 == 0)
