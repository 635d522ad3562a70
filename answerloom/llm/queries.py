"""The operators over the given tables, with their SQL where it can be said."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import conversations, cosine, covertree, decontaminate, forest, imatch, langid, licenses, lines, mixing, sharding, suffixes, warc
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


@query("op1_hilbert_shards")
def op1(spark, sf):
    placed = sharding.hilbert_shards(read(spark, sf, "documents"), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve")


@query("op10_mixture_tree", r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS w,
    2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS owed FROM s),
r AS (SELECT *, owed - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_owed,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM w
    WINDOW o AS (ORDER BY cap / w, encode(source) NULLS LAST)),
l AS (SELECT arg_min(left_owed / left_w, cap / w) FILTER (cap / w >= left_owed / left_w) AS level FROM r),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR cap / w < level THEN cap ELSE w * level END AS target FROM r, l),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size
    ROWS UNBOUNDED PRECEDING) - d.size AS a FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (greatest(0, least(a + size, floor(target)) - a)
  + greatest(0, least(source_size + a + size, floor(target)) - source_size - a))::BIGINT AS taken FROM o""")
def op10(spark, sf):
    mixed = mixing.mix(read(spark, sf, "documents"))
    return mixing.taken(mixed).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_line_dedup", r"""
WITH l AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE len(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, first IS NULL OR first = k.doc_id AS stays FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(NOT stays)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256 FROM m GROUP BY doc_id""")
def op3(spark, sf):
    cut = lines.dedup_lines(read(spark, sf, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op4_language_id")
def op4(spark, sf):
    docs = read(spark, sf, "documents")
    learned = langid.train(docs.filter(~langid.held_out()))
    return langid.classify(docs, learned).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query("op5_warc_index", r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)""")
def op5(spark, sf):
    back = warc.round_trip(spark, read(spark, sf, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op2_decontaminate", rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE len({_WORDS}) > 0),
x AS (SELECT item_id, unnest([w[i:i + 9] FOR i IN range(1, greatest(1, len(w) - 9) + 1)]) AS v FROM b),
n AS (SELECT DISTINCT len(v) AS n FROM x),
p AS (SELECT doc_id, n, i, w[i:i + n - 1] AS v FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n)),
h AS (SELECT doc_id, n, i, item_id FROM p JOIN x USING (v)),
c AS (SELECT doc_id, count(DISTINCT pos)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id""")
def op2(spark, sf):
    return decontaminate.hits(read(spark, sf, "documents"), read(spark, sf, "benchmark")).drop("items")


@query("op8_license_scan")
def op8(spark, sf):
    return licenses.scan(read(spark, sf, "documents"))[0]


@query("op9_lsh_forest")
def op9(spark, sf):
    return forest.near_duplicates(read(spark, sf, "documents"), k=2)


@query("op7_suffix_family")
def op7(spark, sf):
    cut = suffixes.drop_repeats(read(spark, sf, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, s: t + s["end"] - s["start"])
    return cut.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_imatch")
def op6(spark, sf):
    return imatch.fingerprints(read(spark, sf, "documents"))


# Numbers of states: 0 nothing yet, 1 system, 2 user, 3 assistant. e: what is inserted; o: initial of the row's role afterwards.
_MOVES = """(VALUES (0, 2, '', '', 'u'), (0, 3, 'I', 'U', 'a'), (0, 2, 'II', 'UA', 'u'), (0, 1, '', '', 's'),
  (1, 2, '', '', 'u'), (1, 3, 'I', 'U', 'a'), (1, 2, 'II', 'UA', 'u'),
  (2, 3, '', '', 'a'), (2, 2, 'I', 'A', 'u'), (2, 3, 'II', 'AU', 'a'),
  (3, 2, '', '', 'u'), (3, 3, 'I', 'U', 'a'), (3, 2, 'II', 'UA', 'u')) m(was, now, ins, e, o)"""
_EMPTY_ROWS = "replace(replace({0}, 'U', chr(10) || 'user:'), 'A', chr(10) || 'assistant:')"
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("op11_conversation_repair", rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
    lambda c: ord(c)::UBIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
      lambda x, y: xor(x // 2, 3988292384::UBIGINT * (x % 2)))), 4294967295::UBIGINT) % 20 AS fate FROM conversations),
c AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM k, (VALUES (1), (2)) t(copy) WHERE fate <> 0 AND (copy = 1 OR fate = 3)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS i, nth > 1 AS again,
  rtrim(text, {_SPACES}) AS body, substr(role, 1, 1) AS ini FROM r),
f AS (SELECT *, body = '' AS blank, body <> '' AND again AS dup, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS cut,
  lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini NOT IN ('su', 'ua', 'au') AS off FROM n),
l AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
  count_if(dup) AS duplicate, count_if(cut) AS truncated, count_if(coalesce(off, false)) AS illegal FROM f GROUP BY conv_id),
m AS (SELECT * FROM {_MOVES}),
s AS (SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, '' AS body FROM l
  UNION ALL SELECT * FROM (SELECT s.conv_id, s.i + 1 AS i, x.now AS state, s.cost + x.cost AS cost, s.audit || x.audit AS audit, s.body || x.body AS body
    FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1,
    LATERAL (SELECT s.state AS now, 3 AS cost, 'D' AS audit, '' AS body
      UNION ALL SELECT m.now, 2 * len(m.ins) + 2 + f.cut::INT, m.ins || 'R', {_EMPTY_ROWS.format("m.e")} || chr(10) || CASE m.o WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text
        FROM m WHERE m.was = s.state AND m.o <> 's' AND NOT f.blank AND NOT f.dup
      UNION ALL SELECT m.now, 2 * len(m.ins) + f.cut::INT, m.ins || 'K', {_EMPTY_ROWS.format("m.e")} || chr(10) || f.role || ':' || f.text
        FROM m WHERE m.was = s.state AND m.o = f.ini AND NOT f.blank AND NOT f.dup) x
    QUALIFY row_number() OVER (PARTITION BY s.conv_id, x.now ORDER BY s.cost + x.cost, s.audit || x.audit) = 1)),
z AS (SELECT s.conv_id, s.cost + 2 * len(t.ins) AS cost, s.audit || t.ins AS audit, s.body || {_EMPTY_ROWS.format("t.e")} AS body
  FROM s JOIN l ON l.conv_id IS NOT DISTINCT FROM s.conv_id AND l.n = s.i
  JOIN (VALUES (0, '', ''), (1, 'II', 'UA'), (2, 'I', 'A'), (3, '', '')) t(state, ins, e) ON t.state = s.state
  QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY s.cost + 2 * len(t.ins), s.audit || t.ins) = 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(substr(body, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM o.conv_id""")
def op11(spark, sf):
    return conversations.report(conversations.damage(read(spark, sf, "conversations")))


@query("op12_embedding_near_copies", """
WITH RECURSIVE f AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
v AS (SELECT vec_id, e FROM f WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e)
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT a AS id, a AS root FROM p UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.id),
g AS (SELECT id, min(root) AS root FROM r GROUP BY id), n AS (SELECT a AS id, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM f LEFT JOIN g ON g.id = vec_id LEFT JOIN n ON n.id = vec_id""")
def op12(spark, sf):
    return cosine.near_copies(read(spark, sf, "embeddings"))


@query("op13_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5""")
def op13(spark, sf):
    rows = read(spark, sf, "embeddings")
    wide = F.transform("embedding", lambda x: x.cast("double") * 256)
    # From 2**52 on, a double is a whole number already; what is not finite stays as it is.
    whole = F.transform(wide, lambda y: F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    given = rows.select("vec_id", whole.alias("vec"), label.alias("label"))
    return covertree.mine(given, F.col("vec_id") % 100 == 0)
