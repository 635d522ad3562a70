"""Vectors: index, search, joins, groups, drift."""

from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..operators import answers as an, similarity as sm
from ..plans.quantised import Quantised, nearest_quantised
from ..plans.search import nearest, recall, side
from ..plans.tree import Tree
from ..session import new_path, stage
from . import query
from .views import (
    LOG, NORMAL, PAIRS, SCORES, THRESHOLD, VECTORS, access_log, embeddings, index_rows, documents, pairs, questions,
    turns, us,
)

T = THRESHOLD


@query("cosine_pairs", f"""WITH {PAIRS}
SELECT pair_id, greatest(0, least(1, round(list_cosine_similarity(e1, e2), 6))) AS sim FROM pairs""")
def cosine_pairs(spark, sf):
    v = embeddings(spark, sf).select("vec_id", "embedding")
    p = (
        pairs(spark, sf)
        .join(v.select(F.col("vec_id").alias("q1"), F.col("embedding").alias("a")), "q1")
        .join(v.select(F.col("vec_id").alias("q2"), F.col("embedding").alias("b")), "q2")
    )
    return sm.cosine_pairs(p, "a", "b").select("pair_id", F.round("sim", 6).alias("sim"))


# Components go through FLOAT as stored vectors do.
_SUMS = "round(list_sum(list_transform({0}, lambda v, i: v::FLOAT::DOUBLE * i)), 4)"


@query("unit_normalize", f"""WITH t AS (SELECT vec_id, list_transform(embedding, lambda v: (v * (1 + vec_id % 5)::FLOAT)::DOUBLE) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS len FROM t)
SELECT vec_id, round(list_inner_product(u, u), 4) AS squared, {_SUMS.format('u')} AS weighted
FROM (SELECT vec_id, list_transform(e, lambda v: v / len) AS u FROM n)""")
def unit_normalize(spark, sf):
    scaled = F.transform("embedding", lambda x: x * (1 + F.col("vec_id") % 5).cast("float"))
    u = embeddings(spark, sf).select("vec_id", vx.unit(scaled).alias("u"))
    return u.select("vec_id", F.round(vx.dot(F.col("u"), F.col("u")), 4).alias("squared"), _weighted("u"))


def _weighted(c):
    w = F.transform(F.col(c), lambda x, i: x.cast("double") * (i + 1))
    return F.round(F.aggregate(w, F.lit(0.0), lambda a, x: a + x), 4).alias("weighted")


@query("fit_dimension", f"""WITH f AS (
  SELECT vec_id, list_transform(range(1, d + 1), lambda i: coalesce(embedding[i]::DOUBLE, 0)) AS e, d
  FROM (SELECT vec_id, embedding, CASE WHEN vec_id % 2 = 0 THEN 48 ELSE 80 END AS d FROM embeddings)),
n AS (SELECT vec_id, d, e, sqrt(list_inner_product(e, e)) AS len FROM f)
SELECT vec_id, d::INT AS dims, {_SUMS.format('list_transform(e, lambda v: v / len)')} AS weighted FROM n""")
def fit_dimension(spark, sf):
    v = embeddings(spark, sf)
    short = v.filter("vec_id % 2 = 0").select("vec_id", vx.fit_unit(F.col("embedding"), 48).alias("u"))
    long = v.filter("vec_id % 2 <> 0").select("vec_id", vx.fit_unit(F.col("embedding"), 80).alias("u"))
    return short.union(long).select("vec_id", F.size("u").alias("dims"), _weighted("u"))


_H = NORMAL.format("query")


@query("index_build", f"""WITH {VECTORS}, w AS (SELECT vec_id, level, 'Question number ' || vec_id % 300 || '?' AS query, ts, e FROM x),
h AS (SELECT vec_id, level, {_H} AS normalized_query, md5({_H}) AS query_hash, ts, e FROM w)
SELECT vec_id, level, normalized_query, query_hash, epoch_us(ts) AS ts,
  {_SUMS.format('list_transform(e, lambda v: v / sqrt(list_inner_product(e, e)))')} AS weighted
FROM h QUALIFY row_number() OVER (PARTITION BY level, query_hash ORDER BY ts DESC, vec_id DESC) = 1""")
def index_build(spark, sf):
    text = F.concat(F.lit("Question number "), (F.col("vec_id") % 300).cast("string"), F.lit("?"))
    index = sm.build_index(index_rows(spark, sf).withColumn("query", text), dedup=True)
    return index.select("vec_id", "level", "normalized_query", "query_hash", *us("ts"), _weighted("embedding"))


@query("index_remove", f"""WITH {VECTORS}, h AS (SELECT vec_id, level, md5({_H}) AS query_hash FROM x)
SELECT vec_id, level, query_hash FROM h WHERE NOT (vec_id % 3 = 0 AND level <> 'context')""")
def index_remove(spark, sf):
    index = sm.build_index(index_rows(spark, sf))
    gone = index.filter("vec_id % 3 = 0").filter("level <> 'context'").select("query_hash", "level")
    return sm.remove_from_index(index, gone).select("vec_id", "level", "query_hash")


@query("index_counts", f"""WITH {VECTORS}, l AS (SELECT unnest(['query', 'embedding', 'context', 'result']) AS level)
SELECT l.level, count(vec_id) AS n FROM l LEFT JOIN x ON x.level = l.level AND l.level <> 'embedding' GROUP BY 1""")
def index_counts(spark, sf):
    return sm.index_counts(sm.clear_index(index_rows(spark, sf), "embedding"))


_TOP = """SELECT qid, vec_id, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id)::INT AS rank
FROM scores QUALIFY rank <= 10"""


@query("topk_similarity", f"WITH {SCORES} {_TOP}")
def topk_similarity(spark, sf):
    return nearest(questions(spark, sf), index_rows(spark, sf), 10)


@query("topk_similarity_cells", f"WITH {SCORES} {_TOP}")
def topk_similarity_cells(spark, sf):
    """The plan for many queries: pruned cells, bounded blocks."""
    return nearest(questions(spark, sf), index_rows(spark, sf), 10, plan="cells")


@query("topk_approximate")
def topk_approximate(spark, sf):
    """Neighbours from compressed vectors, their recall against the exact plan, and the share of bytes they took, per query."""
    placed = Quantised.build(side(index_rows(spark, sf), "vec_id", "embedding", "vec_id"), new_path(spark, "codes"))
    found = stage(nearest_quantised(questions(spark, sf), placed, 10), "approximate")
    rates = recall(found, nearest(questions(spark, sf), index_rows(spark, sf), 10))
    return found.join(rates, "qid")


@query("topk_similarity_saved", f"WITH {SCORES} {_TOP}")
def topk_similarity_saved(spark, sf):
    """Against an index placed and written once, read back for the search."""
    index = side(index_rows(spark, sf), "vec_id", "embedding", "vec_id")
    saved = Tree.build(index, new_path(spark, "index"))
    return nearest(questions(spark, sf), saved, 10)


@query("index_changes", f"""WITH {SCORES}, alive AS (SELECT * FROM scores WHERE vec_id % 5 <> 0 OR vec_id % 10 = 0)
{_TOP.replace('scores', 'alive')}""")
def index_changes(spark, sf):
    """A saved index that rows are added to and removed from, and some of those brought back, then searched."""
    index = side(index_rows(spark, sf), "vec_id", "embedding", "vec_id")
    ids = index.select("vec_id")
    saved = Tree.build(index.filter("vec_id % 3 <> 0"), new_path(spark, "index"))
    saved = saved.append(index.filter("vec_id % 3 = 0")).remove(ids.filter("vec_id % 5 = 0")).append(index.filter("vec_id % 10 = 0"))
    return nearest(questions(spark, sf), saved, 10)


# Index vectors as stored: scaled to length one, then FLOAT.
_UNIT = "list_transform({0}, lambda v: (v / sqrt(list_inner_product({0}, {0})))::FLOAT)::DOUBLE[]"
_STORED = SCORES.replace("round(list_cosine_similarity(q.e, x.e), 6)", f"round(list_cosine_similarity(q.e, {_UNIT.format('x.e')}), 6)")


@query("similar_queries", f"""WITH {_STORED}, top AS ({_TOP.replace('FROM scores', "FROM scores WHERE level = 'result'")})
SELECT qid, vec_id, md5('question number ' || vec_id) AS query_hash, sim, rank FROM top WHERE sim >= 0.2""")
def similar_queries(spark, sf):
    index = sm.build_index(index_rows(spark, sf))
    found = sm.similar_queries(questions(spark, sf), index, 0.2, "result")
    return found.select("qid", "vec_id", "query_hash", "sim", "rank")


@query("best_match", f"""WITH {SCORES} SELECT qid, vec_id, sim FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rn FROM scores) WHERE rn = 1 AND sim >= {T}""")
def best_match(spark, sf):
    return sm.best_match(questions(spark, sf), index_rows(spark, sf), T)


@query("similarity_report", f"""WITH {_STORED}, top AS ({_TOP}), m AS (SELECT * FROM top WHERE sim >= {T})
SELECT q.qid, 'new question ' || q.qid AS normalized_query, md5('new question ' || q.qid) AS query_hash,
  count(m.vec_id) AS similar_queries_found, max(sim) AS best_sim,
  'question number ' || arg_min(m.vec_id, rank) AS best_query,
  coalesce(string_agg(m.vec_id::VARCHAR, ',' ORDER BY rank) FILTER (rank <= 5), '') AS matches
FROM q LEFT JOIN m USING (qid) GROUP BY q.qid""")
def similarity_report(spark, sf):
    index = sm.build_index(index_rows(spark, sf))
    report = sm.similarity_report(questions(spark, sf), index, T)
    ids = F.transform(F.coalesce("matches", F.array()), lambda m: m["vec_id"].cast("string"))
    names = index.select(F.col("query_hash").alias("best_hash"), F.col("normalized_query").alias("best_query"))
    return report.join(names, "best_hash", "left").select(
        "qid", "normalized_query", "query_hash", "similar_queries_found", "best_sim", "best_query",
        F.array_join(ids, ",").alias("matches"),
    )


@query("similarity_stats", f"""WITH {SCORES}, top AS ({_TOP}), m AS (SELECT qid, avg(sim) AS a FROM top WHERE sim >= {T} GROUP BY qid)
SELECT count(*) AS similarity_searches, count(a) AS similarity_hits,
  round((SELECT arg_max(a, qid) FROM m), 3) AS average_similarity, round(100.0::DOUBLE * count(a) / count(*), 2) AS hit_rate
FROM q LEFT JOIN m USING (qid)""")
def similarity_stats(spark, sf):
    return sm.similarity_stats(questions(spark, sf), index_rows(spark, sf), T)


@query("semantic_join", f"""WITH {SCORES}, top AS ({_TOP}) SELECT qid, vec_id, sim FROM top WHERE sim >= 0.3""")
def semantic_join(spark, sf):
    return sm.semantic_join(questions(spark, sf), index_rows(spark, sf), 0.3, plan="cells").select("qid", "vec_id", "sim")


@query("semantic_join_all", f"""WITH {SCORES} SELECT qid, vec_id, sim FROM scores WHERE sim >= 0.3""")
def semantic_join_all(spark, sf):
    """Without the rank cut of ``semantic_join``."""
    return sm.semantic_join_all(questions(spark, sf), index_rows(spark, sf), 0.3)


@query("semantic_join_classes", f"""WITH {SCORES}, cq AS (SELECT e, min(qid) AS qid, count(*) AS queries FROM q GROUP BY e),
cx AS (SELECT e, min(vec_id) AS vec_id, count(*) AS vectors FROM x GROUP BY e)
SELECT qid, vec_id, sim, queries, vectors FROM scores JOIN cq USING (qid) JOIN cx USING (vec_id) WHERE sim >= 0.3""")
def semantic_join_classes(spark, sf):
    """Pairs of classes of equal vectors, with their sizes, instead of all pairs of copies."""
    return sm.semantic_join_classes(questions(spark, sf), index_rows(spark, sf), 0.3)


_GROUPS = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
e AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM v a, v b
  WHERE a.vec_id <> b.vec_id AND round(list_cosine_similarity(a.e, b.e), 6) >= {t}),
reach(id, root) AS (SELECT DISTINCT src, src FROM e UNION SELECT e.dst, r.root FROM reach r JOIN e ON e.src = r.id),
groups AS (SELECT id, min(root) AS group_id FROM reach GROUP BY id)"""


@query("semantic_duplicates", _GROUPS.format(t=0.42) + " SELECT id, group_id FROM groups")
def semantic_duplicates(spark, sf):
    return sm.semantic_duplicates(embeddings(spark, sf), 0.42)


@query("semantic_clusters", _GROUPS.format(t=0.42) + f""", {LOG},
acc AS (SELECT key::BIGINT AS id, count(*) AS n FROM log GROUP BY 1)
SELECT group_id, count(*) AS members, coalesce(sum(n), 0)::BIGINT AS accesses, count(*) FILTER (id % 3 = 0) AS missing
FROM groups LEFT JOIN acc USING (id) GROUP BY group_id""")
def semantic_clusters(spark, sf):
    accesses = access_log(spark, sf).groupBy(F.col("key").cast("bigint").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    v = embeddings(spark, sf)
    live = v.filter("vec_id % 3 <> 0").select(F.col("vec_id").alias("id"))
    return sm.semantic_clusters(v, 0.42, accesses, live)


_DRIFT = """drift AS (SELECT query_hash, n, round(1 - list_cosine_similarity(f, l), 6) AS drift FROM (
  SELECT label::VARCHAR AS query_hash, count(*) AS n, arg_min(embedding::DOUBLE[], vec_id) AS f, arg_max(embedding::DOUBLE[], vec_id) AS l
  FROM (SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) <= 10)
  GROUP BY label) WHERE n >= 2)"""


def history(spark, sf):
    return embeddings(spark, sf).select(
        F.col("label").cast("string").alias("query_hash"), F.col("vec_id").alias("ts"), "embedding"
    )


@query("semantic_drift", f"WITH {_DRIFT} SELECT query_hash, n, drift FROM drift WHERE drift > 0.9")
def semantic_drift(spark, sf):
    return sm.drift(history(spark, sf), 0.9)


def _sql_unit_embedding(text: str, dims: int) -> str:
    """The hash features as stored."""
    return f"(SELECT {_UNIT.format('w.e')} FROM (SELECT {_sql_embedding(text, dims)} AS e) w)"


def _sql_embedding(text: str, dims: int) -> str:
    """The hash features in SQL, before scaling to length one."""
    n = NORMAL.format(text)
    byte = "((('0x' || substr({h}, {at}, 2))::INT - 128) / 128.0::DOUBLE)"
    md5 = byte.format(h="md5(n)", at="2 * i + 1")
    sha = byte.format(h="sha256(n)", at="2 * i + 1")
    rest = byte.format(h="md5(n || '#' || (i // 16))", at="2 * (i % 16) + 1")
    blanks = f"trim(regexp_replace({text}, '[\\s\\x1c-\\x1f\\x85\\p{{Z}}]+', ' ', 'g'))"
    return f"""(SELECT list_concat(list_transform(range(0, 16), lambda i: {md5}),
      list_transform(range(0, 16), lambda i: 0.0::DOUBLE), list_transform(range(0, 32), lambda i: {sha}),
      [length(raw) / 1000.0::DOUBLE, words / 100.0::DOUBLE, ('0x' || substr(md5(n), 1, 8))::BIGINT % 1000 / 1000.0::DOUBLE,
       coalesce(list_sum(list_transform(string_split(substr(n, 1, 10), ''), lambda c: ord(c))), 0) / 10000.0::DOUBLE],
      list_transform(range(0, {dims - 68}), lambda i: {rest}))
      FROM (SELECT {text} AS raw, {n} AS n,
        CASE WHEN {blanks} = '' THEN 0 ELSE len(string_split({blanks}, ' ')) END AS words))"""


@query("embed_hashing", f"""WITH u AS (SELECT conv_id * 4194304 + turn AS qid, text AS query FROM conversations),
v AS (SELECT qid, {_sql_embedding('query', 768)} AS e FROM u)
SELECT qid, len(e)::INT AS dims, {_SUMS.format('list_transform(e, lambda v: v / sqrt(list_inner_product(e, e)))')} AS weighted FROM v""")
def embed_hashing(spark, sf):
    v = turns(spark, sf).select("qid", an.hashing_embedder()(F.col("query")).alias("e"))
    return v.select("qid", F.size("e").alias("dims"), _weighted("e"))


@query("embedding_reuse", f"""WITH u AS (SELECT doc_id, lang, {NORMAL.format('text')} AS n FROM documents),
known AS (SELECT DISTINCT md5(n) AS h FROM u WHERE lang = 'en')
SELECT doc_id, md5(n) AS query_hash, md5(n) IN (SELECT h FROM known) AS reused, 64 AS dims FROM u""")
def embedding_reuse(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.col("text").alias("query"), "lang")
    embed = an.hashing_embedder(64)
    none = spark.createDataFrame([], "query_hash string, embedding array<float>")
    english = sm.reuse_embeddings(docs.filter("lang = 'en'"), none, embed, id_col="doc_id")
    # What an earlier run would have left behind: a vector per hash.
    known = stage(english.select("query_hash", "embedding").dropDuplicates(["query_hash"]), "known")
    out = sm.reuse_embeddings(docs, known, embed, id_col="doc_id")
    return out.select("doc_id", "query_hash", "reused", F.size("embedding").alias("dims"))
