"""Full-text, vector, hybrid and rerank queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import retrieval as R
from loomgraph.operators.textindex import TextIndex
from loomgraph.plans.registry import query
from loomgraph.sources.shared import shared_path, written
from loomgraph.sources.tables import table

TERMS = ["the", "thing", "eau", "und"]
TOKENS = r"list_filter(string_split_regex(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def bm25_sql(source: str, key: str, x: str, terms: list[str]) -> str:
    return bm25_words_sql(source, key, TOKENS.format(x=x), terms)


def bm25_words_sql(source: str, key: str, words: str, terms: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda y: y = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    n = range(len(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in n)
    score = " + ".join(f"ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in n)
    return f"SELECT {key}, round({score}, 9) AS score FROM (SELECT {key}, len(w) AS n, {tf} FROM (SELECT {key}, {words} AS w FROM {source})), (SELECT count(*) AS docs, avg(n) AS mean, {df} FROM (SELECT len(w) AS n, {tf} FROM (SELECT {words} AS w FROM {source}))) WHERE {' OR '.join(f'tf{i} > 0' for i in n)}"


_built: dict[tuple, TextIndex] = {}


def index(s, d, name, key, fields):
    """The index of a table, built when it is first asked for and read by all queries after; another session or another version of its files has its own."""
    docs = table(s, d, name)
    path = s._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    stamp = path.getFileSystem(s._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
    mark = (s.sparkContext.applicationId, d, name, stamp, tuple(fields))
    if mark not in _built:
        own = TextIndex(s, shared_path(s, "index"), fields)
        own.append(docs, key, F.col(key) % 16)
        _built[mark] = own
    return _built[mark]


def lexical(s, d):
    return index(s, d, "documents", "doc_id", {"text": T.tokens(F.col("text"))}).bm25("text", TERMS).withColumnRenamed("key", "doc_id")


LEXICAL = bm25_sql("documents", "doc_id", "text", sorted(TERMS))


@query("f2_page_fts", f"{LEXICAL} ORDER BY score DESC, doc_id LIMIT 20")
def _(s, d):
    return lexical(s, d).orderBy(F.desc("score"), "doc_id").limit(20)


CODE = r"regexp_replace(regexp_replace(p_name || ' ' || p_brand, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{L})(\p{N})', '\1 \2', 'g')"


@query("f1_code_fts", f"SELECT p_partkey, max(score) AS score FROM ({bm25_sql('part', 'p_partkey', CODE, ['12', 'brand'])} UNION ALL {bm25_sql('part', 'p_partkey', 'p_type', ['12', 'brand', 'promo'])}) GROUP BY ALL")
def _(s, d):
    own = index(s, d, "part", "p_partkey", {"name": T.code_tokens(F.concat_ws(" ", "p_name", "p_brand")), "type": T.tokens(F.col("p_type"))})
    return R.best_field(own.bm25("name", ["brand", "12"]), own.bm25("type", ["brand", "12", "promo"]), key="key").withColumnRenamed("key", "p_partkey")


@query("f3_json_path_fts", "SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IN ('7', '11') THEN 'props' ELSE 'event_type' END AS path FROM events WHERE json_extract_string(props, '$.k') IN ('7', '11') OR event_type = 'purchase'")
def _(s, d):
    e = table(s, d, "events").select("event_id", F.array(F.struct(F.lit("props").alias("path"), F.get_json_object("props", "$.k").alias("text")), F.struct(F.lit("event_type").alias("path"), F.col("event_type").alias("text"))).alias("paths"))
    hits = e.withColumn("hits", F.filter("paths", lambda p: F.exists(T.tokens(p["text"]), lambda w: w.isin("7", "11", "purchase"))))
    return hits.where(F.size("hits") > 0).select("event_id", F.element_at("hits", 1)["path"].alias("path"))


ASKED = "und;eau thing;source"
_said = {"title": "CASE WHEN doc_id % 4 = 0 THEN lang END", "description": "CASE WHEN doc_id % 4 = 0 THEN text END", "check_text": "CASE WHEN doc_id % 4 = 0 THEN 'source ' || source END", "evidence": "CASE WHEN doc_id % 4 > 0 THEN 'source ' || lang END", "comment_body": "CASE WHEN doc_id % 4 > 0 THEN text END"}
_words = " || ".join(f"list_transform({TOKENS.format(x=x)}, lambda y: '{path},str,' || y)" for path, x in _said.items())


@query("f3_record_paths", f"""WITH s AS ({bm25_words_sql("documents", "doc_id", _words, R.path_terms(ASKED))}), b AS (SELECT doc_id // 4 AS record, doc_id % 4 AS place, score, row_number() OVER (PARTITION BY doc_id // 4 ORDER BY score DESC, doc_id % 4) AS k FROM s)
SELECT record, score, CASE WHEN place = 0 THEN 'specification' ELSE 'comment' END AS location, CASE WHEN place > 0 THEN place END AS sequence FROM b WHERE k = 1""")
def _(s, d):
    """Records of four documents, the first one their specification and the others comments, as JSON; their postings tell paths apart."""
    said = F.to_json(F.struct(*[F.expr(x).alias(path) for path, x in _said.items()]))
    own = index(s, d, "documents", "doc_id", {"public": R.path_words(said)})
    rows = own.bm25("public", R.path_terms(ASKED)).select(F.floor(F.col("key") / 4).alias("record"), (F.col("key") % 4).alias("place"), "score")
    return R.best_location(rows)


@query("f4_analyser", f"SELECT conv_id, turn, CAST(len({TOKENS.format(x='text')}) AS BIGINT) AS n FROM conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.size(T.tokens(F.col("text"))).cast("long").alias("n"))


@query("f5_public_projection", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '{"title":"' || o_orderpriority || '"}' WHEN o_orderstatus = 'O' THEN '{"comment":"' || o_orderpriority || '"}' ELSE '{}' END AS public_search FROM orders""")
def _(s, d):
    p = F.when(F.col("o_orderstatus") == "F", F.to_json(F.struct(F.col("o_orderpriority").alias("title")))).when(F.col("o_orderstatus") == "O", F.to_json(F.struct(F.col("o_orderpriority").alias("comment")))).otherwise("{}")
    return table(s, d, "orders").select("o_orderkey", p.alias("public_search"))


@query("f6_index_state", "SELECT * FROM (VALUES ('before', 'Missing'), ('built', 'Ready'), ('other analyser', 'Incompatible'), ('other fields', 'Incompatible')) v(moment, state)")
def _(s, d):
    root, fields = shared_path(s, "index"), {"text": T.tokens(F.col("text"))}
    own = TextIndex(s, root, fields)
    found = [("before", own.state())]
    own.append(table(s, d, "conversations"), "conv_id", F.col("conv_id") % 4)
    found += [("built", own.state()), ("other analyser", TextIndex(s, root, fields, "code").state()), ("other fields", TextIndex(s, root, fields | {"role": T.tokens(F.col("role"))}).state())]
    return s.createDataFrame(found, "moment string, state string")


@query("f7_incremental_segments", f"SELECT term, count(*) AS n_rows, CAST(sum(tf) AS BIGINT) AS n_times FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format(x='text')}) AS term FROM documents) GROUP BY ALL) GROUP BY ALL")
def _(s, d):
    docs = table(s, d, "documents")
    own = TextIndex(s, shared_path(s, "index"), {"text": T.tokens(F.col("text"))})
    fragment = F.col("doc_id") % 16
    own.append(docs.where(fragment < 5), "doc_id", fragment)
    own.append(docs.where(fragment < 9), "doc_id", fragment)  # four are new
    own.append(docs, "doc_id", fragment)
    own.append(docs, "doc_id", fragment)  # none is
    own.merge(2)
    return own.store.read().where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("tf").alias("n_times"))


Q = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]
QS = "CAST([" + ", ".join(map(str, Q)) + "] AS DOUBLE[])"
COS = f"round(1 - list_inner_product(CAST(embedding AS DOUBLE[]), {QS}) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_inner_product({QS}, {QS})), 6)"


@query("v1_cosine", f"SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN NULL ELSE {COS} END AS distance FROM embeddings")
def _(s, d):
    v = table(s, d, "embeddings").withColumn("v", F.when(F.col("vec_id") % 9 != 0, F.col("embedding")))
    return v.select("vec_id", F.round(R.cosine_distance(F.col("v"), Q), 6).alias("distance"))


for _name, _sql in (("cosine", COS), ("l2", f"round(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), {QS}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6)"), ("dot", f"round(1 - list_inner_product(CAST(embedding AS DOUBLE[]), {QS}), 6)")):

    @query(f"v2_knn_{_name}", f"SELECT vec_id, {_sql} AS distance FROM embeddings WHERE label <> 3 ORDER BY distance, vec_id LIMIT 15")
    def _(s, d, metric=_name):
        return R.knn(table(s, d, "embeddings").where("label <> 3"), "vec_id", "embedding", Q, 15, metric).select("vec_id", F.round("distance", 6).alias("distance"))


SEM = f"SELECT label, vec_id, {COS} AS distance, row_number() OVER (PARTITION BY label ORDER BY {COS}, vec_id) AS k FROM embeddings"


@query("v4_best_per_record", f"SELECT label, vec_id, distance, count(*) OVER () AS total FROM ({SEM}) WHERE k = 1 ORDER BY distance, vec_id LIMIT 5")
def _(s, d):
    v = table(s, d, "embeddings").select("label", "vec_id", F.round(R.cosine_distance(F.col("embedding"), Q), 6).alias("distance"))
    best = R.best_of_group(v, ["label"], [F.col("distance"), F.col("vec_id")])
    total = best.agg(F.count(F.lit(1)).alias("total"))
    return best.orderBy("distance", "vec_id").limit(5).crossJoin(total)


@query("v5_readiness", "SELECT label, CASE WHEN count(*) FILTER (vec_id % 7 = 0) = 0 THEN 'Published' WHEN count(*) FILTER (vec_id % 7 = 0) = count(*) THEN 'PublishedEmpty' ELSE 'Unavailable(MissingCoverage)' END AS state FROM embeddings GROUP BY ALL")
def _(s, d):
    lost = F.count_if(F.col("vec_id") % 7 == 0)
    return table(s, d, "embeddings").groupBy("label").agg(F.when(lost == 0, "Published").when(lost == F.count(F.lit(1)), "PublishedEmpty").otherwise("Unavailable(MissingCoverage)").alias("state"))


@query("v6_similarity", f"SELECT vec_id, round(1 - {COS}, 6) AS similarity FROM embeddings")
def _(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(1 - F.round(R.cosine_distance(F.col("embedding"), Q), 6), 6).alias("similarity"))


def fused_sql(where: str = "true") -> str:
    lex = f"SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({LEXICAL}) WHERE {where}"
    near = f"SELECT vec_id AS doc_id, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM (SELECT vec_id, vec_id AS doc_id, {COS} AS distance FROM embeddings) WHERE {where}"
    fused = f"SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM ({lex}) UNION ALL SELECT * FROM ({near})) GROUP BY ALL"
    return f"SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS total FROM ({fused})"


def semantic(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.round(R.distance(F.col("embedding"), Q, "cosine"), 6).alias("distance"))


def lists(s, d, where="true"):
    """The complete lists of the eligible rows by score and by distance."""
    return lexical(s, d).where(where), semantic(s, d).where(where)


@query("h1_hybrid_code", f"SELECT doc_id, score, place FROM ({fused_sql()}) WHERE place <= 20")
def _(s, d):
    return R.fused_page(*lists(s, d), "doc_id", written).select("doc_id", "score", F.col("place").cast("long"))


@query("h2_hybrid_pages", f"SELECT doc_id, score, place, total FROM ({fused_sql()}) WHERE place BETWEEN 11 AND 20")
def _(s, d):
    return R.fused_page(*lists(s, d), "doc_id", written, 10, 10).select("doc_id", "score", F.col("place").cast("long"), "total")


@query("h3_hybrid_memory", f"SELECT doc_id, score, place, total FROM ({fused_sql('doc_id % 4 <> 0')}) WHERE place <= 5")
def _(s, d):
    return R.fused_page(*lists(s, d, "doc_id % 4 <> 0"), "doc_id", written, 0, 5).select("doc_id", "score", F.col("place").cast("long"), "total")


@query("h4_semantic_task", f"SELECT vec_id AS doc_id, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM (SELECT vec_id, {COS} AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 20)")
def _(s, d):
    top = semantic(s, d).orderBy("distance", "doc_id").limit(20)
    return R.ranked(top, "doc_id", F.col("distance")).select("doc_id", F.col("rank").cast("long"))


@query("h5_degradation", f"SELECT doc_id, score, 'unavailable' AS vector_status FROM ({LEXICAL}) ORDER BY score DESC, doc_id LIMIT 20")
def _(s, d):
    usable = table(s, d, "embeddings").where("label = 99")
    if usable.isEmpty():
        return lexical(s, d).orderBy(F.desc("score"), "doc_id").limit(20).withColumn("vector_status", F.lit("unavailable"))
    return R.fused_page(*lists(s, d), "doc_id", written).select("doc_id", "score").withColumn("vector_status", F.lit("used"))


@query("r1_rerank", f"SELECT doc_id, score, n_chars AS rerank_score, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rerank_rank FROM (SELECT * FROM ({LEXICAL}) ORDER BY score DESC, doc_id LIMIT 20) JOIN documents USING (doc_id)")
def _(s, d):
    page = lexical(s, d).orderBy(F.desc("score"), "doc_id").limit(20).join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return R.rerank(page, "doc_id", F.col("n_chars")).select("doc_id", "score", "rerank_score", F.col("rerank_rank").cast("long"))


@query("r2_rerank_text", "SELECT d.doc_id, CASE WHEN l.toxic = 0 THEN text WHEN lang <> 'en' THEN lang || ': ' || text ELSE 'doc ' || source || ' in ' || lang END AS chosen FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(s, d):
    j = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    return j.select("doc_id", F.when(F.col("toxic") == 0, F.col("text")).when(F.col("lang") != "en", F.concat("lang", F.lit(": "), "text")).otherwise(F.concat(F.lit("doc "), "source", F.lit(" in "), "lang")).alias("chosen"))


FP = "sha256('recipe-1' || chr(10) || 'document' || chr(10) || lang || chr(10) || '64' || chr(10) || text)"


@query("r3_embedding_recipe", f"SELECT doc_id, {FP} AS fingerprint FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(F.concat_ws("\n", F.lit("recipe-1"), F.lit("document"), "lang", F.lit("64"), "text"), 256).alias("fingerprint"))


@query("r4_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0)")
def _(s, d):
    have = table(s, d, "embeddings").where("vec_id % 3 <> 0").select(F.col("vec_id").alias("doc_id"))
    return table(s, d, "documents").select("doc_id").join(have, "doc_id", "left_anti")
