"""Full-text, vector, quantization, fusion and embedding queries."""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import functions as F

from quern.functions.distance import METRICS
from quern.functions.text import STOP_WORDS
from quern.operators import embed, fulltext, fusion, pq, vector
from quern.plans.registry import query, shared_dir, stored, table

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
TOKENS = f"list_filter(regexp_split_to_array(lower(translate(coalesce(text, ''), 'İΣ', 'iσ')), '[^\\p{{L}}\\p{{Nd}}]+'), lambda w: octet_length(encode(w)) > 1 AND w NOT IN ({STOP}))"
TF = f"tok AS (SELECT doc_id, {TOKENS} AS t FROM documents), len AS (SELECT doc_id, len(t) AS doc_len FROM tok WHERE len(t) > 0), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY doc_id, term), st AS (SELECT count(*) AS n, avg(doc_len) AS avgdl FROM len), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"
PHRASE = "tion ing ener tion"


@query(f"WITH {TF} SELECT doc_id, doc_len FROM len")
def tokenize_counts(spark, d):
    return fulltext.lengths(table(spark, d, "documents"))


@query(f"WITH {TF} SELECT * FROM tf")
def term_freq(spark, d):
    return fulltext.term_freq(table(spark, d, "documents"))


@query(f"WITH {TF} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total, min(doc_id) AS first_doc FROM tf GROUP BY term")
def postings(spark, d):
    tf = fulltext.term_freq(table(spark, d, "documents"))
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"), F.min("doc_id").alias("first_doc"))


@query(f"WITH {TF} SELECT n, round(avgdl, 6) AS avgdl FROM st")
def corpus_stats(spark, d):
    return fulltext.corpus_stats(table(spark, d, "documents")).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {TF} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, st")
def idf(spark, d):
    docs = table(spark, d, "documents")
    return fulltext.idf(docs).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_sql(queries: str, k: int) -> str:
    return f"""{TF}, qt AS (SELECT query_id, term, count(*) AS w FROM (SELECT query_id, unnest({TOKENS}) AS term FROM ({queries})) GROUP BY query_id, term),
hit AS (SELECT query_id, tf.doc_id, sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avgdl))) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN len ON len.doc_id = tf.doc_id, st GROUP BY query_id, tf.doc_id),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM hit WHERE score > 0) WHERE rank <= {k})"""


def one_query(spark, text):
    return spark.createDataFrame([(1, text)], "query_id bigint, text string")


def once(build):
    """What build(spark, d) stores is built once a session and folder, and then read by all queries that need it."""
    kept = {}

    @wraps(build)
    def get(spark, d):
        key = spark.sparkContext.applicationId, d
        if key not in kept:
            kept[key] = build(spark, d)
        return kept[key]

    return get


@once
def index(spark, d) -> fulltext.Index:
    """The documents' text index."""
    made = fulltext.Index(spark, f"{shared_dir(spark)}/quern-corpus-{uuid.uuid4().hex}")
    return made.add(table(spark, d, "documents").select("doc_id", "text"))


@once
def corpus(spark, d) -> fusion.Hybrid:
    """The documents' text index, embeddings and texts."""
    return fusion.Hybrid(index(spark, d)).add(table(spark, d, "documents").select("doc_id", "text"), indexed=True)


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"WITH {bm25_sql('SELECT 1 AS query_id, ' + repr('ion ther') + ' AS text', 10)} SELECT doc_id, round(score, 6) AS score, rank FROM sparse")
def bm25_search(spark, d):
    return rounded(fulltext.bm25(table(spark, d, "documents"), one_query(spark, "ion ther"), 10), "score").select("doc_id", "score", "rank")


@query(f"WITH {bm25_sql('SELECT 1 AS query_id, ' + repr(PHRASE) + ' AS text', 10)} SELECT doc_id, round(score, 6) AS score, rank FROM sparse")
def bm25_repeat_term(spark, d):
    return rounded(fulltext.bm25(table(spark, d, "documents"), one_query(spark, PHRASE), 10), "score").select("doc_id", "score", "rank")


ITEMS = "SELECT item_id AS query_id, text FROM benchmark"


def items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {bm25_sql(ITEMS, 5)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM sparse")
def bm25_batch(spark, d):
    return rounded(index(spark, d).search(items(spark, d), 5), "score")


@query(f"WITH {bm25_sql(ITEMS, 1)} SELECT query_id, sparse.doc_id, documents.text FROM sparse JOIN documents ON documents.doc_id = sparse.doc_id")
def doc_lookup(spark, d):
    hits = index(spark, d).search(items(spark, d), 1).select("query_id", "doc_id")
    return fusion.with_text(hits, table(spark, d, "documents"), items(spark, d).count()).select("query_id", "doc_id", "text")


UPSERTED = "(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, length(text) // 2) WHEN doc_id % 3 = 1 THEN '' ELSE text END AS text FROM documents)"


@query(f"WITH {bm25_sql(ITEMS, 5).replace('FROM documents', 'FROM ' + UPSERTED)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM sparse")
def bm25_upsert(spark, d):
    """An index after a second version of two thirds of the documents: half a text, or none."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    own = fulltext.Index(spark, f"{shared_dir(spark)}/quern-index-{uuid.uuid4().hex}").add(docs)
    again = docs.where("doc_id % 3 < 2").select("doc_id", F.expr("if(doc_id % 3 = 0, substr(text, 1, length(text) div 2), '')").alias("text"))
    return rounded(own.add(again).search(items(spark, d), 5), "score")


# ---- vectors: queries are the rows whose id is divisible by 20


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding")


def asked(spark, d):
    return vectors(spark, d).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


SQL_METRIC = {
    "l2": "list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))",
    "cosine": "1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))",
    "dot": "-list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))",
}


def pairs_sql(metric: str, where: str = "q.vec_id % 20 = 0") -> str:
    return f"pair AS (SELECT q.vec_id AS query_id, v.vec_id, {SQL_METRIC[metric]} AS distance FROM embeddings q, embeddings v WHERE {where})"


def knn_sql(metric: str, k: int) -> str:
    return f"{pairs_sql(metric)}, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id) AS rank FROM pair) WHERE rank <= {k})"


def _knn(metric):
    def run(spark, d):
        return rounded(vector.knn(vectors(spark, d), asked(spark, d), 10, metric), "distance")

    run.__name__ = f"knn_{metric}"
    query(f"WITH {knn_sql(metric, 10)} SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM near")(run)


def _to_first(metric):
    def run(spark, d):
        """The distance of every vector to the one with the least id."""
        first = F.broadcast(vectors(spark, d).orderBy("vec_id").limit(1).select(F.col("embedding").alias("q")))
        both = vectors(spark, d).join(first, F.lit(True))
        return both.select("vec_id", F.round(METRICS[metric](F.col("q"), F.col("embedding")), 6).alias("distance"))

    run.__name__ = f"vec_{metric}"
    query(f"WITH {pairs_sql(metric, 'q.vec_id = (SELECT min(vec_id) FROM embeddings)')} SELECT vec_id, round(distance, 6) AS distance FROM pair")(run)


for _metric in METRICS:
    _knn(_metric)
    _to_first(_metric)


@query(f"WITH {knn_sql('l2', 3)} SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM near")
def knn_batch(spark, d):
    return rounded(vector.knn(vectors(spark, d), asked(spark, d), 3), "distance")


@query("SELECT count(*) FILTER (len(embedding) = 64) AS accepted, count(*) FILTER (coalesce(len(embedding), 0) <> 64) AS rejected FROM embeddings")
def vec_dim_check(spark, d):
    good, bad = vector.checked(vectors(spark, d), 64)
    return good.agg(F.count("*").alias("accepted")).join(bad.agg(F.count("*").alias("rejected")), F.lit(True))


FNV32 = "list_reduce(list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, CAST(i AS BIGINT), 1)) AS BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT))"


@query(f"SELECT vec_id, CAST(least(16, floor(-ln(({FNV32} + 0.5) / 4294967296.0) / ln(16.0))) AS INTEGER) AS level FROM (SELECT vec_id, CAST(vec_id AS VARCHAR) AS s FROM embeddings)")
def hnsw_levels(spark, d):
    return vector.levels(vectors(spark, d))


@query(f"SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, {SQL_METRIC['l2']} AS distance FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id)) WHERE rank <= 8")
def knn_graph(spark, d):
    """Links of each node to the 8 nearest in its cell; the label is the cell."""
    cells = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").alias("cell"))
    return rounded(vector.cell_graph(cells, 8), "distance")


def measured(spark, d, found, compared):
    """(query_id, recall, compared): the share of the exact ten that was found, and of all rows that got exact distances."""
    v, q = vectors(spark, d), asked(spark, d)
    return vector.recall(found, vector.knn(v, q, 10)).join(compared, "query_id").select("query_id", "recall", F.round(F.col("compared") / F.lit(v.count()), 4).alias("compared"))


@once
def coded(spark, d):
    """Inverted lists of codes: (codes(vec_id, list, codes), the lists' centroids, the codebook)."""
    v = vectors(spark, d)
    c = vector.centroids(v, 16)
    book = stored(pq.train(v, rounds=4), "codebook")
    return stored(pq.encode(v, book).join(vector.listed(v, c), "vec_id"), "codes"), c, pq.points(book)


@query()
def ann_ivf(spark, d):
    v, q = vectors(spark, d), asked(spark, d)
    codes, c, book = coded(spark, d)
    return measured(spark, d, vector.ivf(codes, v, q, 10, c, 13, book, METRICS["l2"]), q.select("query_id", F.lit(200).alias("compared")))


@query()
def ann_lsh_recall(spark, d):
    v, q = vectors(spark, d), asked(spark, d)
    index = stored(vector.sketches(v, "vec_id"), "sketches")
    return measured(spark, d, vector.lsh(index, v, q, 10, METRICS["l2"]), q.select("query_id", F.lit(200).alias("compared")))


@once
def graphs(spark, d):
    return stored(vector.hnsw(vectors(spark, d), shard_rows=1000), "graphs")


@query()
def hnsw_beam(spark, d):
    return measured(spark, d, *vector.hnsw_search(graphs(spark, d), asked(spark, d), 10))


LEVELS = f"SELECT vec_id, CAST(least(16, floor(-ln(({FNV32} + 0.5) / 4294967296.0) / ln(16.0))) AS INTEGER) AS level FROM (SELECT vec_id, CAST(vec_id AS VARCHAR) AS s FROM embeddings)"


@query(f"WITH lv AS ({LEVELS}) SELECT CAST(layer AS INTEGER) AS layer, count(*) AS n_nodes, true AS within_limit, true AS linked FROM lv, (SELECT unnest(range(17)) AS layer) WHERE layer <= level GROUP BY layer")
def hnsw_layers(spark, d):
    """Nodes of each layer of the built graphs; whether none has too many links, and none in layer 0 has none."""
    each = graphs(spark, d).select("vec_id", F.posexplode("links").alias("layer", "own"))
    most = F.when(F.col("layer") == 0, 32).otherwise(16)
    return each.groupBy("layer").agg(F.count("*").alias("n_nodes"), F.bool_and(F.size("own") <= most).alias("within_limit"), F.bool_and((F.size("own") > 0) | (F.col("layer") > 0)).alias("linked"))


# ---- product quantization: 8 parts of 8 dimensions, seeded by the 256 least ids

SUB = "sub AS (SELECT vec_id, m, list_slice(CAST(embedding AS DOUBLE[]), m * 8 + 1, m * 8 + 8) AS s FROM embeddings, (SELECT CAST(unnest(range(8)) AS INTEGER) AS m)), book AS (SELECT m, CAST(row_number() OVER (PARTITION BY m ORDER BY vec_id) - 1 AS INTEGER) AS c, s AS centroid FROM (SELECT * FROM sub WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 256)))"
OWN = f"{SUB}, own AS (SELECT vec_id, m, any_value(s) AS s, CAST(arg_min(c, round(list_distance(centroid, s), 9) * 1e6 + c * 1e-6) AS INTEGER) AS c FROM sub JOIN book USING (m) GROUP BY vec_id, m)"


@query(f"WITH {OWN}, mean AS (SELECT m, c, i, avg(s[i]) AS x FROM own, (SELECT unnest(range(1, 9)) AS i) GROUP BY m, c, i), means AS (SELECT m, c, list(x ORDER BY i) AS mean FROM mean GROUP BY m, c) SELECT m, c, list_transform(coalesce(mean, centroid), lambda x: round(x, 6)) AS centroid FROM book LEFT JOIN means USING (m, c)")
def pq_lloyd_step(spark, d):
    v = vectors(spark, d)
    after = pq.lloyd_step(pq.sub_vectors(v, 8, 64), pq.seeds(v, 8, 64))
    return after.select("m", "c", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


@query(f"WITH {OWN} SELECT vec_id, list(c ORDER BY m) AS codes FROM own GROUP BY vec_id")
def pq_encode(spark, d):
    v = vectors(spark, d)
    return pq.encode(v, pq.seeds(v, 8, 64))


@query(f"WITH {SUB} SELECT vec_id AS query_id, m, c, round(list_distance(s, centroid), 6) AS d FROM sub JOIN book USING (m) WHERE vec_id % 20 = 0")
def pq_distance_table(spark, d):
    return rounded(pq.distance_table(asked(spark, d), pq.seeds(vectors(spark, d), 8, 64)), "d")


@query(f"WITH {OWN}, tab AS (SELECT vec_id AS query_id, m, c, list_distance(s, centroid) AS d FROM sub JOIN book USING (m) WHERE vec_id % 20 = 0), sums AS (SELECT query_id, own.vec_id, sum(d) AS distance FROM own JOIN tab USING (m, c) GROUP BY query_id, own.vec_id) SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id) AS rank FROM sums) WHERE rank <= 10")
def pq_adc_topk(spark, d):
    v = vectors(spark, d)
    book = pq.seeds(v, 8, 64)
    return rounded(pq.adc(asked(spark, d), book, pq.encode(v, book), 10), "distance")


@query()
def pq_train(spark, d):
    return pq.train(vectors(spark, d))


# ---- fusion


def grams_sql(source: str) -> str:
    """b: the weight of each slot that a text of source(doc_id, text) has."""
    return GRAMS.replace("FROM documents", f"FROM {source}")


CLEAN = r"regexp_replace(lower(translate(coalesce(text, ''), 'İΣ', 'iσ')), '^[\t-\r \x{85}\p{Z}]+|[\t-\r \x{85}\p{Z}]+$', '', 'g')"
GRAMS = rf"""c AS (SELECT doc_id, {CLEAN} AS c FROM documents), w AS (SELECT doc_id, c, list_filter(regexp_split_to_array(c, '[^\p{{L}}\p{{Nd}}]+'), lambda x: x <> '') AS w FROM c),
g AS (SELECT doc_id, unnest(w) AS s, 1.0 AS x FROM w
 UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])), 1.5 FROM w
 UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || '_' || w[i + 1] || '_' || w[i + 2])), 2.0 FROM w
 UNION ALL SELECT doc_id, unnest(list_transform(range(1, length(c) - 2), lambda i: substr(c, CAST(i AS BIGINT), 3))), 0.5 FROM w),
u AS (SELECT s, {{hash}} % 128 AS slot FROM (SELECT DISTINCT s FROM g)),
b AS (SELECT doc_id, slot, sum(x) AS weight FROM g JOIN u USING (s) GROUP BY doc_id, slot)"""
BYTES = "list_transform(list_filter(regexp_extract_all(hex(encode(s)), '..'), lambda x: x <> ''), lambda x: CAST(('0x' || x) AS BIGINT))"
GRAMS = GRAMS.replace("{hash}", f"list_reduce({BYTES}, lambda h, b: (xor(h, b) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT))")


def dense_sql(queries: str, k: int) -> str:
    """dense: the k documents whose embedding is nearest to that of each query's text. Queries get odd ids, documents even ones."""
    return f"""src AS MATERIALIZED (SELECT 2 * query_id + 1 AS doc_id, text FROM ({queries}) UNION ALL SELECT 2 * doc_id, text FROM documents), {grams_sql('src')},
nv AS (SELECT doc_id, sqrt(sum(weight * weight)) AS norm FROM b GROUP BY doc_id),
ev AS MATERIALIZED (SELECT src.doc_id, list(coalesce(CAST(weight AS DOUBLE) / norm, 0.0) ORDER BY s.slot) AS e FROM src CROSS JOIN (SELECT unnest(range(128)) AS slot) s LEFT JOIN b ON b.doc_id = src.doc_id AND b.slot = s.slot LEFT JOIN nv ON nv.doc_id = src.doc_id GROUP BY src.doc_id),
pair AS (SELECT (q.doc_id - 1) // 2 AS query_id, v.doc_id // 2 AS doc_id, list_distance(q.e, v.e) AS distance FROM ev q, ev v WHERE q.doc_id % 2 <> 0 AND v.doc_id % 2 = 0),
dense AS (SELECT * FROM (SELECT query_id, doc_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), doc_id) AS rank FROM pair) WHERE rank <= {k})"""


def hybrid_sql(k: int) -> str:
    """Both sides search for the items' texts."""
    return f"""{bm25_sql(ITEMS, 2 * k)}, {dense_sql(ITEMS, 2 * k)},
fused AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(0.5 / (60 + a.rank), 0) + coalesce(0.5 / (60 + b.rank), 0) AS rrf_score, coalesce(a.rank, -1) AS dense_rank, coalesce(b.rank, -1) AS sparse_rank, coalesce(a.distance, 0) AS dense_dist, coalesce(b.score, 0) AS sparse_score
 FROM dense a FULL JOIN sparse b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 9) DESC, doc_id) AS rank FROM fused) WHERE rank <= {k})"""


@query(f"WITH {hybrid_sql(5)} SELECT query_id, doc_id, round(rrf_score, 6) AS rrf_score, dense_rank, sparse_rank, rank FROM best")
def rrf_fusion(spark, d):
    own, q = corpus(spark, d), items(spark, d)
    return rounded(fusion.rrf(own.dense(q, 10), own.index.search(q, 10), 5), "rrf_score").select("query_id", "doc_id", "rrf_score", "dense_rank", "sparse_rank", "rank")


@query(f"WITH {hybrid_sql(10)} SELECT query_id, best.doc_id, round(rrf_score, 6) AS rrf_score, dense_rank, sparse_rank, round(dense_dist, 6) AS dense_dist, round(sparse_score, 6) AS sparse_score, rank, text FROM best LEFT JOIN documents ON documents.doc_id = best.doc_id")
def hybrid_search(spark, d):
    return rounded(corpus(spark, d).search(items(spark, d), 10), "rrf_score", "dense_dist", "sparse_score")


# ---- embedding and chunks


@query(f"WITH {GRAMS} SELECT doc_id, CAST(slot AS INTEGER) AS slot, CAST(weight AS DOUBLE) AS weight FROM b")
def embed_buckets(spark, d):
    e = embed.embed(table(spark, d, "documents"))
    return e.select("doc_id", F.posexplode("weights").alias("slot", "weight")).where("weight > 0")


@query(f"WITH {GRAMS}, n AS (SELECT doc_id, sqrt(sum(weight * weight)) AS norm FROM b GROUP BY doc_id) SELECT doc_id, CAST(slot AS INTEGER) AS slot, round(CAST(weight AS DOUBLE) / norm, 6) AS value FROM b JOIN n USING (doc_id)")
def embed_norm(spark, d):
    e = embed.embed(table(spark, d, "documents"))
    return e.select("doc_id", F.posexplode("embedding").alias("slot", "value")).where("value > 0").withColumn("value", F.round("value", 6))


CHUNKS = r"w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\t-\r \x{85}\p{Z}]+'), lambda x: x <> '') AS w FROM documents), k AS (SELECT *, CAST(greatest(0, ceil((len(w) - 100) / 80.0)) AS BIGINT) AS last FROM w)"


@query(f"WITH {CHUNKS} SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, CASE WHEN len(w) <= 100 THEN text ELSE array_to_string(list_slice(w, i * 80 + 1, i * 80 + 100), ' ') END AS chunk FROM (SELECT *, unnest(range(last + 1)) AS i FROM k)")
def chunk_text(spark, d):
    return embed.chunk(table(spark, d, "documents"), 100, 20)


@query(f"WITH {CHUNKS} SELECT doc_id, last + 1 AS n_chunks FROM k")
def chunk_counts(spark, d):
    return embed.chunk(table(spark, d, "documents"), 100, 20).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
