"""Chunking, collection upkeep and nearest-neighbour queries."""

from pyspark.sql import functions as F

from ..operators import retrieval as R
from .tables import rounded, table

QUERIES, ORACLE = {}, {}


def query(key, sql=None):
    def add(fn):
        QUERIES[key] = fn
        if sql:
            ORACLE[key] = sql
        return fn
    return add


def docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang", "source")


@query("RAG-01", """WITH s AS (SELECT doc_id AS id, text, unnest(range(1, greatest(length(text) - 200, 1) + 1, 800)) AS pos FROM documents WHERE length(text) > 0)
  SELECT id, CAST((pos - 1) // 800 AS INTEGER) AS chunk_index, md5(substr(text, pos, 1000)) AS digest, CAST(length(substr(text, pos, 1000)) AS INTEGER) AS chunk_size FROM s""")
def _(spark, sf):
    out = R.chunk_documents(docs(spark, sf), by_separator=False)
    return out.select("id", "chunk_index", F.md5(F.col("content").cast("binary")).alias("digest"), "chunk_size")


@query("RAG-01-separators")
def _(spark, sf):
    return R.chunk_documents(docs(spark, sf), metadata={"kind": "document"}).select("id", "chunk_index", F.md5(F.col("content").cast("binary")).alias("digest"), "chunk_size")


@query("RAG-01-whole", r"""SELECT doc_id AS id, md5(regexp_replace(text, '\s+', '', 'g')) AS digest, true AS inside, true AS short FROM documents WHERE regexp_matches(text, '\S')""")
def _(spark, sf):
    # without overlap the chunks are the text, but for white space at their ends
    chunks = R.chunk_documents(docs(spark, sf), overlap=0).join(docs(spark, sf).select("id", F.col("content").alias("text")), "id")
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))  # the chunks of one text
    whole = F.regexp_replace(F.array_join(F.transform(ordered, lambda c: c["content"]), ""), r"\s+", "")
    return chunks.groupBy("id").agg(F.md5(whole.cast("binary")).alias("digest"), F.bool_and(F.col("text").contains(F.col("content"))).alias("inside"), F.bool_and(F.col("chunk_size") <= 1000).alias("short"))


# The collection: the labelled documents. Offered: all documents, cut to a few characters where the source ends in 5.
_OFFER = "o AS (SELECT doc_id AS id, CASE WHEN source LIKE '%5' THEN substr(text, 1, 6) ELSE text END AS content, lang, source FROM documents)"
_COLL = "c AS (SELECT doc_id AS id, text AS content, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"


def _grown(spark, sf):
    d = docs(spark, sf)
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    offered = d.withColumn("content", F.when(F.col("source").endswith("5"), F.substring("content", 1, 6)).otherwise(F.col("content")))
    return R.add_documents(d.join(labelled, "id", "left_semi"), offered)


@query("RAG-02", f"""WITH {_COLL}, {_OFFER}, a AS (SELECT * FROM c UNION ALL SELECT * FROM o WHERE length(trim(content, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) >= 10 AND id NOT IN (SELECT id FROM c)) SELECT id, lang, md5(content) AS digest FROM a""")
def _(spark, sf):
    return _grown(spark, sf).select("id", "lang", F.md5(F.col("content").cast("binary")).alias("digest"))


@query("RAG-02-totals", f"""WITH {_COLL}, {_OFFER}, a AS (SELECT * FROM c UNION ALL SELECT * FROM o WHERE length(trim(content, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) >= 10 AND id NOT IN (SELECT id FROM c))
  SELECT COUNT(*) AS documents, CAST(SUM(length(content)) AS BIGINT) AS characters, array_to_string(list_sort(list(DISTINCT lang)), ',') AS types FROM a""")
def _(spark, sf):
    return R.collection_totals(_grown(spark, sf), F.col("lang"))


# --- vectors: 64 places, a word's place taken from its digest so that SQL can follow -------------------------------------

DIMS = 64


def place(word):
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, 4), 16, 10).cast("long") % DIMS


def tfidf_sql(rel, key, text):
    return f"""w AS (SELECT {key} AS k, unnest(list_filter(string_split_regex(lower({text}), '\\s+'), lambda x: x <> '')) AS word FROM {rel}),
     tf AS (SELECT k, CAST(('0x' || substr(md5(word), 1, 4)) AS BIGINT) % {DIMS} AS p, COUNT(*) AS tf FROM w GROUP BY 1, 2),
     idf AS (SELECT p, ln(((SELECT COUNT(*) FROM {rel}) + 1) / (COUNT(*) + 1)) AS idf FROM tf GROUP BY p),
     wt AS (SELECT k, tf.p, tf * idf AS v FROM tf JOIN idf USING (p)), nn AS (SELECT k, sqrt(SUM(v * v)) AS n FROM wt GROUP BY k),
     vec AS (SELECT k, p, CASE WHEN n > 0 THEN v / n ELSE 0 END AS v FROM wt JOIN nn USING (k))"""


@query("RAG-03", f"WITH {tfidf_sql('documents', 'doc_id', 'text')} SELECT doc_id AS id, COUNT(*) FILTER (v <> 0) AS filled, round(COALESCE(MAX(v), 0), 6) AS largest, round(COALESCE(SUM(v * (p + 1)), 0), 4) AS moment FROM documents LEFT JOIN vec ON k = doc_id GROUP BY doc_id")
def _(spark, sf):
    v = R.text_vectors(docs(spark, sf), "content", DIMS, bucket=place).select("id", "embedding")
    weighted = F.zip_with("embedding", F.sequence(F.lit(1), F.lit(DIMS)), lambda a, i: a * i)
    return v.select("id", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("filled"), F.round(F.array_max("embedding"), 6).alias("largest"),
                    F.round(F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x), 4).alias("moment"))


@query("RAG-03-values", f"WITH {tfidf_sql('documents', 'doc_id', 'text')} SELECT k AS id, CAST(p AS INTEGER) AS place, round(v, 6) AS weight FROM vec WHERE round(v, 6) <> 0")
def _(spark, sf):
    v = R.text_vectors(docs(spark, sf), "content", DIMS, bucket=place).select("id", F.posexplode("embedding").alias("place", "weight"))
    return v.select("id", "place", F.round("weight", 6).alias("weight")).where("weight <> 0")


@query("RAG-03-hashing", "SELECT doc_id AS id, CASE WHEN regexp_matches(text, '\\S') THEN 1.0 ELSE 0.0 END::DOUBLE AS squared_norm FROM documents")
def _(spark, sf):
    v = R.text_vectors(docs(spark, sf), "content", 256).select("id", "embedding")
    return v.select("id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared_norm"))


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def centroids(spark, sf):
    """One query vector per label: the mean of its vectors."""
    flat = vectors(spark, sf).select("label", F.posexplode("embedding").alias("i", "x"))
    means = flat.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x"))
    # 64 entries per label
    packed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    return packed.select(F.col("label").alias("query_id"), F.transform("s", lambda e: e["x"]).alias("query_vector"))


_CENT = """v AS (SELECT vec_id AS id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings),
  ct AS (SELECT label AS query_id, i, round(AVG(x), 9) AS x FROM v GROUP BY 1, 2)"""


def _knn(metric, k, where="TRUE", q="ct"):
    d = "SUM((v.x - q.x) ** 2)" if metric == "l2sq" else "1 - SUM(v.x * q.x) / (sqrt(SUM(v.x * v.x)) * sqrt(SUM(q.x * q.x)))"
    return f"""ds AS (SELECT q.query_id, v.id, any_value(v.label) AS label, {d} AS distance FROM v JOIN {q} q USING (i) WHERE {where} GROUP BY 1, 2),
      rk AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY round(distance, 12), id) AS INTEGER) AS rank FROM ds), top AS (SELECT *, 1 - distance AS score FROM rk WHERE rank <= {k})"""


_OUT = "SELECT query_id, rank, id, label, round(distance, 6) AS distance, round(score, 6) AS score FROM top"


@query("RAG-04", f"WITH {_CENT}, {_knn('l2sq', 5)} {_OUT}")
def _(spark, sf):
    return rounded(R.nearest(vectors(spark, sf), centroids(spark, sf), 5, keep=["label"]))


@query("RAG-04-filtered", f"WITH {_CENT}, {_knn('cosine', 4, 'v.label IN (1, 3, 5)')} {_OUT}")
def _(spark, sf):
    return rounded(R.nearest(vectors(spark, sf).filter(F.col("label").isin(1, 3, 5)), centroids(spark, sf), 4, metric="cosine", keep=["label"]))


@query("RAG-05", f"WITH {_CENT}, {_knn('cosine', 10)} SELECT query_id, rank, id, round(distance, 6) AS distance, round(score, 6) AS score FROM top WHERE score >= 0.25 AND rank <= 5")
def _(spark, sf):
    return rounded(R.semantic_search(vectors(spark, sf), centroids(spark, sf), 5, 0.25, metric="cosine"))


_MEDOID = f"{_CENT}, {_knn('l2sq', 1)}, md AS (SELECT DISTINCT id FROM top), qv AS (SELECT v.id AS query_id, v.i, v.x FROM v JOIN md USING (id))"


@query("RAG-06", f"""WITH {_MEDOID}, d2 AS (SELECT q.query_id, v.id, SUM((v.x - q.x) ** 2) AS distance FROM v JOIN qv q USING (i) WHERE v.id <> q.query_id GROUP BY 1, 2),
  r2 AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY round(distance, 12), id) AS INTEGER) AS rank FROM d2)
  SELECT query_id, rank, id, round(distance, 6) AS distance, round(1 - distance, 6) AS score FROM r2 WHERE rank <= 5""")
def _(spark, sf):
    # the most central document of every label
    central = R.nearest(vectors(spark, sf), centroids(spark, sf), 1).select("id")
    return rounded(R.similar_documents(vectors(spark, sf), central, 5))


@query("RAG-07", f"WITH {_CENT}, {_knn('cosine', 3)} SELECT query_id, rank, id, round(distance, 6) AS distance, round(score, 6) AS score FROM top WHERE score > 0.3")
def _(spark, sf):
    return rounded(R.cosine_search(vectors(spark, sf), centroids(spark, sf), 3, 0.3))


_ASK = ["license agreement", "the with", "zzz und der"]


def _keyword_sql():
    parts = []
    for q in _ASK:
        cond = " OR ".join(f"contains(lower(text), '{w}')" for w in q.split())
        parts.append(f"SELECT '{q}' AS query, doc_id AS id FROM documents WHERE {cond}")
    return f"WITH h AS ({' UNION ALL '.join(parts)}), r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query ORDER BY id) AS INTEGER) AS rank FROM h) SELECT * FROM r WHERE rank <= 3"


@query("RAG-08", _keyword_sql())
def _(spark, sf):
    return R.keyword_search(docs(spark, sf), _ASK)


@query("RAG-09", """SELECT doc_id AS id, CASE WHEN lang = 'fr' THEN substr(text, 1, 40) || '!' ELSE md5(text) END AS content, CASE WHEN lang = 'fr' AND source LIKE 'src1%' THEN 'edited' ELSE source END AS source FROM documents""")
def _(spark, sf):
    base = docs(spark, sf).select("id", F.md5(F.col("content").cast("binary")).alias("content"), "source")
    text = docs(spark, sf)
    changed = text.filter("lang = 'fr'").select("id", F.concat(F.substring("content", 1, 40), F.lit("!")).alias("content"), F.when(F.col("source").startswith("src1"), F.lit("edited")).alias("source"))
    unknown = changed.withColumn("id", -1 - F.col("id"))
    return R.update_documents(base, changed.unionByName(unknown), metadata="source")


@query("RAG-10", "SELECT doc_id AS id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(spark, sf):
    toxic = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return R.delete_documents(docs(spark, sf).select("id", "lang"), toxic)


@query("RAG-10-clear", "SELECT COUNT(*) AS before, CAST(0 AS BIGINT) AS after FROM documents")
def _(spark, sf):
    held = docs(spark, sf).select("id", "lang")
    counts = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))  # noqa: E731  one row each
    return counts(held, "before").join(counts(R.clear(held), "after"), F.lit(True))


@query("RAG-11", "SELECT COUNT(*) AS documents, MAX(doc_id) AS last_updated, array_to_string(list_sort(list(DISTINCT lang)), ',') AS types FROM documents")
def _(spark, sf):
    return R.collection_info(docs(spark, sf), F.col("lang"), F.col("id"))


@query("RAG-11-types", "SELECT source AS type, COUNT(*) AS documents, MAX(doc_id) AS last_updated FROM documents GROUP BY source")
def _(spark, sf):
    return R.collection_types(docs(spark, sf), F.col("source"), F.col("id"))


@query("RAG-13", "SELECT event_type, COUNT(*) AS queries, round(SUM(value), 4) AS total_seconds, round(AVG(value), 6) AS mean_seconds FROM events GROUP BY event_type")
def _(spark, sf):
    out = R.query_statistics(table(spark, sf, "events"), "value", ["event_type"])
    return out.select("event_type", "queries", F.round("total_seconds", 4).alias("total_seconds"), F.round("mean_seconds", 6).alias("mean_seconds"))


@query("RAG-13-last", "SELECT event_id, user_id, value FROM events ORDER BY ts DESC, event_id LIMIT 10")
def _(spark, sf):
    return R.last_queries(table(spark, sf, "events"), "ts").select("event_id", "user_id", "value")


@query("RAG-14", f"""WITH {_CENT}, {_knn('l2sq', 3)}, t AS (SELECT query_id, rank, 'vector ' || id || ' of label ' || label AS content FROM top)
  SELECT query_id, string_agg(content, chr(10) ORDER BY rank) AS context FROM t GROUP BY query_id""")
def _(spark, sf):
    hits = R.nearest(vectors(spark, sf), centroids(spark, sf), 5, keep=["label"])
    return R.context_strings(hits.withColumn("content", F.format_string("vector %d of label %d", "id", "label")), 3)


@query("RAG-14-rows", "SELECT doc_id AS position, 'Document ' || doc_id || ': ' || COALESCE(lang, 'N/A') AS line FROM documents")
def _(spark, sf):
    return R.fact_rows(docs(spark, sf).select(F.col("id").alias("position"), F.concat(F.lit("Document "), F.col("id")).alias("label"), F.col("lang").alias("value")))


@query("RAG-14-facts", """SELECT 'Total Records: ' || COUNT(*) || chr(10) || 'Languages: ' || COUNT(DISTINCT lang) || chr(10) || 'Oldest: N/A' AS context FROM documents""")
def _(spark, sf):
    row = docs(spark, sf).agg(F.count(F.lit(1)).cast("string").alias("a"), F.count_distinct("lang").cast("string").alias("b"))
    facts = row.select(F.inline(F.array(
        F.struct(F.lit("Total Records").alias("label"), F.col("a").alias("value"), F.lit(1).alias("position")),
        F.struct(F.lit("Languages").alias("label"), F.col("b").alias("value"), F.lit(2).alias("position")),
        F.struct(F.lit("Oldest").alias("label"), F.lit(None).cast("string").alias("value"), F.lit(3).alias("position")))))
    return R.fact_lines(facts)
