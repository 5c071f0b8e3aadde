"""Conversation queries. The given texts are invented words, so topics and entities are also taken from frequent words."""

from pyspark.sql import functions as F

from .. import presets
from ..operators import conversation as V, retrieval as R
from .documents import DIMS, place, tfidf_sql
from .tables import rounded, table

QUERIES, ORACLE = {}, {}


def query(key, sql=None):
    def add(fn):
        QUERIES[key] = fn
        if sql:
            ORACLE[key] = sql
        return fn
    return add


def talk(spark, sf):
    return table(spark, sf, "conversations")


def _any(terms, t="lower(text)"):
    return "(" + " OR ".join("contains({}, '{}')".format(t, w.replace("'", "''")) for w in terms) + ")"


def _case(rules, default):
    return "CASE " + " ".join(f"WHEN {_any(w)} THEN '{n}'" for n, w in rules.items()) + (f" ELSE '{default}' END" if default else " END")


@query("CNV-01", f"SELECT conv_id, turn, {_case(presets.INTENTS, presets.DEFAULT_INTENT)} AS intent FROM conversations")
def _(spark, sf):
    return talk(spark, sf).select("conv_id", "turn", V.intent(F.col("text")).alias("intent"))


# Frequent invented words in place of the default lists.
WORDS = {"first": ["the", "der"], "second": ["les", "tion"], "third": ["ung", "with"], "fourth": ["que"]}


@query("CNV-01-words", f"SELECT conv_id, turn, {_case(WORDS, 'other')} AS intent FROM conversations")
def _(spark, sf):
    return talk(spark, sf).select("conv_id", "turn", V.intent(F.col("text"), WORDS, "other").alias("intent"))


def _list(groups):
    cells = ", ".join(f"CASE WHEN {_any(w)} THEN '{n}' END" for n, w in groups.items())
    return f"array_to_string(list_filter([{cells}], lambda x: x IS NOT NULL), ',')"


_ENT = {"departments": presets.DEPARTMENTS, "metrics": presets.METRICS, **{n: {t: [t] for t in ts} for n, ts in (
    ("time_periods", presets.TIME_TERMS), ("comparison_terms", presets.COMPARISON_TERMS), ("actions", presets.ACTION_TERMS), ("qualifiers", presets.QUALIFIER_TERMS))}}


@query("CNV-02", "SELECT conv_id, turn, " + ", ".join(f"{_list(g)} AS {n}" for n, g in _ENT.items()) + """,
  array_to_string(list_transform(regexp_extract_all(text || ' ' || conv_id || '/' || turn, '\\d+'), lambda x: CAST(TRY_CAST(x AS BIGINT) AS VARCHAR)), ',') AS numbers FROM conversations""")
def _(spark, sf):
    # conversation and turn are appended, since the texts hold no digits
    df = talk(spark, sf).withColumn("text", F.concat("text", F.lit(" "), "conv_id", F.lit("/"), "turn"))
    e = df.select("conv_id", "turn", V.entities(F.col("text")).alias("e"))
    return e.select("conv_id", "turn", *[F.array_join(f"e.{n}", ",").alias(n) for n in _ENT], F.array_join(F.transform("e.numbers", lambda x: x.cast("string")), ",").alias("numbers"))


TOPIC_WORDS = {"the": "articles", "les": "plurals", "und": "joins", "que": "asks"}


def _carry(expr, name):
    return f"""WITH m AS (SELECT conv_id, turn, {expr} AS x FROM conversations)
      SELECT conv_id, turn, last_value(x IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {name} FROM m"""


_TOPIC = "CASE WHEN role = 'user' THEN " + _case({n: [w] for w, n in TOPIC_WORDS.items()}, None) + " END"


@query("CNV-03", _carry(_TOPIC, "topic_before"))
def _(spark, sf):
    return V.topic_context(talk(spark, sf), topics=TOPIC_WORDS, speaker=F.col("role") == "user").select("conv_id", "turn", "topic_before")


@query("CNV-03-chunks", _carry(_TOPIC, "topic_before"))
def _(spark, sf):
    return V.topic_context(talk(spark, sf), topics=TOPIC_WORDS, speaker=F.col("role") == "user", chunks=4).select("conv_id", "turn", "topic_before")


_GROUPS = {"articles": ["the ", "der "], "endings": ["tion", "ung"]}
_GAUGES = {"asks": ["que"], "ties": ["und "]}


@query("CNV-04", _carry(f"CASE WHEN {_list(_GROUPS)} <> '' OR {_list(_GAUGES)} <> '' THEN {_list(_GROUPS)} || '/' || {_list(_GAUGES)} END", "entities_before"))
def _(spark, sf):
    out = V.entity_context(talk(spark, sf), departments=_GROUPS, metrics=_GAUGES)
    e = F.col("entities_before")
    text = F.concat(F.array_join(e["departments"], ","), F.lit("/"), F.array_join(e["metrics"], ","))
    return out.select("conv_id", "turn", F.when(e.isNotNull(), text).alias("entities_before"))


_LAST = """WITH e AS (SELECT u.conv_id, u.turn, u.text AS ut, a.text AS reply FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
  r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS recency FROM e)
  SELECT conv_id, turn, recency, md5(ut) AS asked, md5(reply) AS answered FROM r WHERE recency <= %d"""


def _last(spark, sf, *n):
    out = V.last_exchanges(V.exchanges(talk(spark, sf)), *n)
    md5 = lambda c: F.md5(F.col(c).cast("binary"))
    return out.select("conv_id", "turn", "recency", md5("user_text").alias("asked"), md5("assistant_text").alias("answered"))


@query("CNV-05", _LAST % 2)
def _(spark, sf):
    return _last(spark, sf, 2)


@query("CNV-05-default", _LAST % 10)
def _(spark, sf):
    return _last(spark, sf)


@query("CNV-06", "SELECT conv_id, COUNT(*) AS messages, COUNT(*) FILTER (role = 'user') AS user_messages, COUNT(*) FILTER (role = 'assistant') AS assistant_messages FROM conversations GROUP BY conv_id")
def _(spark, sf):
    return V.message_counts(talk(spark, sf))


@query("CNV-07", "SELECT conv_id, MIN(turn) AS first_turn, MAX(turn) AS last_turn FROM conversations GROUP BY conv_id")
def _(spark, sf):
    return V.sessions(talk(spark, sf))


@query("CNV-07-history", "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = (SELECT MAX(conv_id) FROM conversations) ORDER BY turn")
def _(spark, sf):
    latest = talk(spark, sf).agg(F.max("conv_id")).first()[0]
    return V.session_history(talk(spark, sf), latest).select("conv_id", "turn", "role", "text")


_CONCISE = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
  c AS (SELECT *, regexp_matches(line, '\\S') AS filled, SUM(CASE WHEN regexp_matches(line, '\\S') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS n FROM l)
  SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM c WHERE NOT filled OR n <= %d GROUP BY doc_id"""


@query("CNV-08", _CONCISE % 5)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(V.concise(F.col("text"), 5).cast("binary")).alias("digest"))


@query("CNV-08-default", _CONCISE % 15)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(V.concise(F.col("text")).cast("binary")).alias("digest"))


@query("RAG-12", f"""WITH h AS (SELECT MIN(conv_id * 100 + turn) AS id, text FROM conversations WHERE role = 'user' GROUP BY text), h0 AS (SELECT conv_id * 100 + turn AS id, conv_id, turn, text FROM conversations WHERE role = 'user'),
  {tfidf_sql('h0', 'id', 'text')}, q AS (SELECT id AS query_id, text FROM h0),
  qn AS (SELECT q.query_id, q.text AS qt, p, v FROM q JOIN vec ON vec.k = q.query_id), dot AS (SELECT query_id, any_value(qt) AS qt, vec.k AS id, SUM(qn.v * vec.v) AS dot FROM qn JOIN vec USING (p) GROUP BY 1, 3),
  allp AS (SELECT q.query_id, q.text AS qt, h.id, h.text, COALESCE(dot, 0) AS sim FROM q CROSS JOIN h LEFT JOIN dot ON dot.query_id = q.query_id AND dot.id = h.id WHERE h.text <> q.text),
  r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY round(1 - sim, 12), id) AS INTEGER) AS rank FROM allp)
  SELECT query_id, rank, id, md5(text) AS digest, round(sim, 6) AS similarity FROM r WHERE rank <= 3""")
def _(spark, sf):
    asked = talk(spark, sf).filter("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "conv_id", "turn", "text")
    history = R.text_vectors(asked, "text", DIMS, bucket=place)
    # every question against all others
    questions = history.select(F.col("id").alias("query_id"), "text", F.col("embedding").alias("query_vector"))
    out = R.similar_questions(history.select("id", "text", "embedding"), questions, 3)
    return rounded(out.select("query_id", "rank", "id", F.md5(F.col("text").cast("binary")).alias("digest"), "similarity"))
