"""Chunks, vectors, collection upkeep, conversations, sources and sinks."""

import json
import os

import pyarrow as pa
import pytest
from conftest import column
from pyspark.sql import functions as F, types as T

from tabulon import presets
from tabulon.operators import conversation as V, retrieval as R
from tabulon.session import scratch
from tabulon.sources import readers, writers
from tabulon.streaming import rowwise


LETTERS = "".join(chr(97 + (i * i * 7919 + i * 31) % 9973 % 26) for i in range(6000))  # never repeats, so that a chunk has one place
WORDS = [f"w{i:05d}" for i in range(900)]


@pytest.mark.parametrize("text", ["", "123456789", "1234567890", LETTERS[:2500], " ".join(WORDS), "\n\n".join(" ".join(WORDS[i:i + 90]) for i in range(0, 900, 90)),
                                  " ".join(WORDS[:130]) + "\n" + LETTERS[:1400] + "  " + "  ".join(WORDS[130:200])])
def test_chunks_cover_the_text(text):
    chunks = R.split_text(text, 1000, 200)
    assert all(0 < len(c) <= 1000 for c in chunks)
    pos = 0
    for c in chunks:  # in order, and nothing but white space is left out between them
        at = text.find(c, max(0, pos - 250))
        assert at >= 0 and not text[pos:at].strip()
        pos = max(pos, at + len(c))
    assert not text[pos:].strip()


def test_chunks_overlap_and_prefer_paragraphs():
    text = "a" * 600 + "\n\n" + "b" * 600
    assert R.split_text(text) == ["a" * 600, "b" * 600]
    words = " ".join(f"w{i:04d}" for i in range(400))
    first, second = R.split_text(words)[:2]
    assert second.split()[0] in first.split() and len(set(first.split()) & set(second.split())) == 33
    assert R.split_text("y" * 2500)[1] == "y" * 1000


def test_chunk_table(spark):
    df = spark.createDataFrame([(1, "z" * 1500), (2, ""), (3, None)], "id int, content string")
    rows = R.chunk_documents(df, metadata={"kind": "t"}).orderBy("chunk_index").collect()
    assert [(r["chunk_id"], r["chunk_size"]) for r in rows] == [("chunk_1_0", 1000), ("chunk_1_1", 700)] and rows[0]["metadata"] == {"kind": "t"}
    fixed = R.chunk_documents(df, by_separator=False).collect()
    assert [r["chunk_size"] for r in fixed] == [1000, 700]


def test_collection_upkeep(spark):
    base = spark.createDataFrame([("a", "some long text", "m1"), ("b", "another long text", "m2")], "id string, content string, source string")
    new = spark.createDataFrame([("b", "duplicate of an id", "x"), ("c", "  short  ", "x"), ("d", "1234567890", "x")], base.schema)
    assert sorted(column(R.add_documents(base, new), "id")) == ["a", "b", "d"]
    up = R.update_documents(base, spark.createDataFrame([("a", "new text", None), ("q", "zzz", "y")], base.schema), metadata="source")
    assert {tuple(r) for r in up.collect()} == {("a", "new text", "m1"), ("b", "another long text", "m2")}
    assert column(R.delete_documents(base, spark.createDataFrame([("a",)], "id string")), "id") == ["b"]
    assert R.clear(base).count() == 0


def test_similar_documents_and_unknown_ids(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "id int, embedding array<double>")
    got = {(r["query_id"], r["rank"], r["id"]) for r in R.similar_documents(df, [0, 3], 2).collect()}
    assert got == {(0, 1, 1), (0, 2, 2), (3, 1, 2), (3, 2, 4)}
    with pytest.raises(ValueError, match="unknown"):
        R.similar_documents(df, [99], 2)


def test_similar_questions_skip_copies(spark):
    h = spark.createDataFrame([(i, "how much pay") for i in range(20)] + [(20, "how much pay now"), (21, "sick days")], "id int, text string")
    v = R.text_vectors(h, "text", 512)
    ask = v.filter("id = 0").select(F.lit("q").alias("query_id"), "text", F.col("embedding").alias("query_vector"))
    rows = R.similar_questions(v, ask, 2).orderBy("rank").collect()
    assert [r["text"] for r in rows] == ["how much pay now", "sick days"]


def test_vectors_have_unit_length(spark):
    df = spark.createDataFrame([("the cat sat",), ("",), (None,), ("the dog",)], "content string")
    n = {r["content"]: round(sum(x * x for x in r["embedding"]), 9) for r in R.text_vectors(df, "content", 64).collect()}  # in no order
    assert n == {"the cat sat": 1.0, "": 0.0, None: 0.0, "the dog": 1.0}


MESSAGES = ["What about pay?", "Can you explain", "attrition in sales last year above 20", "our brand policy", "compare hr vs finance", "hello"]


@pytest.fixture(scope="module")
def talk(spark):
    return spark.createDataFrame([(1, i, "user", m) for i, m in enumerate(MESSAGES)], "conv_id int, turn int, role string, text string")


def test_intents(talk):
    got = column(talk.select("turn", V.intent(F.col("text")).alias("x")), "x", "turn")
    assert got == ["follow_up_question", "clarification_request", "attrition_analysis", "follow_up_question", "comparison_request", "general_inquiry"]


def plain_entities(text):
    """The definition, word by word."""
    low = text.lower()
    named = lambda groups: [n for n, ws in groups.items() if any(w in low for w in ws)]
    return named(presets.DEPARTMENTS), named(presets.METRICS), [t for t in presets.TIME_TERMS if t in low], [t for t in presets.COMPARISON_TERMS if t in low]


def test_entities(talk):
    rows = talk.select("text", V.entities(F.col("text")).alias("e")).collect()
    for r in rows:
        e = r["e"]
        assert (e["departments"], e["metrics"], e["time_periods"], e["comparison_terms"]) == plain_entities(r["text"])
    assert rows[2]["e"]["numbers"] == [20]


def test_huge_numbers_become_null(spark):
    df = spark.createDataFrame([("7 and 99999999999999999999",)], "t string")
    assert df.select(V.entities(F.col("t")).alias("e")).first()["e"]["numbers"] == [7, None]


@pytest.mark.parametrize("chunks", [None, 3])
def test_context_is_what_was_said_before(talk, chunks):
    assert column(V.topic_context(talk, chunks=chunks), "topic_before", "turn") == [None, None, None, "attrition_analysis", "policy_inquiry", "policy_inquiry"]
    before = [r and r["departments"] for r in column(V.entity_context(talk, chunks=chunks), "entities_before", "turn")]
    assert before == [None, [], [], ["sales", "it"], ["marketing"], ["hr", "finance"]]


def test_last_exchanges_use_a_limit_before_the_shuffle(talk):
    out = V.last_exchanges(talk, 2)
    assert sorted(column(out, "turn")) == [4, 5]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_concise(spark):
    text = "\n".join(["a", "", " b ", "c", "   ", "d", ""])
    df = spark.createDataFrame([(text,), ("only",)], "t string")
    assert [r[0] for r in df.select(V.concise(F.col("t"), 2)).collect()] == ["a\n\n b \n   \n", "only"]


def test_messages_on_a_stream(spark, talk):
    src, out, check = (scratch(spark, x) for x in ("in", "out", "check"))
    talk.write.parquet(src)
    q = rowwise.to_parquet(rowwise.classify_messages(spark.readStream.schema(talk.schema).parquet(src)), out, check)
    q.awaitTermination(120)
    assert column(spark.read.parquet(out), "intent", "turn") == column(talk.select("turn", V.intent(F.col("text")).alias("x")), "x", "turn")


def write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_csv_with_different_headers(spark, tmp_path):
    a = write(tmp_path, "a.csv", "k,x\n1,2.5\n2,3.5\n")
    b = write(tmp_path, "b.csv", "k,t\n3,hello\n")
    empty = write(tmp_path, "empty.csv", "")
    df = readers.read_csv(spark, [a, b, empty, str(tmp_path / "none.csv")])
    assert {(r["k"], r["x"], r["t"]) for r in df.collect()} == {(1, 2.5, None), (2, 3.5, None), (3, None, "hello")}
    stats = {os.path.basename(r["_source_file"]): r["records"] for r in readers.collection_statistics(df).collect()}
    assert stats == {"a.csv": 2, "b.csv": 1}
    with pytest.raises(ValueError):
        readers.read_csv(spark, [str(tmp_path / "none.csv")])
    with pytest.raises(ValueError):
        readers.read_csv(spark, [empty])


def test_stack_reconciles_types(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(2.5, 7)], "k double, v int")
    assert {tuple(r) for r in readers.stack([a, b]).collect()} == {(1.0, "x"), (2.5, "7")}


def test_json_files(spark, tmp_path):
    write(tmp_path, "array.json", json.dumps([{"id": 1, "a": {"b": {"c": 5}}}, {"id": 2}]))
    write(tmp_path, "object.json", json.dumps({"id": 3, "a": {"b": {"c": 7}}}))
    df = readers.read_json(spark, [str(tmp_path / "*.json")])
    assert {(r["id"], r["a.b.c"]) for r in df.collect()} == {(1, 5), (2, None), (3, 7)}
    assert readers.SOURCE in df.columns


def test_payloads(spark):
    df = spark.createDataFrame([("e1", '[{"id": 1, "u": {"n": "x"}}, {"id": 2}]'), ("e2", '{"id": 3.5, "u": {"n": "y"}}')], "endpoint string, body string")
    rows = {(r["_source_endpoint"], r["id"], r["u.n"]) for r in readers.normalise_payloads(df, "endpoint", "body").collect()}
    assert rows == {("e1", 1.0, "x"), ("e1", 2.0, None), ("e2", 3.5, "y")}
    typed = readers.normalise_payloads(df, "endpoint", "body", "id double, u struct<n: string>")
    assert {(r["id"], r["u.n"]) for r in typed.collect()} == {(1.0, "x"), (2.0, None), (3.5, "y")}


def test_export_rules(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "k int, t string")
    for fmt in writers.FORMATS:
        path = writers.export(df, str(tmp_path / fmt), fmt)
        reader = spark.read.schema(df.schema).format(fmt)
        back = (reader.option("header", True) if fmt == "csv" else reader).load(path)
        assert {tuple(r) for r in back.collect()} == {(1, "a,b"), (2, None)}
    with pytest.raises(ValueError):
        writers.export(df.limit(0), str(tmp_path / "none"))
    with pytest.raises(ValueError):
        writers.export(df, str(tmp_path / "x"), "xlsx")
    writers.export_feature_metadata(readers.schema_table(df), str(tmp_path / "meta"))
    assert spark.read.json(str(tmp_path / "meta")).count() == 2


def test_kept_tables_are_released(spark):
    df = readers.keep(spark.range(3))
    assert df.is_cached and readers.release(df, spark.range(2)) == 1


def test_chunks_leave_a_batch_in_parts():
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("content", T.StringType())])
    texts = ["one two three " * (R.PART_CHARS // 10), None, "", "short", " x\n\ny " * (R.PART_CHARS // 5), "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])
    parts = list(R._chunk_rows(1000, 200, kind)([batch, batch.slice(0, 0)]))
    assert [sorted(set(p.column(0).to_pylist())) for p in parts] == [[0], [3, 4], [5]]
    for i, t in enumerate(texts):
        got = [(n, c) for p in parts for j, n, c in zip(*(x.to_pylist() for x in p.columns)) if j == i]
        assert got == list(enumerate(R.split_text(t, 1000, 200) if t else []))
