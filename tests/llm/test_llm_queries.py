"""The registered queries: SQL where there is some, digests against plain Python, and the pipeline stage by stage."""

import hashlib
import html
import os
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline

NAMES = ["op1_exact_dedup", "op2_html_extraction", "op3_substring_dedup", "op4_language_id", "op5_ngram_jaccard", "op6_license_scan", "op7_secret_scan", "op8_mixing", "op9_ann", "op10_sentencepiece", "op11_filter_audit", "op12_merkle_manifest", "op13_lm_scoring", "pipeline"]


def test_all_are_registered():
    assert set(NAMES) <= set(entry.queries())


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("key", [k for k in NAMES if k in entry.oracle_sql()])
def test_matches_sql(spark, sf, con, key):
    df = entry.queries()[key](spark, sf)
    cur = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert Counter(tuple(plain(r[n]) for n in names) for r in df.collect()) == Counter(tuple(map(plain, r)) for r in cur.fetchall())


def test_secret_digests(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    patterns = (("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32))
    out = entry.queries()["op7_secret_scan"](spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        spans = sorted((m.start(), n, k, m.end()) for n, (k, p, g, least) in enumerate(patterns) for m in re.finditer(p, texts[r["doc_id"]]) if len(m[g]) >= least)
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[2] == k for s in spans) for k, *_ in patterns)


def test_pieces_are_lossless(spark, sf):
    out = entry.queries()["op10_sentencepiece"](spark, sf)
    assert out.where("NOT lossless").count() == 0 and out.where("n_pieces > 0").count() > 0


def test_main_text_of_pages(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in entry.queries()["op2_html_extraction"](spark, sf).collect():
        inside = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?p>|</?h1>", inside))
        assert r["text"] == "\n\n".join(x for x in blocks if x) and r["n_chars"] == len(r["text"])


def test_language_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang")
    out = entry.queries()["op4_language_id"](spark, sf.replace("0.001", "0.01")).join(docs, "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() >= 0.97 * out.count()


def test_pipeline_stages(spark, sf):
    """Each stage on what its predecessor kept, against the rules of the stage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.limit(3).select(F.lit(None).cast("long").alias("doc_id"), F.lit("12 34").alias("text"), "lang", "source", "n_chars"))
    columns, kept = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert out.columns == columns + (["ids"] if k == len(corpus_pipeline.STAGES) - 1 else [])
        docs = out.cache()
        kept.append(docs.count())
        if k == 0:
            assert kept[1] == kept[0] - 3
        elif k == 1:
            assert kept[2] == docs.select(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")).distinct().count() < kept[1]
        elif k == 2:
            assert kept[3] <= kept[2] and docs.select("doc_id").distinct().count() == kept[3]
        elif k == 3:
            assert docs.groupBy("doc_id").count().where("count > 3").count() == 0
    assert kept[5] == kept[4] > 0 and docs.where("size(ids) = 0 AND text <> ''").count() == 0
    assert entry.queries()["pipeline"](spark, sf).count() > 0
