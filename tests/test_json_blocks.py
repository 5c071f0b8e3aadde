"""JSON files that several tasks share: borders in strings, in nested objects, behind escapes, across blocks."""

import json
import random

import pytest

from tabulon.sources import readers


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "256", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def record(r: random.Random, i: int) -> dict:
    word = "".join(r.choice('ab{}[]",:\\\n é字') for _ in range(r.choice([0, 3, 20, 400])))
    return {"id": i, "text": word, "in": {"n": r.random(), "deep": {"s": word[:9], "list": [{"x": j} for j in range(r.randrange(3))]}}}


def test_elements_of_split_files(spark, tmp_path, small_blocks):
    r = random.Random(4)
    want = {}
    for n, form in enumerate([None, 2, None, 1, None]):
        rows = [record(r, 1000 * n + i) for i in range(r.choice([1, 7, 40]))]
        (tmp_path / f"{n}.json").write_text(json.dumps(rows, indent=form, ensure_ascii=n % 2 == 0) + "\n" * n, encoding="utf-8")
        want |= {x["id"]: x for x in rows}
    one = record(r, -1)
    (tmp_path / "one.json").write_text(json.dumps(one, indent=3))
    lines = [record(r, -2 - i) for i in range(9)]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, lines)))
    want |= {x["id"]: x for x in [one, *lines]}
    found = readers.json_elements(spark, [str(tmp_path / "*.json")])
    texts = [json.loads(t["value"]) for t in found.collect()]
    assert len(texts) == len(want) and {t["id"]: t for t in texts} == want
    assert found.select("f", "b").distinct().count() > 20

    rows = readers.read_json(spark, [str(tmp_path / "*.json")], lineage=False).collect()
    assert {x["id"]: (x["text"], x["in.n"], x["in.deep.s"], [e["x"] for e in x["in.deep.list"]]) for x in rows} == {
        k: (v["text"], v["in"]["n"], v["in"]["deep"]["s"], [e["x"] for e in v["in"]["deep"]["list"]]) for k, v in want.items()}


def test_what_gives_no_row(spark, tmp_path, small_blocks):
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "blank.json").write_text("")
    (tmp_path / "mixed.json").write_text('[1, "a}{\\"", {"id": 1}, null, {"id": 2}, true]')
    (tmp_path / "broken.json").write_text('[{"id": 3}, {"id": 45')
    (tmp_path / "broken_object.json").write_text('{"id": 67')
    rows = readers.read_json(spark, [str(tmp_path / "*.json")], lineage=False)
    assert sorted(x["id"] for x in rows.collect()) == [1, 2, 3]
    assert readers.read_json(spark, [str(tmp_path / "none.json")]).collect() == []


def test_merged_types(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"n": 1, "m": 1, "o": null, "l": [1], "odd key": {"x:VOID": 2.5}}, {"n": 2.25, "m": "t", "l": []}]')
    df = readers.read_json(spark, [str(tmp_path / "a.json")], lineage=False)
    kinds = dict(df.dtypes)
    assert kinds == {"n": "double", "m": "string", "o": "string", "l": "array<bigint>", "odd key.x:VOID": "double"}
    assert {(r["n"], r["m"], r["odd key.x:VOID"]) for r in df.collect()} == {(1.0, "1", 2.5), (2.25, "t", None)}
    given = readers.read_json(spark, [str(tmp_path / "a.json")], schema="n double, m string", lineage=False)
    assert given.columns == ["n", "m"]
