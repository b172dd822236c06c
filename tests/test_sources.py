"""Readers and writers on small files: what is written comes back, odd cells included."""

import json

from palimpsest import schemas
from palimpsest.sources import readers, sinks


def test_csv_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('qid,n,score,text\na,1,0.5,"two ""words""\nin lines, and more"\nb,,NaN,\n')
    schema = "qid string, n int, score double, text string"
    assert [tuple(r) for r in readers.csv(spark, f"{tmp_path}/a.csv", schema).orderBy("qid").collect()] == [("a", 1, 0.5, 'two "words"\nin lines, and more'), ("b", None, None, None)]
    kept = readers.csv(spark, f"{tmp_path}/a.csv", schema, keep_empty=True).where("qid = 'b'").first()
    assert kept.text == "" and kept.n is None
    plan = readers.csv(spark, f"{tmp_path}/a.csv", schema).select("qid")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<qid:string>" in plan


def test_stories_keep_empty_cells(spark, tmp_path):
    (tmp_path / "s.csv").write_text('story_id,question,answer_char_ranges,is_answer_absent,is_question_bad,validated_answers,story_text\ns1,q?,0:3,,0,,"A\nB"\n')
    assert tuple(readers.stories(spark, f"{tmp_path}/s.csv").first()) == ("s1", "q?", "0:3", "", "0", "", "A\nB")


def test_jsonl(spark, tmp_path):
    record = {"id": "2hop__1", "question": "q", "answer": "a", "answer_aliases": None, "paragraphs": [
        {"idx": 1, "title": "T1", "paragraph_text": "one", "is_supporting": True}, {"idx": 0, "title": "T0", "paragraph_text": "nil", "is_supporting": True}, {"idx": 2, "title": "T2", "paragraph_text": "two", "is_supporting": False}]}
    (tmp_path / "q.jsonl").write_text(json.dumps(record) + "\n\n" + json.dumps({**record, "id": "x", "answer_aliases": ["b"]}) + "\n")
    q = readers.jsonl(spark, f"{tmp_path}/q.jsonl", schemas.QUESTIONS)
    assert [tuple(r) for r in readers.answers_by_question(q).orderBy("id").collect()] == [("2hop__1", "q", "a", []), ("x", "q", "a", ["b"])]
    one = q.where("id = 'x'")
    assert one.select(readers.original_text(one["paragraphs"], True)).first()[0] == "T0. nil\n\nT1. one"
    assert one.select(readers.original_text(one["paragraphs"], False)).first()[0] == "T1. one\n\nT0. nil\n\nT2. two"
    (tmp_path / "bad.jsonl").write_text('{"id": "a"}\n{"id": \n{"id": "b"}\n')
    assert {r.id for r in readers.jsonl(spark, f"{tmp_path}/bad.jsonl", "id string", tolerant=True).collect()} == {"a", "b"}


def test_demonstrations_and_pinned_ids(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"s1": ["f1", "f2"], "s2": []}))
    assert {(r.sentence, tuple(r.facts)) for r in readers.demonstrations(spark, f"{tmp_path}/d.json").collect()} == {("s1", ("f1", "f2")), ("s2", ())}
    (tmp_path / "ids.txt").write_text("# all\na # first\n\nb\na\nmissing\n")
    ids = readers.pinned_ids(spark, f"{tmp_path}/ids.txt")
    kept, missing = readers.restrict(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "qid string, n int"), ids)
    assert sorted(map(tuple, kept.collect())) == [("a", 1), ("b", 2)] and [r.qid for r in missing.collect()] == ["missing"]


def test_writers(spark, tmp_path):
    one, two = spark.createDataFrame([("a", 1), ("b", 2)], "qid string, n int"), spark.createDataFrame([("b", 3), ("c", 4)], "qid string, n int")
    at = f"{tmp_path}/t"
    sinks.save(two, at)
    sinks.save(one, at)
    sinks.append(two, at)
    assert sorted(map(tuple, spark.read.parquet(at).collect())) == [("a", 1), ("b", 2), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, sinks.keep_last(one, two, ["qid"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    for df in (one, two):
        sinks.append_jsonl(df, f"{tmp_path}/j")
    assert readers.jsonl(spark, f"{tmp_path}/j", "qid string, n int").count() == 4
    shards = sinks.sharded(spark.read.parquet(at), 3).selectExpr("qid", "spark_partition_id() AS p").distinct().collect()
    assert len(shards) == len({r.qid for r in shards}) == 3
    found = spark.createDataFrame([("a", [("f", "x"), ("g", "y")])], "qid string, facts array<struct<fact:string,label:string>>")
    assert sorted(map(tuple, sinks.details(found, ["qid"], "facts").collect())) == [("a", "f", "x"), ("a", "g", "y")]


def test_report_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("b|c", 2.5), ("a", None)], "name string, score double")
    assert [r.line for r in sinks.markdown(df, "name").orderBy("line_no").collect()] == ["| name | score |", "| - | - |", "| a |  |", "| b\\|c | 2.5 |"]
    sinks.save(df, f"{tmp_path}/out")
    sinks.manifest(spark, f"{tmp_path}/m", {"scores": f"{tmp_path}/out"}, resamples=100)
    got = spark.read.json(f"{tmp_path}/m").first()
    assert (got.output, got.n_rows, got["columns"], got.parameters.resamples) == ("scores", 2, ["name", "score"], "100")
