"""Documents read by ranges of bytes and written by pieces."""

import json
import os
import random

import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ternway.sinks import pieces
from ternway.sinks.pieces import Part, write_document
from ternway.sources import ranges
from ternway.sources.files import read_flight_file

ODD = ['"', "\\", '\\"', "}", "{", "[", "]", "\\\\", "é", "日本", "\n", ",", ":", "leg1_flights", ""]


def odd_text(r):
    return "".join(r.choice(ODD) for _ in range(r.randrange(6)))


def flights(r, n):
    return [{"origin": odd_text(r), "link": odd_text(r), "price": k, odd_text(r) + "x": [{"leg1_flights": [{"a": 1}]}, []]} for k in range(n)]


@pytest.mark.parametrize("seed,range_bytes,indent", [(1, 1, None), (2, 7, 1), (3, 64, None), (4, 1 << 20, 2)])
def test_cuts_anywhere(spark, tmp_path, seed, range_bytes, indent):
    r = random.Random(seed)
    n = 3 if range_bytes == 1 else 25
    document = {"metadata": {"origin": odd_text(r) + "M", "leg1_date_range": {"start": "a", "end": "}"}, "intermediate_airports": ["]"]}, odd_text(r) + "k": [[{}], {}], "leg2_flights": flights(r, n), "note": '"leg1_flights": [{', "leg1_flights": flights(r, n - 1)}
    (tmp_path / "f.json").write_text(json.dumps(document, ensure_ascii=seed % 2 == 0, indent=indent))
    found = ranges.documents(spark, str(tmp_path / "f.json"), range_bytes)
    for name in ("leg1_flights", "leg2_flights"):
        rows = ranges.objects(spark, found, name).orderBy("pos").collect()
        assert [x.pos for x in rows] == list(range(len(document[name])))
        assert [json.loads(x.value) for x in rows] == document[name]
    back = read_flight_file(spark, str(tmp_path / "f.json"), range_bytes)
    assert sorted((x.pos, x.origin, x.price) for x in back.leg2.collect()) == [(k, x["origin"], float(k)) for k, x in enumerate(document["leg2_flights"])]
    assert back.metadata.first().leg1_date_range.end == "}" and back.metadata.first().origin == document["metadata"]["origin"]


def test_gaps_and_what_is_no_document(spark, tmp_path):
    cases = {"none": ("{}", 0), "null": ('{"leg1_flights": null}', 0), "empty": (' {"leg1_flights" :\n [ ] }\n', 0), "others": ('{"leg1_flights": [null, 3, [{"price": 1}], {"price": 2}, "x"]}', 1), "twice": ('{"leg1_flights": [{}, {}], "leg1_flights": [{"price": 2}]}', 1), "far": ('{"leg1_flights":' + " " * 3000 + '[{"price": 2}]}', 1)}
    for name, (text, n) in cases.items():
        (tmp_path / name).write_text(text)
        got = read_flight_file(spark, str(tmp_path / name), 50)
        assert got.leg1.count() == n, name
        assert got.metadata.first().origin is None
    for name, text in {"cut": '{"leg1_flights": [{', "list": "[{}]", "two": "{} {}", "string": '{"a": "', "nothing": ""}.items():
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            read_flight_file(spark, str(tmp_path / name))
    with pytest.raises(AnalysisException):
        read_flight_file(spark, str(tmp_path / "missing"))


def test_many_files_and_many_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"a b{k}.json").write_text(json.dumps({"metadata": {"origin": str(k)}, "leg1_flights": [{"price": p} for p in range(200 * (k + 1))]}))
    got = read_flight_file(spark, str(tmp_path / "in"), 500)
    assert sorted(x.pos for x in got.leg1.collect()) == sorted(p for k in range(3) for p in range(200 * (k + 1)))
    assert sorted(x.origin for x in got.metadata.collect()) == ["0", "1", "2"]
    assert got.leg1.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 4


def test_document_of_many_pieces(spark, tmp_path):
    path = str(tmp_path / "deep" / "d.json")
    a = spark.range(5000).repartition(7).select("id", F.concat(F.lit('"'), "id", F.lit('"')).alias("value"))
    b = spark.range(3).select((-F.col("id")).alias("x"), F.col("id").cast("string").alias("y"), F.when(F.col("id") != 1, F.to_json(F.struct("id"))).alias("value"))
    empty = a.where("id < 0")
    for _ in range(2):  # the second replaces the first
        write_document(spark, [Part('{"a": [', a, ("id",)), Part('], "none": [', empty, ("id",)), Part('], "b": [', b, ("x", "y"))], "]}", path)
        got = json.loads(open(path, encoding="utf-8").read())
        assert got == {"a": [str(k) for k in range(5000)], "none": [], "b": [{"id": 2}, {"id": 0}]}
        assert os.listdir(tmp_path / "deep") == ["d.json"]


def test_failed_task_leaves_the_old_document(spark, tmp_path):
    path = str(tmp_path / "d.json")
    rows = spark.range(1000)
    write_document(spark, [Part("[", rows.select("id", F.col("id").cast("string").alias("value")), ("id",))], "]", path)
    bad = rows.select("id", F.when(F.col("id") == 990, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception, match="broken"):
        write_document(spark, [Part("[", bad, ("id",))], "]", path)
    assert json.loads(open(path).read()) == list(range(1000)) and os.listdir(tmp_path) == ["d.json"]


def test_pieces_are_copied_by_tasks_once(spark, tmp_path):
    """Tasks put the pieces together and empty them; an attempt that comes later finds them empty, and one that is cut short is an error."""
    (tmp_path / "0-7").write_bytes(b"aabbb")
    (tmp_path / "1-8").write_bytes(b"cc")
    whole = str(tmp_path / "whole")
    layout = lambda: pieces.laid_out([("0-7", [(0, 0, 2), (1, 2, 5)]), ("1-8", [(1, 0, 2)])], ["{", "|"], "}")
    pieces.copied_by_tasks(spark, str(tmp_path), whole, layout())
    assert open(whole, "rb").read() == b"{\naa|\nbbb,\ncc\n}"
    assert [(tmp_path / p).stat().st_size for p in ("0-7", "1-8")] == [0, 0]
    row = pa.RecordBatch.from_pylist([{"piece": str(tmp_path / "0-7"), "whole": whole, "spans": [{"start": 0, "stop": 2, "at": 2}]}])
    assert len(list(pieces._copied([row]))) == 1 and open(whole, "rb").read() == b"{\naa|\nbbb,\ncc\n}"
    (tmp_path / "0-7").write_bytes(b"a")
    with pytest.raises(OSError):
        list(pieces._copied([row]))
