"""A1-A19 on small files."""

import json

import random

import pytest

from railweave.operators import network as N
from railweave.sources import json_array, readers, writers


def dump(path, value):
    path.write_text(json.dumps(value), encoding="utf-8")
    return str(path)


def test_station_and_line_files(spark, tmp_path):
    p = dump(tmp_path / "p.json", [{"nom": "A", "codes_uic": "1;2", "position_geographique": {"lon": 1.0, "lat": 2.0}}, {"nom": "B"}])
    got = readers.passenger_stations(spark, p).orderBy("ord").collect()
    assert [r.nom for r in got] == ["A", "B"] and got[0].position_geographique.lat == 2.0
    s = dump(tmp_path / "s.json", [{"code_uic": "1", "pk": "602+834", "voyageurs": "O", "code_ligne": "9"}])
    assert readers.station_lines(spark, s).first().pk == "602+834"
    g = dump(tmp_path / "l.json", [{"code_ligne": "9", "lib_ligne": "Ligne a grande vitesse",
                                    "geo_shape": {"geometry": {"coordinates": [[2.0, 48.0], [3.0, 49.0]]}}}])
    row = N.line_attributes(readers.lines(spark, g)).first()
    assert row.is_high_speed and row.geometry == [[48.0, 2.0], [49.0, 3.0]]
    t = dump(tmp_path / "t.json", [{"date": "2024-01-01", "train_no": "1"}, {"date": "2024-01-02", "train_no": "2"}])
    readers.ingest(readers.trips(spark, t), str(tmp_path / "trips"), "date")
    assert spark.read.parquet(str(tmp_path / "trips")).filter("date = '2024-01-02'").first().train_no == "2"


def test_label_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,label,language,departure\n"Bonjour, toi",valid,french,Paris\nx,INVALID,german,\n')
    got = [tuple(r) for r in readers.samples_csv(spark, str(tmp_path / "a.csv")).collect()]
    assert got == [("Bonjour, toi", "TRIP", "FRENCH", "Paris", "", ""), ("x", "NOT_TRIP", "UNKNOWN", "", "", "")]
    j = dump(tmp_path / "b.json", [{"sentence": "x", "intent": "VALID", "language": "Spanish"}])
    row = readers.samples_json(spark, j).first()
    assert (row.intent, row.language) == ("VALID", "UNKNOWN")
    (tmp_path / "u.csv").write_text("sentenceID,sentence\n5,de Paris a Lyon\n")
    assert tuple(readers.utterances_csv(spark, str(tmp_path / "u.csv")).first()) == ("5", "de Paris a Lyon")
    (tmp_path / "g.csv").write_text("city_name,stations_name\n Paris ,Paris Est\nnan,Lyon\nParis,\n")
    assert {r.name for r in readers.place_names_csv(spark, str(tmp_path / "g.csv")).collect()} == {"Paris", "Paris Est", "Lyon"}
    (tmp_path / "n.csv").write_text("sentenceID,sentence,labels\n1,a Lyon,O B-LOC\n")
    assert readers.annotated_csv(spark, str(tmp_path / "n.csv")).first().labels == ["O", "B-LOC"]


def test_request_log_skips_blank_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"timestamp":"2024-01-01T00:00:00Z","duration_s":0.5,"output":{"a":1}}\n\n{"timestamp":"2024-01-02T00:00:00Z"}\n')
    rows = readers.request_log(spark, str(tmp_path / "r.jsonl")).orderBy("timestamp").collect()
    assert len(rows) == 2 and rows[0].output == '{"a":1}'
    runs = spark.createDataFrame([("m", 0.5)], "model string, f1 double")
    for _ in range(2):
        writers.append_training_log(runs, str(tmp_path / "train"))
    got = spark.read.json(str(tmp_path / "train"))
    assert got.count() == 2 and got.filter("timestamp rlike '^\\\\d{4}-.*Z$'").count() == 2


def test_reports(spark, tmp_path):
    for name, body in (("evaluation_2025-03-04_10-20-30", {"samples": 3, "eval_type": "intent"}), ("evaluation_2025-05-01_00-00-00", {})):
        dump(tmp_path / f"{name}.json", body)
    got = [tuple(r) for r in readers.report_catalogue(spark, str(tmp_path)).collect()]
    assert got == [("evaluation_2025-05-01_00-00-00", "2025-05-01", "all", "test_set", 0),
                   ("evaluation_2025-03-04_10-20-30", "2025-03-04", "intent", "test_set", 3)]
    assert json.loads(readers.report(spark, str(tmp_path), got[1][0]).first().body)["samples"] == 3
    assert readers.report(spark, str(tmp_path), "none").count() == 0


def test_report_document(spark, tmp_path):
    table = spark.createDataFrame([("b", 0.5), ("a", 1.0)], "model string, accuracy double")
    pairs = table.withColumnRenamed("model", "intent")
    writers.write_report(writers.report_document({"intent": table, "combined": pairs}, samples=2), str(tmp_path / "r"))
    body = json.loads(spark.read.text(str(tmp_path / "r")).first()[0])
    assert body["intent"]["a"] == {"accuracy": 1.0} and len(body["combined"]) == 2 and body["samples"] == 2


def test_route_lines(spark, tmp_path):
    rows = spark.createDataFrame([("1", ["A", "B"], None), ("2", None, "No path found")], "id string, path array<string>, error string")
    writers.write_lines(writers.route_lines(rows), str(tmp_path / "routes"))
    assert {r[0] for r in spark.read.text(str(tmp_path / "routes")).collect()} == {"1, A, B", "2, INVALID"}
    done = spark.createDataFrame([("1", "A", "B", None)], "sentence_id string, departure string, destination string, code string")
    assert tuple(writers.extraction_lines(done).first()) == ("1", "1,A,B")
    assert writers.extraction_lines(done).columns == ["sentenceID", "result"]


def tricky_rows(rng, n):
    return [{"a": i, "t": "".join(rng.choice('x"\\{}[],é😀\n ') for _ in range(rng.randint(0, 12))), "n": {"q": [1, {"z": "}"}]}}
            for i in range(n)]


def test_byte_ranges_lose_no_object(tmp_path):
    rng, path = random.Random(3), tmp_path / "a.json"
    for _ in range(200):
        rows = tricky_rows(rng, rng.randint(0, 9))
        path.write_text(json.dumps(rows, ensure_ascii=rng.random() < .5, indent=rng.choice([None, 2])), encoding="utf-8")
        borders = json_array.cuts(str(path), rng.choice([1, 2, 3, 7, 20, 64, 1000]))
        starts, depth, inside = [], 0, False
        for low, high in zip(borders, borders[1:]):
            starts.append(((low, high), depth, inside))
            change, inside = json_array.scan(path.read_bytes()[low:high], inside)
            depth += change
        reader = json_array.ArrayReader(None, {"path": str(path), "split_bytes": "5", "states": json.dumps(starts)})
        assert [json.loads(v) for p in reader.partitions() for v, _ in reader.read(p)] == rows


@pytest.mark.parametrize("split", [300, 1 << 20])
def test_array_in_byte_ranges(spark, tmp_path, split):
    rows = tricky_rows(random.Random(split), 40)
    path = tmp_path / "a.json"
    path.write_text(json.dumps(rows, ensure_ascii=False, indent=2), encoding="utf-8")
    got = json_array.read_array(spark, str(path), "a int, t string, n struct<q: array<string>>", split).orderBy("ord").collect()
    assert [(r.a, r.t) for r in got] == [(r["a"], r["t"]) for r in rows]
    for text in ("[]", ""):
        (tmp_path / "e.json").write_text(text)
        assert json_array.read_array(spark, str(tmp_path / "e.json"), "a int", split).count() == 0


def test_folder_of_arrays(spark, tmp_path):
    from railweave.catalog.files import array_files

    rows = spark.range(1000).selectExpr("id AS k", "id AS n", "concat('a]', char(34), '{', id) AS t")
    folder = array_files(rows, "k", spark, file_rows=100)
    files = json_array.array_paths(folder)
    assert len(files) > 5
    sizes = [len(json.loads(open(f, encoding="utf-8").read())) for f in files]
    assert sum(sizes) == 1000 and max(sizes) < 300
    got = json_array.read_array(spark, files, "n long, t string", 64).orderBy("ord").collect()
    want = [v for f in files for v in json.loads(open(f, encoding="utf-8").read())]
    assert [(r.n, r.t) for r in got] == [(v["n"], v["t"]) for v in want]
    assert readers.lines(spark, array_files(rows.selectExpr("k", "string(n) AS code_ligne"), "k", spark, 300)).count() == 1000


def test_one_day_is_ingested_by_several_tasks(spark, tmp_path):
    rows = spark.range(400).selectExpr("'2024-01-01' AS date", "string(id) AS train_no")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        readers.ingest(rows, str(tmp_path / "day"), "date")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    found = spark.read.parquet(str(tmp_path / "day"))
    assert found.count() == 400 and found.select("_metadata.file_path").distinct().count() > 1
