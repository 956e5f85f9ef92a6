"""Readers on files the tests write themselves."""

import json

import pytest
from pyspark.sql import functions as F

from flowguard.operators import detect, profile
from flowguard.sources import csvlog, jsonlog, listing, load, records

CAPTURE_HEADER = ("Label,Flow Duration,Total Fwd Packets,Total Backward Packets,"
                  "Total Length of Fwd Packets,Total Length of Bwd Packets,"
                  "Average Packet Size,Flow Packets/s")
CLASSES = ["BENIGN", "DoS Hulk", "DDoS", "PortScan", "Bot", "FTP-Patator", "Web Attack - XSS",
           "Infiltration"]


def put(folder, **files):
    for name, text in files.items():
        path = folder / name.replace("__", ".")
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(folder)


def by_source(frame, *columns):
    return {r["source_id"].rsplit("/", 1)[1]: tuple(r[c] for c in columns) if len(columns) > 1
            else r[columns[0]] for r in frame.collect()}


def test_csv_layouts(spark, tmp_path):
    folder = put(
        tmp_path, comma__csv="src_ip,bytes,label\n10.0.0.1,5,BENIGN\n10.0.0.2,,DoS\n",
        semi__csv="a;b\n1;2\n\n3;4\n", tab__csv="a\tb\n1\t2\n", pipe__csv="a|b\n1|2\n",
        single__csv="only\nx\ny\n", bom__csv=b"\xef\xbb\xbfa,b\n1,2\n",
        blank__csv="a,b\n1,2\n , \n\n3,4\n", quoted__csv='a,b\n"x,1",2\n"say ""hi""",3\n',
        lines__csv='a,b\n"two\nlines",2\n5,6\n',
        wide__csv="a,b\n1,2,3\n", narrow__csv="a,b\n1\n", noname__csv="a,\n1,2\n",
        twice__csv="a, a\n1,2\n", nothing__csv="\n \n", header__csv="a,b\n")
    parsed = csvlog.read(spark, folder)
    assert by_source(parsed.errors, "problem") == {
        "wide.csv": "ragged_row", "narrow.csv": "ragged_row", "noname.csv": "blank_column_name",
        "twice.csv": "duplicate_column_name", "nothing.csv": "empty_file",
        "header.csv": "no_data_rows"}
    got = {}
    for r in parsed.records.orderBy("source_id", "block", "seq").collect():
        got.setdefault(r["source_id"].rsplit("/", 1)[1], []).append((r["names"], r["cells"]))
    assert got["comma.csv"] == [(["src_ip", "bytes", "label"], ["10.0.0.1", "5", "BENIGN"]),
                                (["src_ip", "bytes", "label"], ["10.0.0.2", "", "DoS"])]
    assert [c for _, c in got["semi.csv"]] == [["1", "2"], ["3", "4"]]
    assert got["tab.csv"] == got["pipe.csv"] == [(["a", "b"], ["1", "2"])]
    assert [c for _, c in got["single.csv"]] == [["x"], ["y"]]
    assert got["bom.csv"][0][0] == ["a", "b"]
    assert [c for _, c in got["blank.csv"]] == [["1", "2"], ["3", "4"]]
    assert [c for _, c in got["quoted.csv"]] == [["x,1", "2"], ['say "hi"', "3"]]
    assert [c for _, c in got["lines.csv"]] == [["two\nlines", "2"], ["5", "6"]]


def test_quotes_count_at_the_start_of_a_field_only(spark, tmp_path):
    folder = put(tmp_path, inch__csv='a,b\n5" disk,1\n6,2\n', semi__csv='a;b\nx"y;"p\nq"\n3;4"\n')
    parsed = csvlog.read(spark, folder)
    assert parsed.errors.count() == 0
    got = {}
    for r in parsed.records.orderBy("source_id", "block", "seq").collect():
        got.setdefault(r["source_id"].rsplit("/", 1)[1], []).append(r["cells"])
    assert got == {"inch.csv": [['5" disk', "1"], ["6", "2"]],
                   "semi.csv": [['x"y', "p\nq"], ["3", '4"']]}


def test_records_that_span_lines_are_joined_across_splits(spark, tmp_path):
    rows = [[str(i), 'x"' * (i % 3) + "\n,\n" * (i % 5) + "y" * (i % 40)] for i in range(3000)]
    text = "n,t\n" + "\n".join(f'{n},"{t.replace(chr(34), chr(34) * 2)}"' for n, t in rows)
    folder = put(tmp_path, big__csv=text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        parsed = csvlog.read(spark, folder)
        assert parsed.errors.count() == 0
        found = parsed.records.orderBy("block", "seq").select("block", "cells").collect()
        assert len({r["block"] for r in found}) > 10
        assert [r["cells"] for r in found] == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_repeated_keys_blank_lines_and_empty_objects(spark, tmp_path):
    folder = put(tmp_path, twice__json='{"a":1,"a":2,"b":"x"}\n\t\n{"a":3}\n',
                 empty__json='{"a":1}\n{}\n{"a":2}\n', cut__json='{"a":1,"a":2\n')
    parsed = jsonlog.read(spark, folder)
    assert by_source(parsed.errors, "problem") == {"cut.json": "not_a_json_object"}
    cells = records.to_long(parsed.records)
    assert sorted(r["raw"] for r in cells.where("source_id LIKE '%twice%'").collect()) == ["2", "3", "x"]
    seen = {(r["source_id"].rsplit("/", 1)[1], r["col_name"]): (r["n_rows"], r["null_count"])
            for r in profile.column_profile(cells).collect()}
    assert seen["empty.json", "a"] == (3, 1) and seen["twice.json", "b"] == (2, 1)


def test_json_layouts(spark, tmp_path):
    folder = put(
        tmp_path, array__json='[{"b":1,"a":"x"},\n {"a":true,"c":null}]',
        lines__json='{"b": 1.0, "a": {"z":1,"y":[2]}}\n\n{"c": "007"}\n', one__json='{"a":1}',
        empty__json="[]", numbers__json="[1,2]", mixed__json='[{"a":1},7]',
        broken__json='{"a": 1', badline__json='{"a":1}\n{"a":\n', text__json='"text"',
        number__json="42", blank__json=" \n", brokenarray__json='[{"a":1}')
    parsed = jsonlog.read(spark, folder)
    assert by_source(parsed.errors, "problem") == {
        "empty.json": "no_records", "numbers.json": "not_a_json_object",
        "mixed.json": "not_a_json_object", "broken.json": "not_a_json_object",
        "badline.json": "not_a_json_object", "text.json": "not_a_json_log",
        "number.json": "not_a_json_log", "blank.json": "empty_file",
        "brokenarray.json": "not_valid_json"}
    got = {}
    for r in parsed.records.orderBy("source_id", "block", "seq").collect():
        got.setdefault(r["source_id"].rsplit("/", 1)[1], []).append(
            dict(zip(r["names"], r["cells"])))
    assert got["array.json"] == [{"b": "1", "a": "x"}, {"a": "true", "c": None}]
    assert got["lines.json"] == [{"b": "1.0", "a": '{"y":[2],"z":1}'}, {"c": "007"}]
    assert got["one.json"] == [{"a": "1"}]
    union = {(r["source_id"].rsplit("/", 1)[1], r["col_name"]): (r["first_row"], r["first_pos"])
             for r in profile.column_union(records.to_long(parsed.records)).collect()}
    names = sorted((k[1] for k in union if k[0] == "array.json"),
                   key=lambda n: union[("array.json", n)])
    assert names == ["b", "a", "c"]


ARRAYS = {
    "plain": '[{"a":1},{"a":2}]', "spaced": ' \n[ {"a":1} ,\n\n {"a":2}\n] \n', "quoted": '[{"a":"}{]["},{"b":"\\\\"},{"c":"\\"}"}]',
    "deep": '[{"a":{"b":[{"c":"}"},{}]}},{"a":[[{}]]}]', "mark": '\ufeff[{"a":1}]', "bare": "[1]", "tail": '[{"a":1},2]',
    "head": '[2,{"a":1}]', "middle": '[{"a":1},[{"a":1}],{"a":1}]', "none": " [ ] ", "comma": '[{"a":1},]', "two": '[{"a":1}{"a":2}]',
    "twocommas": '[{"a":1},,{"a":2}]', "first": '[,{"a":1}]', "open": '[{"a":1}', "more": '[{"a":1}]]', "brace": '[{"a":1}]}',
    "object": '[{"a":1}] {"a":2}', "string": '[{"a":"x},{"a":2}]', "wrong": '[{"a":1],{"a":2}]', "gone": "[", "again": '[{"a":1,"a":2}]',
    "escape": '[{"a":"\\}"}]', "word": '[{"a":nope}]', "null": '[null]', "long": '[{"a":"' + "x" * 3000 + '"},{"a":3}]'}


@pytest.mark.parametrize("split", [None, 7, 40])
def test_json_arrays_in_splits_of_any_size(spark, tmp_path, split):
    """Rows and refusals are those of reading each text whole."""
    folder = put(tmp_path, **{f"{k}__json": v for k, v in ARRAYS.items()})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        with records.holding():
            parsed = jsonlog.read(spark, folder)
            wrong = by_source(parsed.errors, "problem")
            got = {}
            for r in parsed.records.orderBy("source_id", "block", "seq").collect():
                got.setdefault(r["source_id"].rsplit("/", 1)[1], []).append(tuple(r["names"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, text in ARRAYS.items():
        try:
            whole = json.loads(text.lstrip("\ufeff"))
        except ValueError:
            assert wrong.get(f"{name}.json") == "not_valid_json", name
            continue
        if not whole:
            assert wrong[f"{name}.json"] == "no_records"
        elif not all(isinstance(x, dict) for x in whole):
            assert wrong[f"{name}.json"] == "not_a_json_object", name
        else:
            assert f"{name}.json" not in wrong and got[f"{name}.json"] == [tuple(x) for x in whole], name


def test_a_record_that_never_ends_refuses_its_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "RECORD_BYTES", 400)
    rows = "".join(f"{k},x{k}\n" for k in range(200))
    folder = put(tmp_path, good__csv="a,b\n" + rows + '1,"two\nlines"\n', open__csv='a,b\n1,"never closed\n' + rows)
    parsed = csvlog.read(spark, f"{folder}/*.csv")
    assert by_source(parsed.errors, "problem") == {"open.csv": "oversized_record"}
    assert parsed.records.count() == 201
    items = ",".join('{"a":%d}' % k for k in range(200))
    put(tmp_path, good__json=f"[{items}]", unclosed__json='[{"a":"' + "},{" * 300, nobrace__json='[{"a":"' + "x" * 900 + '"},{"a":1}]',
        row__json='{"a":"' + "x" * 900 + '"}\n{"a":1}\n')
    parsed = jsonlog.read(spark, f"{folder}/*.json")
    assert by_source(parsed.errors, "problem") == {n: "oversized_record" for n in (
        "unclosed.json", "nobrace.json", "row.json")}
    assert parsed.records.count() == 200


def test_row_index_counts_across_splits(spark, tmp_path):
    rows = "\n".join(f"{i},{'x' * (i % 50)}" for i in range(20000))
    folder = put(tmp_path, big__csv="n,t\n" + rows + "\n", small__csv="n,t\n0,a\n1,b\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        parsed = csvlog.read(spark, folder)
        indexed = records.with_row_index(parsed.records)
        assert indexed.count() == 20002
        assert parsed.records.select("block").distinct().count() > 5
        wrong = indexed.where(F.col("row_idx") != F.get("cells", F.lit(0)).cast("bigint"))
        assert wrong.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


DETECTION = "Flow Duration,Total Length of Fwd Packets,Total Packets,Avg Packet Size"


# Each threshold from both sides: mean bytes and peak rate, packets and packet size, rows and duration.
BYTES = "Total Length of Fwd Packets"
PACKETS = "Total Packets,Avg Packet Size"


@pytest.mark.parametrize("header, rows, attack, confidence, severity, n_rules", [
    (BYTES, ["1000001", "999999"], "DoS", 0.9, "Critical", 1),
    (BYTES, ["999998", "1000001"], "Benign", 0.7, "Low", 0),
    (BYTES + ",Packet Rate", ["5,1000"], "DoS", 0.9, "Critical", 1),
    (BYTES + ",Packet Rate", ["5,999.5"], "Benign", 0.7, "Low", 0),
    (PACKETS, ["20,64", "1,3"], "PortScan", 0.8, "High", 1),
    (PACKETS, ["19,64"], "Benign", 0.7, "Low", 0),
    (PACKETS, ["20,64.5"], "Benign", 0.7, "Low", 0),
    ("Flow Duration", ["1000000"] * 10, "BruteForce", 0.7, "High", 1),
    ("Flow Duration", ["1000000"] * 9, "Benign", 0.7, "Low", 0),
    ("Flow Duration", ["1000001"] * 10, "Benign", 0.7, "Low", 0),
    ("Label,Flow Duration", ["Bot,1", "Bot,2"], "Bot", 0.99, "High", 0),
    ("colour,shape", ["red,round"], "Unknown", 0.3, "Low", 0),
])
def test_detection_of_files(spark, tmp_path, header, rows, attack, confidence, severity, n_rules):
    folder = put(tmp_path, log__csv="\n".join([header, *rows]) + "\n")
    flows, errors = load.load_flows(spark, csv_paths=[folder])
    got = detect.detect(flows).first()
    assert (got["attack_type"], got["confidence"], got["severity"], len(got["matched_rules"])) == \
        (attack, confidence, severity, n_rules)
    assert errors.count() == 0


def capture_row(label, *numbers):
    return ",".join([label, *[str(n) for n in (numbers or (10, 2, 3, 100, 200, 25, 4))]])


def test_captures(spark, tmp_path):
    day1 = [capture_row(c) for c in CLASSES[:4]] + [capture_row("Heartbleed")]
    day2 = [capture_row(c) for c in CLASSES[4:]] + [capture_row("Bot", "1_0", 2, 3, 1, 2, 3, 4)]
    folder = put(tmp_path, day1__csv="\n".join([CAPTURE_HEADER, *day1]),
                 day2__csv="\n".join([CAPTURE_HEADER, *day2]))
    loaded = load.load_training(spark, folder, reader="capture")
    assert loaded.examples.count() == 8
    assert loaded.examples.first()["features"] == [10.0, 300.0, 5.0, 25.0, 4.0]
    indexed = {r["source_id"].rsplit("/", 1)[1]: r["code"] for r in loaded.exclusions.collect()}
    assert indexed == {"day1.csv": "heartbleed_excluded", "day2.csv": "unparsable_value"}


def test_capture_classes_must_be_covered(spark, tmp_path):
    folder = put(tmp_path, day1__csv="\n".join([CAPTURE_HEADER, capture_row("BENIGN")]))
    with pytest.raises(load.LoadRefused, match="PortScan"):
        load.load_training(spark, folder, reader="capture")
    put(tmp_path, notes__txt="x")
    with pytest.raises(load.LoadRefused, match="notes.txt"):
        load.load_training(spark, folder, reader="capture")


def test_generic_training_files(spark, tmp_path):
    head = "Label,Flow Duration,Total Length,Total Packets,Avg Packet Size,Packets Per Second\n"
    folder = put(
        tmp_path, good__csv=head + "BENIGN,10,1000,5,200,1\nDoS Hulk,20,2000,10,200,2\n",
        one__csv=head + "BENIGN,10,1000,5,200,1\n", gap__csv=head + "BENIGN,10,,5,200,1\nDoS,1,1,1,1,1\n",
        odd__csv=head + "BENIGN,1,1,1,1,1\nWorm,1,1,1,1,1\n",
        blank__csv=head + "BENIGN,1,1,1,1,1\n,1,1,1,1,1\n", other__csv="a,b\n1,2\n",
        lines__json='{"label":"benign","duration":1,"bytes":2,"packets":3,"packetsize":4,"packetrate":5}\n'
                    '{"label":"ddos","duration":1,"bytes":2,"packets":3,"packetsize":4,"packetrate":5}\n')
    loaded = load.load_training(spark, folder)
    assert by_source(loaded.examples.groupBy("source_id").count(), "count") == {
        "good.csv": 2, "lines.json": 2}
    problems = {(r["source_id"].rsplit("/", 1)[1], r["problem"]) for r in loaded.errors.collect()}
    assert problems >= {("one.csv", "too_few_classes"), ("gap.csv", "missing_feature"),
                        ("odd.csv", "unknown_label"), ("blank.csv", "unlabelled_row"),
                        ("other.csv", "no_usable_feature")}


def test_listing_and_admission(spark, tmp_path):
    folder = put(tmp_path, a__csv="x\n1\n", b__CSV="x\n1\n", c__json="[]", d__txt="x", e__csv="",
                 f__csv="x" * 200)
    found = listing.list_files(spark, folder)
    assert sorted(r["filename"] for r in found.collect()) == [
        "a.csv", "b.CSV", "c.json", "e.csv", "f.csv"]
    good, bad = listing.admitted(found, max_bytes=100)
    assert {r["filename"]: r["verdict"] for r in bad.collect()} == {
        "e.csv": "empty_file", "f.csv": "too_large"}
    assert listing.list_files(spark, folder + "/absent").count() == 0
    other = listing.other_files(listing.list_files(spark, folder, None))
    assert sorted(r["filename"] for r in other.collect()) == ["c.json", "d.txt"]


def test_label_rendering_from_json(spark, tmp_path):
    folder = put(tmp_path, a__json="\n".join(json.dumps({"label": v, "bytes": 1}) for v in
                                             ["007", True, 1e3, " DoS "]))
    flows, _ = load.load_flows(spark, json_paths=[folder])
    assert [r["label"] for r in flows.orderBy("block", "seq").collect()] == [
        "7", "True", "1000.0", "DoS"]


def test_uploads_are_classified_once_ready(spark, tmp_path):
    folder = put(tmp_path, a__csv=DETECTION + "\n" + "12000,1500000,4,1200\n" * 6,
                 bad__csv="a,a\n1,2\n", c__csv=DETECTION + "\n1,1,1,1\n")
    uploads = spark.createDataFrame(
        [(1, f"{folder}/a.csv", "completed"), (2, f"{folder}/bad.csv", "completed"),
         (3, f"{folder}/gone.csv", "completed"), (4, f"{folder}/c.csv", "processing")],
        "id bigint, file_path string, upload_status string")
    found, others = load.detect_uploads(spark, uploads, csv_paths=[folder])
    got = found.collect()
    assert [(r["upload_id"], r["attack_type"], r["severity"], r["records_analysed"]) for r in got] == [
        (1, "DoS", "Critical", 6)]
    assert {r["upload_id"]: r["problem"] for r in others.collect()} == {
        2: "duplicate_column_name", 3: "file_unavailable", 4: "not_ready_processing"}


def test_preview(spark, tmp_path):
    folder = put(tmp_path, a__csv="x,y\n" + "\n".join(f"{i},{i}.5" for i in range(9)) + "\n")
    columns, rows = profile.preview(records.to_long(csvlog.read(spark, folder).records))
    assert {r["col_name"]: (r["value_type"], r["null_count"], r["n_rows"]) for r in columns.collect()} == {
        "x": ("integer", 0, 9), "y": ("float", 0, 9)}
    assert sorted(r["raw"] for r in rows.where("col_name = 'x'").collect()) == ["0", "1", "2", "3", "4"]


def test_ever_new_json_keys_do_not_change_the_mapping(spark, tmp_path):
    rows = [json.dumps({f"noise{i}": i, f"total bytes {i % 3}": i}) for i in range(40)]
    rows.append(json.dumps({"Flow Bytes total": 1, "Attack Type": "DoS", "Duration": 3}))
    folder = put(tmp_path, a__json="\n".join(rows))
    parsed = jsonlog.read(spark, folder)
    assert len(parsed.layouts.first()["names"]) <= 12
    flows = records.to_flows(parsed)
    assert flows.where("label = 'DoS' AND flow_duration = 3 AND total_bytes = 1").count() == 1


def test_held_tables_are_let_go_with_their_block(spark):
    outside = records.keep(spark.range(3))
    with records.holding():
        inside = records.keep(spark.range(4))
        with records.holding():
            deeper = records.keep(spark.range(5))
        assert inside.is_cached and not deeper.is_cached
    assert outside.is_cached and not inside.is_cached
    outside.unpersist()


def test_texts_are_parsed_once_and_stored(spark, tmp_path, monkeypatch):
    """Later passes read parsed rows; places of plain files take no shuffle of the rows."""
    folder = put(tmp_path, a__csv="n,t\n0,x\n1,y\n", b__csv='n,t\n0,"two\nlines"\n1,z\n', c__json='[{"n":0},{"n":1}]')
    with records.holding():
        csv = csvlog.read(spark, f"{folder}/*.csv")
        arrays = jsonlog.read(spark, f"{folder}/*.json")
        for parsed in (csv, arrays):
            assert all(f.endswith(".parquet") for f in parsed.records.inputFiles())
        index = {(r["source_id"][-5:], r["cells"][0]): r["row_idx"] for r in records.with_row_index(csv.records).collect()}
        assert index == {("a.csv", "0"): 0, ("a.csv", "1"): 1, ("b.csv", "0"): 0, ("b.csv", "1"): 1}
        monkeypatch.setattr(records.F, "row_number", None)
        plain = csvlog.read(spark, f"{folder}/a.csv")
        assert records.with_row_index(plain.records).count() == 2 and arrays.records.count() == 2


def test_kind_of_each_json_value_is_found_once(spark):
    rows = spark.createDataFrame([('[1, 1.0, 2.50, "x", null, {"z": 1, "y": [1, 2]}, [], true, 1e3]',)], "text string")
    out = rows.select(jsonlog.values_text(F.from_json("text", "array<variant>")).alias("cells"))
    assert out.first()["cells"] == ["1", "1.0", "2.5", "x", None, '{"y":[1,2],"z":1}', "[]", "true", "1000.0"]
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("schema_of_variant") == 1
