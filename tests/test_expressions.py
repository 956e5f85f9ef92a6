"""Cells, labels, scores and small texts against stated results."""

import math

import pytest
from pyspark.sql import functions as F

from flowguard import vocab
from flowguard.functions import cells, labels, scoring, text
from flowguard.operators import headers


def evaluate(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["r"] for r in rows.withColumn("r", make(F.col("v"))).orderBy("i").collect()]


CELLS = [
    (None, "null", None, None), ("", "null", None, None), ("   ", "null", None, None),
    ("42", "integer", "42", 42.0), ("-42", "integer", "-42", -42.0), ("+42", "integer", "42", 42.0),
    ("007", "integer", "7", 7.0), ("-0", "integer", "0", 0.0), ("3.5", "float", "3.5", 3.5),
    ("-0.5", "float", "-0.5", -0.5), (".5", "float", "0.5", 0.5), ("1e3", "float", "1000.0", 1000.0),
    ("2.5E-2", "float", "0.025", 0.025), ("5.", "float", "5.0", 5.0), ("true", "boolean", "True", None),
    ("TRUE", "boolean", "True", None), ("False", "boolean", "False", None),
    ("1_0", "string", "1_0", None), ("nan", "string", "nan", None), ("-inf", "string", "-inf", None),
    ("0x1f", "string", "0x1f", None), ("0x1p3", "string", "0x1p3", None),
    ("12,5", "string", "12,5", None), ("10.0.0.1", "string", "10.0.0.1", None),
    ("1d", "string", "1d", None), ("1e999", "string", "1e999", None), ("\t7 ", "integer", "7", 7.0),
    ("　4.5\n", "float", "4.5", 4.5), ("\x014", "string", "\x014", None),
    ("1e16", "float", "1e+16", 1e16), ("123456789.5", "float", "123456789.5", 123456789.5),
    ("1e-4", "float", "0.0001", 1e-4), ("1.5e-5", "float", "1.5e-05", 1.5e-5),
    ("1e15", "float", "1000000000000000.0", 1e15), (" benign ", "string", "benign", None),
]


def test_coercion(spark):
    got = evaluate(spark, [c[0] for c in CELLS], cells.coerce)
    for (raw, kind, shown, number), r in zip(CELLS, got):
        assert (r["kind"], r["text"], r["number"]) == (kind, shown, number), repr(raw)


def test_numbers(spark):
    raw = ["1_0", "1__0", "_1", "1_", "nan", "true", " 7 ", "1e999", "\t8\t", "1_000.5e1_0", "0x1p3"]
    assert evaluate(spark, raw, cells.to_number) == [
        10.0, None, None, None, None, None, 7.0, None, 8.0, 1000.5e10, None]
    assert evaluate(spark, raw, lambda c: cells.to_number(c, strict=True))[0] is None


@pytest.mark.parametrize("name", ["shortest", "long"])
def test_float_text_reads_back(spark, name):
    values = ([0.1, 1e7, 12345678.9, 1e22, 5e-324, 1.7976931348623157e308, 9999999.0, 1e-3, 0.00099]
              if name == "shortest" else [math.pi * 10 ** k for k in range(-12, 20)])
    for v, r in zip(values, evaluate(spark, values, cells.float_text, "double")):
        assert float(r) == v
        assert ("e" in r) == ("e" in repr(v))


def test_column_types(spark):
    def combined(kinds):
        flags = [F.lit(k in kinds) for k in ("boolean", "integer", "float", "string")]
        return spark.range(1).select(cells.column_type(*flags).alias("r")).first()["r"]
    assert [combined(k) for k in (["integer"], ["integer", "float"], ["boolean"], ["string"], [],
                                  ["integer", "string"], ["boolean", "integer"])] == [
        "integer", "float", "boolean", "string", "null", "mixed", "mixed"]


def test_generic_labels(spark):
    raw = ["BENIGN", "DoS Hulk", "dos-hulk", "PortScan DDoS", "the botnet", "Worm", "", None,
           "Web Attack - Brute Force", "brute  force", "--", "Web Attack - XSS"]
    assert evaluate(spark, raw, labels.label_class) == [
        "Benign", "DoS", "DoS", "Unknown", "Bot", "Unknown", "Unknown", None, "Unknown",
        "BruteForce", "Unknown", "WebAttack"]


def test_capture_labels(spark):
    raw = [*vocab.CAPTURE_LABELS, "Web Attack – Brute Force", "DoS  Hulk", "Heart-bleed", "", None,
           "novel"]

    def make(c):
        key = labels.normalize_capture_label(c)
        klass = labels.capture_class(key)
        return F.coalesce(klass, labels.capture_label_code(key, klass))
    got = evaluate(spark, raw, make)
    n = len(vocab.CAPTURE_LABELS)
    assert got[:n] == list(vocab.CAPTURE_LABELS.values())
    assert got[n:] == ["BruteForce", "DoS", "heartbleed_excluded", "missing_label", "missing_label",
                       "unknown_label"]


def test_codes_round_trip(spark):
    codes = evaluate(spark, vocab.ATTACK_TYPES, labels.class_code)
    assert codes == [0, 1, 2, 3, 4, 5, 6, 7, None]
    assert evaluate(spark, [-1, 0, 7, 8], labels.class_of_code, "int") == [
        None, "Benign", "Infiltration", None]


def test_confidence_and_severity(spark):
    weights = [[], [0.7], [0.9, 0.8], [0.9, 0.8, 0.7], [0.9, 0.9, 0.9, 0.9], [1.0, 0.7]]
    assert evaluate(spark, weights, scoring.combined_confidence, "array<double>") == [
        0.0, 0.7, 0.95, 1.0, 1.0, 1.0]
    with pytest.raises(Exception, match="outside 0..1"):
        evaluate(spark, [[1.5]], scoring.combined_confidence, "array<double>")

    def at(level):
        return evaluate(spark, vocab.ATTACK_TYPES, lambda c: scoring.severity(c, F.lit(level)))
    assert at(0.5) == [vocab.SEVERITY_OF[c] for c in vocab.ATTACK_TYPES]
    assert at(0.49) == ["Low", "High", "High", "Medium", "Medium", "Medium", "Low", "Low", "Low"]
    assert at(1.1) == [None] * 9


def test_percent_is_half_even(spark):
    assert evaluate(spark, [0.125, 0.975, 0.985, 0.95, 0.0, 1.0], scoring.whole_percent, "double") == [
        12, 98, 98, 95, 0, 100]


def test_guidance_covers_every_class(spark):
    got = evaluate(spark, [*vocab.ATTACK_TYPES, "odd"], lambda c: scoring.guidance(c, F.lit("High")))
    assert all(g[0] == "Page the duty officer (severity High)." for g in got[:-1])
    assert got[-1] is None


def test_filenames(spark):
    raw = ["a.csv", " ", "x" * 256, "..", "a/b.csv", "a\\b", "a\x07b", "a\x00b"]
    assert evaluate(spark, raw, text.filename_problem) == [
        None, "empty", "too_long", "directory", "separator", "separator", "control_character",
        "separator"]
    assert evaluate(spark, ["x/A.CSV", "b.json", "c.jsonl", "d", ".csv"], text.log_format) == [
        "csv", "json", None, None, None]


def test_masks_and_emails(spark):
    assert evaluate(spark, ["short", "12345678", "123456789"], text.mask) == [
        "********", "********", "1234****6789"]
    assert evaluate(spark, [" Alice@Example.com", "a@b", "a@b.c", "a@-b.c", None], text.email_ok) == [
        True, False, True, False, False]


def test_client_keys(spark):
    rows = [(" 1.1.1.1 , 2.2.2.2", "3.3.3.3", "4"), ("", "3.3.3.3", "4"), (None, " ", "4"),
            (None, None, None), (" , 2", "3", "4")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, f string, r string, p string")
    got = frame.orderBy("i").select(text.client_key(F.col("f"), F.col("r"), F.col("p")).alias("k"))
    assert [r["k"] for r in got.collect()] == ["1.1.1.1", "3.3.3.3", "4", "unknown", "unknown"]


def test_header_mapping(spark):
    def mapping(names):
        return evaluate(spark, [names], headers.map_columns, "array<string>")[0]
    assert mapping(["Label", "Flow Duration", "Total Length of Fwd Packets", "Packets"]) == {
        "label": "Label", "flow_duration": "Flow Duration",
        "total_bytes": "Total Length of Fwd Packets", "total_packets": "Packets"}
    assert mapping(["Total Length of Bwd Packets", "bytes"]) == {"total_bytes": "bytes"}
    assert mapping(["Average Packet Size", "Flow Packets/s"]) == {}
    assert mapping(["class", "label"]) == {"label": "class"}
    assert mapping(["Flow Packets per Second", "Some Flow Duration us"]) == {
        "packet_rate": "Flow Packets per Second", "flow_duration": "Some Flow Duration us"}


def test_capture_header_containment(spark):
    names = ["Total Length of Fwd Packets", "Flow Duration "]
    got = evaluate(spark, [names], headers.capture_columns, "array<string>")[0]
    assert got["flow_duration"] == "Flow Duration "
    assert got["fwd_packets"] == got["fwd_bytes"] == "Total Length of Fwd Packets"


def test_delimiters(spark):
    assert evaluate(spark, ["a,b;c", "a;b;c,d", "a\tb", "a|b|c,d", "a", "a;b,c"], headers.delimiter) == [
        ",", ";", "\t", "|", ",", ","]


def test_storage_names_and_splits(spark):
    from flowguard.operators import analytics
    names = [r["n"] for r in spark.range(50).select(text.storage_name(".csv").alias("n")).collect()]
    assert len(set(names)) == 50 and all(len(n) == 36 and n.endswith(".csv") for n in names)
    rows = spark.range(4000).select(F.col("id").cast("string").alias("row_key"))
    parts = [p.count() for p in analytics.split(rows)]
    assert sum(parts) == 4000 and 2600 < parts[0] < 3000 and 300 < parts[1] < 500
