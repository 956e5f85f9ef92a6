"""Labelled capture rows to training examples, with a reason for every row left out.

The whole conversion is one projection: no shuffle, no Python. Stages are kept
as separate projections so that each trimmed text, number and reason is worked
out once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard import vocab
from flowguard.functions import cells, labels

REASON_TEXT = {
    vocab.MISSING_LABEL: "the label is blank",
    vocab.HEARTBLEED: "label %s is Heartbleed, which no class covers",
    vocab.UNKNOWN_LABEL: "label %s names no class",
    vocab.MISSING_VALUE: "%s is blank",
    vocab.UNPARSABLE_VALUE: "%s holds %s, which is no number",
    vocab.NON_FINITE_VALUE: "%s holds %s, which is not finite",
    vocab.NON_FINITE_DERIVED: "the summed bytes or packets are not finite",
}


_RESULT = (*vocab.FEATURES, "attack_type", "code", "bad_name", "bad_text")


def convert(rows: DataFrame) -> DataFrame:
    """Add class, features and, for unusable rows, a code to raw text rows.

    ``code`` is null for a usable row. The label is checked first, then the
    measurements in their fixed order, then the sums; the first problem counts.
    ``bad_name`` and ``bad_text`` name the offending cell.
    """
    names = vocab.CAPTURE_MEASUREMENTS
    keep = [c for c in rows.columns if c not in names and c != "label"]
    staged = rows.select(
        *keep, F.trim(F.col("label")).alias("_label"),
        labels.normalize_capture_label(F.col("label")).alias("_key"),
        *[F.col(n).alias(f"_r_{n}") for n in names],
        *[cells.plain_number(F.col(n)).alias(f"_v_{n}") for n in names])
    clean = F.lit(True)
    for n in names:
        clean = clean & F.coalesce(cells.is_finite(F.col(f"_v_{n}")), F.lit(False))
    # Only rows with a cell that is no plain number take the long way.
    staged = staged.select(
        *keep, "_label", "_key", labels.capture_class(F.col("_key")).alias("_class"),
        *[f"_v_{n}" for n in names],
        F.when(~clean, _measure_all([F.col(f"_r_{n}") for n in names])).alias("_m"))

    def value(name):
        return F.coalesce(F.col(f"_v_{name}"), F.get("_m", F.lit(names.index(name)))["value"])

    staged = staged.select(
        *keep, "_class", "_m", _problem(
            labels.capture_label_code(F.col("_key"), F.col("_class")), F.lit("label"),
            F.col("_label")).alias("_label_problem"),
        value("flow_duration").alias("_duration"),
        (value("fwd_bytes") + value("bwd_bytes")).alias("_bytes"),
        (value("fwd_packets") + value("bwd_packets")).alias("_packets"),
        value("avg_packet_size").alias("_size"), value("packet_rate").alias("_rate"))
    first_bad = F.get(F.filter("_m", lambda m: m["problem"]["code"].isNotNull()),
                      F.lit(0))["problem"]
    derived = F.when(
        ~(cells.is_finite(F.col("_bytes")) & cells.is_finite(F.col("_packets"))),
        _problem(F.lit(vocab.NON_FINITE_DERIVED), F.lit("total_bytes"), F.lit("")))
    bad = F.coalesce(F.when(F.col("_label_problem.code").isNotNull(), F.col("_label_problem")),
                     first_bad, derived)
    result = F.struct(
        F.col("_class").alias("attack_type"), F.col("_duration").alias("flow_duration"),
        F.col("_bytes").alias("total_bytes"), F.col("_packets").alias("total_packets"),
        F.col("_size").alias("avg_packet_size"), F.col("_rate").alias("packet_rate"),
        bad.alias("bad"))
    # Unpacking through inline keeps later filters on the code above this point;
    # pushed below it, they would evaluate the whole conversion a second time.
    return staged.select(*keep, F.inline(F.array(result))).select(
        *keep, "attack_type", *vocab.FEATURES, F.col("bad.code").alias("code"),
        F.col("bad.name").alias("bad_name"), F.col("bad.text").alias("bad_text"))


def _measure_all(raw: list[Column]) -> Column:
    """Array with value and problem of each measurement, in their fixed order."""
    names = F.array(*[F.lit(n) for n in vocab.CAPTURE_MEASUREMENTS])
    texts = F.transform(F.array(*raw), cells.strip_bound)
    numbers = F.transform(texts, lambda t: F.struct(
        t.alias("t"), cells.parsed_number(t).alias("v")))
    return F.transform(numbers, lambda m, i: F.struct(
        m["v"].alias("value"), _problem(cells.measurement_code(m["t"], m["v"]),
                                        F.get(names, i), m["t"]).alias("problem")))


def _problem(code: Column, name: Column, text: Column) -> Column:
    return F.struct(code.alias("code"), name.alias("name"), text.alias("text"))


def reason_text() -> Column:
    """Sentence for a row left out."""
    code, name, text = F.col("code"), F.col("bad_name"), F.col("bad_text")
    shown = {vocab.HEARTBLEED: [text], vocab.UNKNOWN_LABEL: [text], vocab.MISSING_VALUE: [name],
             vocab.UNPARSABLE_VALUE: [name, text], vocab.NON_FINITE_VALUE: [name, text]}
    out = F.lit(None).cast("string")
    for key, pattern in reversed(list(REASON_TEXT.items())):
        args = shown.get(key)
        out = F.when(code == key, F.format_string(pattern, *args) if args
                     else F.lit(pattern)).otherwise(out)
    return out


def examples(converted: DataFrame) -> DataFrame:
    """Usable rows: five single-precision features, class and label code."""
    keep = [c for c in converted.columns if c not in _RESULT]
    return converted.where(F.col("code").isNull()).select(
        *keep, F.array(*[F.col(f).cast("float") for f in vocab.FEATURES]).alias("features"),
        F.col("attack_type").alias("label"),
        labels.class_code(F.col("attack_type")).alias("label_code"))


def exclusions(converted: DataFrame) -> DataFrame:
    """Rows left out, with code and reason."""
    keep = [c for c in converted.columns if c not in _RESULT]
    return converted.where(F.col("code").isNotNull()).select(
        *keep, "code", reason_text().alias("reason"))


def exclusion_counts(excluded: DataFrame, *keys: str) -> DataFrame:
    return excluded.groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("n_rows"))


def reconcile(converted: DataFrame) -> DataFrame:
    """Per source: rows seen, used and left out, and whether they add up."""
    out = converted.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("rows_seen"),
        F.count_if(F.col("code").isNull()).alias("rows_used"),
        *[F.count_if(F.col("code") == c).alias(c) for c in vocab.EXCLUSION_CODES])
    excluded = sum((F.col(c) for c in vocab.EXCLUSION_CODES), F.lit(0).cast("bigint"))
    return (out.withColumn("rows_excluded", excluded)
            .withColumn("adds_up", F.col("rows_seen") == F.col("rows_used")
                        + F.col("rows_excluded")))
