"""Training sets: checks, class coverage, completeness, combination.

Checks are one aggregate over all rows, so a gate costs one pass and returns one
row however large the set is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard import vocab
from flowguard.functions import cells, labels


class DatasetRefused(ValueError):
    """A training set that must not be used as it is."""


def missing_features(columns=vocab.FEATURES) -> Column:
    """Names of the features a row lacks, in order."""
    return F.filter(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in columns]),
                    lambda c: c.isNotNull())


def feature_vector(columns=vocab.FEATURES) -> Column:
    """Dense vector of the features; a gap is an error, never filled in."""
    gaps = missing_features(columns)
    return F.when(F.size(gaps) == 0, F.array(*[F.col(f).cast("float") for f in columns])) \
            .otherwise(F.raise_error(F.concat(F.lit("missing features: "),
                                              F.array_join(gaps, ", ")))
                       .cast("array<float>"))


def assert_feature_order(given: list[str]) -> None:
    """Tell a reordered feature list from an unknown one."""
    if list(given) == vocab.FEATURES:
        return
    if sorted(given) == sorted(vocab.FEATURES):
        raise DatasetRefused(f"features are in another order: {list(given)}")
    raise DatasetRefused(f"features differ: {list(given)}")


def feature_coverage(flows: DataFrame, *keys: str) -> DataFrame:
    """Rows that carry each feature."""
    return flows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count(f).alias(f"n_{f}") for f in vocab.FEATURES])


def class_counts(examples: DataFrame, *keys: str) -> DataFrame:
    return examples.groupBy(*keys, "label_code").agg(
        F.count(F.lit(1)).alias("n_rows")).withColumn(
            "label", labels.class_of_code(F.col("label_code")))


def missing_classes(examples: DataFrame, *keys: str) -> DataFrame:
    """Classes without a row, per key; at most eight codes are held per key."""
    every = F.array(*[F.lit(n) for n in vocab.TRAINABLE])
    present = F.transform(F.collect_set("label_code"), labels.class_of_code)
    return (examples.groupBy(*keys).agg(F.array_except(every, present).alias("gaps"))
            .select(*keys, F.explode("gaps").alias("missing_class")))


def classes_present(examples: DataFrame, *keys: str) -> DataFrame:
    """Classes with rows, in code order."""
    codes = F.array_sort(F.collect_set("label_code"))
    return examples.groupBy(*keys).agg(
        F.transform(codes, labels.class_of_code).alias("classes"))


def violations(examples: DataFrame, row_column: str = "row_key") -> DataFrame:
    """One row: how often each rule of a valid set is broken, and first offenders."""
    width = F.size("features") != len(vocab.FEATURES)
    finite = F.exists("features", lambda x: ~F.coalesce(
        cells.is_finite(x.cast("float")), F.lit(False)))
    code = ~F.coalesce(F.col("label_code").between(0, len(vocab.TRAINABLE) - 1), F.lit(False))
    return examples.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(width).alias("wrong_width"),
        F.count_if(finite).alias("not_finite"),
        F.count_if(code).alias("bad_code"),
        F.min(F.when(width, F.col(row_column))).alias("first_wrong_width"),
        F.min(F.when(finite, F.col(row_column))).alias("first_not_finite"),
        F.min(F.when(code, F.col(row_column))).alias("first_bad_code"),
        F.count_distinct("label_code").alias("n_classes"))


@dataclass
class Completeness:
    """Whether a set holds every row of its sources, and if not, why."""

    complete: bool = True
    truncated: list[str] = field(default_factory=list)
    reasons: list[str] = field(default_factory=list)

    @staticmethod
    def merge(parts: list["Completeness"]) -> "Completeness":
        return Completeness(
            all(p.complete for p in parts),
            list(dict.fromkeys(x for p in parts for x in p.truncated)),
            list(dict.fromkeys(x for p in parts for x in p.reasons)))


def source_completeness(converted: DataFrame) -> DataFrame:
    """Per source of converted captures: rows read, rows usable, and whether any was left out."""
    counts = converted.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("rows_in_source"),
        F.count_if(F.col("code").isNull()).alias("rows_kept"))
    return counts.withColumn("truncated", F.col("rows_kept") < F.col("rows_in_source"))


def merged_completeness(per_source: DataFrame) -> DataFrame:
    """One row for the whole set; the truncated sources stay rows of their own."""
    return per_source.agg(
        F.coalesce(F.bool_and(~F.col("truncated")), F.lit(True)).alias("complete"),
        F.count_if(F.col("truncated")).alias("n_truncated"),
        F.min(F.when(F.col("truncated"), F.col("source_id"))).alias("first_truncated"))


def require_complete(completeness: Completeness | None, allow_incomplete: bool = False) -> None:
    """Refuse a set that lacks rows, or of which nothing says that it lacks none."""
    if allow_incomplete:
        return
    if completeness is None:
        raise DatasetRefused("nothing says whether the set is complete")
    if not completeness.complete:
        raise DatasetRefused("the set lacks rows of its sources: "
                             + "; ".join(completeness.reasons or completeness.truncated))


def validate(examples: DataFrame, min_classes: int = 2,
             feature_order: list[str] | None = None, row_column: str = "row_key") -> dict:
    """Refuse a set that breaks a rule; return the aggregate otherwise."""
    assert_feature_order(feature_order or vocab.FEATURES)
    row = violations(examples, row_column).first().asDict()
    if not row["n_rows"]:
        raise DatasetRefused("the set is empty")
    for name in ("wrong_width", "not_finite", "bad_code"):
        if row[name]:
            raise DatasetRefused(f"{row[name]} row(s) with {name}, first {row['first_' + name]}")
    if row["n_classes"] < min_classes:
        raise DatasetRefused(f"{row['n_classes']} class(es), at least {min_classes} needed")
    return row


def sources_below_coverage(examples: DataFrame, min_classes: int = 2) -> DataFrame:
    """Sources with too few classes, for readers that check every source alone."""
    return (examples.groupBy("source_id")
            .agg(F.count_distinct("label_code").alias("n_classes"))
            .where(F.col("n_classes") < min_classes))


def combine(parts: list[DataFrame]) -> DataFrame:
    """All parts as one set; the columns must agree."""
    if not parts:
        raise DatasetRefused("nothing to combine")
    first = parts[0]
    for part in parts[1:]:
        if part.columns != first.columns:
            raise DatasetRefused(f"columns differ: {part.columns} against {first.columns}")
    out = first
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def build_examples(flows: DataFrame, require_labels: bool = True) -> tuple[DataFrame, DataFrame]:
    """Generic flow rows to examples, and the problems that refuse a source.

    Unlike captures, a bad row refuses its whole source here: an unlabelled row
    (unless those are skipped), a label without a trainable class, or a gap.
    """
    klass = labels.label_class(F.col("label"))
    staged = (flows.withColumn("attack_type", klass)
              .withColumn("label_code", labels.class_code(F.col("attack_type")))
              .withColumn("gaps", F.size(missing_features())))
    if not require_labels:
        staged = staged.where(F.col("label").isNotNull())
    problem = (F.when(F.col("label").isNull(), F.lit("unlabelled_row"))
               .when(F.col("label_code").isNull(), F.lit("unknown_label"))
               .when(F.col("gaps") > 0, F.lit("missing_feature")))
    staged = staged.withColumn("problem", problem)
    problems = (staged.where(F.col("problem").isNotNull()).groupBy("source_id", "problem")
                .agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_key").alias("first_row")))
    refused = problems.select("source_id").distinct()
    good = staged.join(refused, "source_id", "left_anti").select(
        "source_id", "row_key",
        F.array(*[F.col(f).cast("float") for f in vocab.FEATURES]).alias("features"),
        F.col("attack_type").alias("label"), "label_code")
    return good, problems


def describe(examples: DataFrame) -> DataFrame:
    """One row: rows, features in order, and a map from class to its rows."""
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n_rows"))))
    return class_counts(examples).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0).cast("bigint")).alias("n_rows"),
        F.array(*[F.lit(f) for f in vocab.FEATURES]).alias("features"), counts.alias("rows_by_class"))
