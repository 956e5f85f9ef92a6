"""Dashboards, model metrics and feature selection."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard import vocab
from flowguard.functions import labels
from flowguard.operators.prefix import running_totals


def is_threat(attack_type: Column) -> Column:
    return ~attack_type.isin(vocab.BENIGN, vocab.UNKNOWN)


def daily_summary(predictions: DataFrame) -> DataFrame:
    """Per day: findings, threats, critical threats, benign ones, detection rate."""
    threat = is_threat(F.col("attack_type"))
    return (predictions.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("n_findings"), F.count_if(threat).alias("n_threats"),
        F.count_if(threat & (F.col("severity") == "Critical")).alias("n_critical"),
        F.count_if(F.col("attack_type") == vocab.BENIGN).alias("n_benign"))
        .withColumn("detection_rate", F.col("n_threats") / F.col("n_findings")))


def timeline(predictions: DataFrame, width: str = "7 days") -> DataFrame:
    return (predictions.groupBy(F.window("created_at", width).alias("w"), "attack_type")
            .agg(F.count(F.lit(1)).alias("n_findings"))
            .select(F.col("w.start").alias("window_start"), "attack_type", "n_findings"))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))


def top(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent values; the name breaks ties."""
    return distribution(rows, column).orderBy(F.desc("n_rows"), column).limit(k)


def confidence_histogram(predictions: DataFrame) -> DataFrame:
    """Findings per tenth of confidence; 1.0 falls into the last, invalid ones are apart."""
    conf = F.col("confidence")
    tenth = F.when(conf.between(0, 1), F.least(F.floor(conf * 10), F.lit(9))).otherwise(-1)
    return (predictions.groupBy(tenth.cast("int").alias("tenth"))
            .agg(F.count(F.lit(1)).alias("n_findings")))


def latest(rows: DataFrame, time: str, tie: str, k: int) -> DataFrame:
    return rows.orderBy(F.desc(time), F.desc(tie)).limit(k)


def with_techniques(predictions: DataFrame) -> DataFrame:
    """Attach the public technique id and name of each class."""
    table = {k: f"{i}|{n}" for k, (i, n) in vocab.TECHNIQUES.items()}
    found = F.split(labels.lookup(table, F.col("attack_type")), r"\|")
    return (predictions.withColumn("technique_id", F.get(found, F.lit(0)))
            .withColumn("technique", F.get(found, F.lit(1))))


# --- model metrics ---------------------------------------------------------

def confusion(scored: DataFrame, actual: str = "label_code", predicted: str = "predicted_code"):
    return scored.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n_rows"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class out of a confusion matrix."""
    side = F.array(
        F.struct(F.col("label_code").alias("code"), F.col("n_rows").alias("actual"),
                 F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("label_code") == F.col("predicted_code"), F.col("n_rows"))
                 .otherwise(0).alias("hit")),
        F.struct(F.col("predicted_code").alias("code"), F.lit(0).cast("bigint").alias("actual"),
                 F.col("n_rows").alias("predicted"), F.lit(0).cast("bigint").alias("hit")))
    sums = matrix.select(F.inline(side)).groupBy("code").agg(
        F.sum("actual").alias("n_actual"), F.sum("predicted").alias("n_predicted"),
        F.sum("hit").alias("n_hit"))

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = (sums.withColumn("precision", ratio(F.col("n_hit"), F.col("n_predicted")))
           .withColumn("recall", ratio(F.col("n_hit"), F.col("n_actual"))))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both)).withColumn(
        "label", labels.class_of_code(F.col("code")))


def overall_metrics(metrics: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted averages; one row."""
    weight = F.sum("n_actual")
    return metrics.agg(
        weight.alias("n_rows"), (F.sum("n_hit") / weight).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[(F.sum(F.col(m) * F.col("n_actual")) / weight).alias(f"weighted_{m}")
          for m in ("precision", "recall", "f1")])


def roc_auc(scored: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """Exact area under the curve per class, ties counted half.

    Rows are first counted per distinct score; the running total over scores is
    summed range by range, so no task sorts all scores of a class.
    """
    counts = scored.groupBy("class_code", score).agg(
        F.count_if(F.col(positive)).alias("pos"), F.count_if(~F.col(positive)).alias("neg"))
    total = running_totals(counts, ["class_code"], score, ["neg"])
    wins = F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)
    return total.groupBy("class_code").agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(wins).alias("wins")) \
        .select("class_code", "n_pos", "n_neg",
                F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                       F.col("wins") / F.col("n_pos") / F.col("n_neg")).alias("auc"))


# --- feature selection -----------------------------------------------------

def variances(flows: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Variance of each feature and whether it is above the threshold; one pass."""
    row = flows.agg(*[F.var_pop(f).alias(f) for f in vocab.FEATURES])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("variance"))
                      for f in vocab.FEATURES])
    return row.select(F.inline(pairs)).withColumn("keep", F.col("variance") > threshold)


def correlations(flows: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Correlation of every feature pair; ten pairs, one pass."""
    pairs = list(combinations(vocab.FEATURES, 2))
    row = flows.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    listed = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                                F.col(f"c{i}").alias("correlation"))
                       for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(listed)).withColumn(
        "redundant", F.coalesce(F.abs("correlation") >= threshold, F.lit(False)))


def mutual_information(flows: DataFrame, bins: int = 10) -> DataFrame:
    """Mutual information of each binned feature and the label, in nats.

    Ranges come from one aggregate (a single row on the driver); then at most
    bins x classes counts per feature leave the map side.
    """
    spans = flows.agg(*[F.min(f).alias(f"lo_{f}") for f in vocab.FEATURES],
                      *[F.max(f).alias(f"hi_{f}") for f in vocab.FEATURES]).first()

    def binned(f):
        lo, hi = spans[f"lo_{f}"], spans[f"hi_{f}"]
        if lo is None or hi == lo:
            return F.when(F.col(f).isNotNull(), F.lit(0))
        # least() skips nulls, so a missing value has to be kept out by hand.
        place = F.floor((F.col(f) - lo) / (hi - lo) * bins)
        return F.when(place.isNotNull(), F.least(place, F.lit(bins - 1))).cast("int")
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), binned(f).alias("bin"))
                      for f in vocab.FEATURES])
    classed = flows.where(F.col("label").isNotNull()).select(
        labels.label_class(F.col("label")).alias("klass"), F.inline(cells))
    joint = classed.where(F.col("bin").isNotNull()).groupBy("feature", "bin", "klass").agg(
        F.count(F.lit(1)).alias("n"))
    # I = ln N + (sum n ln n - sum nx ln nx - sum ny ln ny) / N
    def part(counts, name):
        return counts.groupBy("feature").agg(
            F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias(name))
    total = joint.groupBy("feature").agg(F.sum("n").alias("nt"))
    by_bin = joint.groupBy("feature", "bin").agg(F.sum("n").alias("n"))
    by_class = joint.groupBy("feature", "klass").agg(F.sum("n").alias("n"))
    out = (total.join(part(joint, "xy"), "feature").join(part(by_bin, "x"), "feature")
           .join(part(by_class, "y"), "feature"))
    return out.select("feature", (F.log(F.col("nt").cast("double"))
                                  + (F.col("xy") - F.col("x") - F.col("y")) / F.col("nt"))
                      .alias("information"))


def standardized(flows: DataFrame) -> DataFrame:
    """Features with mean 0 and deviation 1; a constant feature becomes 0."""
    stats = flows.agg(*[F.avg(f).alias(f"m_{f}") for f in vocab.FEATURES],
                      *[F.stddev_pop(f).alias(f"s_{f}") for f in vocab.FEATURES]).first()
    out = flows
    for f in vocab.FEATURES:
        mean, dev = stats[f"m_{f}"], stats[f"s_{f}"]
        scaled = (F.col(f) - mean) / dev if dev else F.when(F.col(f).isNotNull(), F.lit(0.0))
        out = out.withColumn(f, scaled)
    return out


def deduplicated(flows: DataFrame) -> DataFrame:
    """Rows that differ in source, features or label; the lowest row key stays."""
    keys = ["source_id", *vocab.FEATURES, "label"]
    return flows.groupBy(*keys).agg(F.min("row_key").alias("row_key"),
                                    F.count(F.lit(1)).alias("n_copies"))


def split(examples: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training, validation and test part (70/10/20), decided by the row key alone."""
    point = F.pmod(F.xxhash64(F.lit(seed), F.col("row_key")), F.lit(1000))
    return (examples.where(point < 700), examples.where(point.between(700, 799)),
            examples.where(point >= 800))
