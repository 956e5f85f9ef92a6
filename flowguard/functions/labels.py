"""Class labels: normal form, class, code."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowguard import vocab

# Runs of dashes, underscores and blanks. The look-ahead drops ordinary ASCII
# characters after one range check.
LABEL_GAPS = (r"(?:(?=[^!-,.-^`-~])[-_\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2013\u2014"
              r"\u2028\u2029\u202f\u205f\u3000])+")


def _sql(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def literal_map(entries: dict) -> Column:
    """A small fixed table as one literal."""
    return F.expr("map(" + ", ".join(_sql(v) for v in chain.from_iterable(entries.items())) + ")")


def lookup(entries: dict, key: Column) -> Column:
    return F.try_element_at(literal_map(entries), key)


def normalize_header(name: Column) -> Column:
    """Lower-case letters and digits of a header, nothing else."""
    return F.regexp_replace(F.lower(name), "[^0-9a-z]+", "")


def normalize_label(label: Column) -> Column:
    """Lower-case words of a label with single spaces between them."""
    return F.trim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", " "))


def label_class(label: Column) -> Column:
    """Class a label names: whole label first, else its words if they agree."""
    key = normalize_label(label)
    words = F.array_distinct(F.filter(
        F.transform(F.split(key, " "), lambda w: lookup(vocab.GENERIC_LABELS, w)),
        lambda c: c.isNotNull()))
    by_words = F.when(F.size(words) == 1, F.get(words, F.lit(0)))
    return F.when(label.isNotNull(),
                  F.coalesce(lookup(vocab.GENERIC_LABELS, key), by_words,
                             F.lit(vocab.UNKNOWN)))


def class_rank(name: Column) -> Column:
    """Position of a class in declaration order; ``Unknown`` comes last."""
    return lookup({n: i for i, n in enumerate(vocab.ATTACK_TYPES)}, name)


def class_code(name: Column) -> Column:
    """Label code of a trainable class, null for anything else."""
    return lookup(vocab.CODE_OF, name).cast("tinyint")


def class_of_code(code: Column) -> Column:
    """Class of a label code, null when the code is out of range."""
    names = F.array(*[F.lit(n) for n in vocab.TRAINABLE])
    return F.when(code.between(0, len(vocab.TRAINABLE) - 1),
                  F.get(names, code.cast("int")))


def normalize_capture_label(label: Column) -> Column:
    """Capture label with dashes, underscores and blanks as single spaces, lower case."""
    return F.lower(F.trim(F.regexp_replace(label, LABEL_GAPS, " ")))


def capture_class(key: Column) -> Column:
    """Class of a normalised capture label, null when none is known."""
    return lookup(vocab.CAPTURE_LABELS, key)


def capture_label_code(key: Column, klass: Column) -> Column:
    """Reason code of a normalised capture label; null when it is usable."""
    return (F.when(klass.isNotNull(), F.lit(None).cast("string"))
            .when(F.coalesce(key, F.lit("")) == "", F.lit(vocab.MISSING_LABEL))
            .when(F.replace(key, F.lit(" "), F.lit("")).contains(vocab.EXCLUDED_CAPTURE_WORD),
                  F.lit(vocab.HEARTBLEED))
            .otherwise(F.lit(vocab.UNKNOWN_LABEL)))
