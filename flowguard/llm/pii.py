"""PII by candidate gradient boosting.

High-recall generators propose spans that may overlap: the base patterns of four kinds, and looser
forms of each (a mail address spelled with "at" and "dot" or with brackets, four numbers with
blanks around their dots, telephone digits without a plus, card digits in other groupings).
Boosted trees judge the looser ones by format and context features; a threshold calibrated per kind
on candidates kept back from the fit decides. Base spans that pass their checks are always kept,
added ones may not overlap a kept one of their kind.

A loose candidate that contradicts its kind's check (``may_be``: digit counts, check digit, number range,
form of a domain) is none. The model learns from a sample of ``sample_docs`` documents, chosen by a hash of
the id. Positive are base matches that pass their checks, half of them shown in a loose spelling. Negative
are base matches that fail, those of one kind as candidates of the others, and decoys that pass a check,
put at other places of the same text: dates, order and book numbers, numbered lists, a verb before a
domain. Loose candidates of the texts may be personal data or not: they are unlabelled, and count as
negative with a small weight that many positives outvote. Thresholds are set on labelled examples kept
back. Every text is searched whole.

Nulls count as empty text; every row gives one row, also rows that repeat an id. Texts without
candidates have counts of 0; a text of any length is searched from end to end, in memory of its size. Of
overlapping added spans that with the higher margin stays, then the lower kind and place. Without
positive examples in the sample nothing is added to the base. Empty tables give no rows. Other columns are
not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import hash_sample, rows_batch, text_column

KINDS = ("email", "ip", "card", "phone")
SPANS = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS),
                   ("base_sha256", pa.string()), ("spans", pa.string())])
SPANS_SQL = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
             "base_sha256 string, spans string")
EXAMPLES = pa.schema([("kind", pa.int32()), ("label", pa.int32()), ("weight", pa.float64()),
                      ("features", pa.list_(pa.float64()))])
UNLABELLED = 0.05  # weight of a candidate of which nothing is known

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*\Z")
MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A failing run of digits fails from each later digit too, so one start per run is enough.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOOSE_MAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}"
    r"(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,63}){1,4}", re.I)
LOOSE_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\.|\[\.\]) ?[0-9]{1,3}){3}(?![0-9])")
LOOSE_DIGITS = re.compile(r"(?<![0-9A-Za-z+.])\(?[0-9](?:[ ()./-]{0,3}[0-9]){7,18}(?![0-9A-Za-z])")
# A domain after its sign: a full stop with a blank on one side only ends a sentence.
LOOSE_SIGN = re.compile(r" ?(?:@|\(at\)|\[at\]| at ) ?", re.I)
LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
LOOSE_DOT = r"(?: ?(?:\(dot\)|\[dot\]) ?| dot |\.| \. )"
DOMAIN = re.compile(rf"{LABEL}(?:{LOOSE_DOT}{LABEL})*?{LOOSE_DOT}[A-Za-z]{{2,63}}(?![A-Za-z0-9-])", re.I)
CUES = {0: ("mail", "contact", "write", "reach"), 1: ("ip", "address", "host", "server"),
        2: ("card", "visa", "credit", "payment"), 3: ("phone", "call", "tel", "mobile", "fax")}
CONTEXT = 24


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _mails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each sign so that long runs are looked at once."""
    after, sign = 0, text.find("@")
    while sign >= 0:
        lowest = sign
        while lowest > after:  # the run of local characters, in bounded steps
            step = max(after, lowest - 256)
            start = LOCAL_BACK.search(text, step, lowest).start()
            lowest, more = start, start == step
            if not more:
                break
        match = MAIL.match(text, lowest) if lowest < sign else None
        if match:
            yield match.span()
            after = match.end()
        sign = text.find("@", max(after, sign + 1))


def base_matches(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(kind, start, end, whether it passes the checks) of the base patterns."""
    for s, e in _mails(text):
        yield 0, s, e, True
    for m in IP.finditer(text):
        yield 1, *m.span(), all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255
                                for x in m.group().split("."))
    for m in CARD.finditer(text):
        digits = digits_of(m.group())
        yield 2, *m.span(), 12 <= len(digits) <= 19 and luhn(digits)
    for m in PHONE.finditer(text):
        yield 3, *m.span(), 9 <= len(digits_of(m.group())) <= 15


def loose_matches(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of the further candidates; a run of digits is one of two kinds."""
    if "at" in text or "@" in text or "AT" in text:
        for m in LOOSE_MAIL.finditer(text):
            yield 0, *m.span()
    for m in LOOSE_IP.finditer(text):
        yield 1, *m.span()
    for m in LOOSE_DIGITS.finditer(text):
        yield 2, *m.span()
        yield 3, *m.span()


def may_be(kind: int, span: str) -> bool:
    """Whether a loose candidate passes its kind's check; a mail address may have more behind it."""
    if kind == 0:
        sign = LOOSE_SIGN.search(span)
        return sign is not None and DOMAIN.match(span, sign.end()) is not None
    if kind == 1:
        return all(int(x) <= 255 for x in re.findall(r"[0-9]+", span))
    digits = digits_of(span)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def features(text: str, kind: int, start: int, end: int, shown: str | None = None) -> list[float]:
    """Format of the span and what stands around it. ``shown``: another spelling of the span."""
    span = text[start:end] if shown is None else shown
    left, right = text[max(0, start - CONTEXT):start].lower(), text[end:end + CONTEXT].lower()
    digits = digits_of(span)
    groups = re.findall(r"[0-9]+", span)
    n = max(len(span), 1)
    around = left[-1:], right[:1]
    return [
        float(kind), len(span), len(digits), len(digits) / n, sum(c.isalpha() for c in span) / n,
        sum(c == " " for c in span), sum(c in "-/" for c in span), sum(c in "()[]" for c in span),
        span.count("."), span.count("@"), len(groups), max(map(len, groups), default=0),
        min(map(len, groups), default=0), float(luhn(digits)) if digits else 0.0,
        float(max((int(g[-9:]) for g in groups), default=0) <= 255), float(span[:1] in "+("),
        float(12 <= len(digits) <= 19), float(9 <= len(digits) <= 15), float(digits[:1] == "0"),
        float(any(c in left for c in CUES[kind])), float(any(c in right for c in CUES[kind])),
        float(any(c in left for k, cues in CUES.items() if k != kind for c in cues)),
        float(around[0].isalnum()), float(around[1].isalnum()), float(around[0] in "=\"'#$/"),
        sum("0" <= c <= "9" for c in left + right), float(bool(re.search(r"\b(19|20)[0-9]{2}\b", span))),
        span.lower().count("at") + span.lower().count("dot"),
    ]


def _spelled(kind: int, span: str) -> str:
    """A valid span as a looser writer would put it."""
    if kind == 0:
        return span.replace("@", " at ").replace(".", " dot ")
    if kind == 1:
        return span.replace(".", " . ")
    digits = digits_of(span)
    if kind == 2:
        return "/".join(digits[i:i + 4] for i in range(0, len(digits), 4))
    return f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}" if len(digits) >= 10 else digits


def _decoys(kind: int, span: str, draw: int) -> Iterator[tuple[int, str]]:
    """(kind, text) of what looks like a kind and passes its check, but is something else."""
    digits = f"{draw % 10**18:018d}"
    if kind == 0:
        verb = ("look", "arrive", "buy", "stay", "meet")[draw % 5]
        yield 0, f"{verb} at {span.split('@')[-1]}"
        return
    if kind == 1:
        yield 1, ". ".join(str(draw // 7 % 9 + k) for k in range(4))
        return
    year, month, day, hour = 1950 + draw % 100, draw // 7 % 12 + 1, draw // 11 % 28 + 1, draw // 13 % 24
    yield 3, f"{year}-{month:02d}-{day:02d} {hour:02d}"
    yield 3, f"{day:02d}.{month:02d}.{year} {hour:02d}:{draw % 60:02d}"[:13] + digits[:2]
    yield 3, digits[:9 + draw % 6]  # an order number
    yield 3, f"978-{digits[0]}-{digits[1:4]}-{digits[4:9]}-{digits[9]}"
    body = "978" + digits[:9]
    book = next(body + str(c) for c in range(10) if luhn(body + str(c)))
    yield 2, f"{book[:3]}-{book[3]}-{book[4:7]}-{book[7:12]}-{book[12]}"
    body = digits[:13]
    yield 2, next(body + str(c) for c in range(10) if luhn(body + str(c)))


def examples(text: str) -> Iterator[tuple[int, int, float, list[float]]]:
    """(kind, label, weight, features) that a text teaches."""
    taken = []
    for k, s, e, good in base_matches(text):
        if not good and e - s < 4:
            continue
        taken.append((k, s, e))
        yield k, int(good), 1.0, features(text, k, s, e)
        if not good:
            continue
        span = text[s:e]
        yield k, 1, 1.0, features(text, k, s, e, _spelled(k, span))
        for other in (1, 2, 3):
            if k and other != k and may_be(other, span):
                yield other, 0, 1.0, features(text, other, s, e)
        draw = int.from_bytes(hashlib.md5(f"{s} {span}".encode()).digest()[:7], "big")
        for j, (other, shown) in enumerate(_decoys(k, span, draw)):
            place = text.find(" ", (draw >> j) % len(text)) + 1
            if may_be(other, shown) and not any(a <= place + CONTEXT and place <= b + CONTEXT for _, a, b in taken):
                yield other, 0, 1.0, features(text, other, place, place, shown)
    for k, s, e in loose_matches(text):
        if not any(a < e and s < b for _, a, b in taken) and may_be(k, text[s:e]):
            yield k, 0, UNLABELLED, features(text, k, s, e)


@dataclass
class Trees:
    """Boosted regression trees of equal depth in arrays, with a threshold for each kind."""

    column: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    bias: float
    threshold: list[float]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        inner = self.column.shape[1]
        for column, cut, leaf in zip(self.column, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while (node < inner).any():
                node = 2 * node + 1 + (x[np.arange(len(x)), column[node]] > cut[node])
            out += leaf[node - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 60, depth: int = 4,
          rate: float = 0.2) -> Trees:
    """Logistic boosting with histogram splits on a bounded, weighted sample."""
    weight = np.ones(len(y)) if weight is None else weight
    inner, leaves = 2 ** depth - 1, 2 ** depth
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1], method="lower")) for c in x.T]
    bins = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], 1)
    p0 = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    bias, made = float(np.log(p0 / (1 - p0))), []
    margin = np.full(len(y), bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * p * (1 - p)
        column, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            own = np.flatnonzero(node == k)
            best = 1e-6
            for f in range(x.shape[1]):
                n = len(cuts[f]) + 1
                gs = np.cumsum(np.bincount(bins[own, f], g[own], n))
                hs = np.cumsum(np.bincount(bins[own, f], h[own], n))
                gain = (gs ** 2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1)
                        - gs[-1] ** 2 / (hs[-1] + 1))[:-1]
                if len(gain) and gain.max() > best:
                    best, column[k], cut[k] = gain.max(), f, cuts[f][gain.argmax()]
            node[own] = 2 * k + 1 + (x[own, column[k]] > cut[k])
        at = node - inner
        leaf = rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + 1)
        margin += leaf[at]
        made.append((column, cut, leaf))
    return Trees(*(np.array(z) for z in zip(*made)), bias, [np.inf] * len(KINDS))


def calibrate(trees: Trees, x: np.ndarray, y: np.ndarray, kinds: np.ndarray, precision: float) -> None:
    """Per kind the lowest margin from which on ``precision`` of the candidates are positive."""
    margin = trees.margin(x)
    for k in range(len(KINDS)):
        own = kinds == k
        order = np.argsort(-margin[own], kind="stable")
        right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= precision)
        trees.threshold[k] = max(0.0, float(margin[own][order][good[-1]])) if len(good) else np.inf


def train(docs: DataFrame, sample_docs: int = 20_000, most_examples: int = 40_000,
          precision: float = 0.98) -> Trees | None:
    """Fit and calibrate on at most ``most_examples`` examples of the sampled documents."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [e for t in text_column(batch, "text") for e in examples(t)]
            if found:
                yield rows_batch(dict(zip(EXAMPLES.names, zip(*found))), EXAMPLES)
    sample = hash_sample(docs.select("doc_id", "text"), "doc_id", sample_docs, docs.count(), "pii")
    found = (sample.select("text").mapInArrow(work, "kind int, label int, weight double, features array<double>")
             .orderBy(F.xxhash64("kind", "label", "features"), "kind", "label", "features")
             .limit(most_examples).collect())
    y = np.array([r["label"] for r in found], float)
    if not len(y) or y.min() == y.max():
        return None
    x, kinds = np.array([r["features"] for r in found]), np.array([r["kind"] for r in found])
    weight = np.array([r["weight"] for r in found])
    back = np.arange(len(y)) % 3 == 0
    trees = boost(x[~back], y[~back], weight[~back])
    back &= weight == 1
    calibrate(trees, x[back], y[back], kinds[back], precision)
    return trees


def find(text: str, trees: Trees | None) -> tuple[list[tuple], list[tuple]]:
    """Base spans and added spans as (start, kind, end)."""
    base = sorted((s, k, e) for k, s, e, good in base_matches(text) if good)
    if trees is None:
        return base, []
    loose = [(k, s, e) for k, s, e in loose_matches(text) if trees.threshold[k] < np.inf and may_be(k, text[s:e])]
    # Digits that make a number of one base kind are no candidate of another.
    loose = [c for c in loose if not any(s < c[2] and c[1] < e for s, _, e in base)]
    if not loose:
        return base, []
    margins = trees.margin(np.array([features(text, *c) for c in loose]))
    added: list[tuple] = []
    for margin, (k, s, e) in sorted(zip(-margins, loose)):
        if -margin >= trees.threshold[k] and not any(a < e and s < b for a, _, b in added):
            added.append((s, k, e))
    return base, added


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def detect(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """Per document: doc_id, counts and digest of the base spans, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), text_column(batch, "text")):
                base, added = find(text, shared.value)
                kinds = [k for _, k, _ in base]
                rows.append((doc, *map(kinds.count, range(len(KINDS))),
                             hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added)))
            if rows:
                yield rows_batch(dict(zip(SPANS.names, zip(*rows))), SPANS)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, SPANS_SQL)


def redact(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; nulls stay."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def clean(text):
        out, at = [], 0
        base, added = find(text, shared.value)
        for s, k, e in sorted(base + added):
            if s >= at:
                out += [text[at:s], f"[{KINDS[k]}]"]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [None if t is None else clean(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
    return docs.mapInArrow(work, docs.schema)
