"""Operator 9: toxicity by multiple-instance learning.

A document is a bag of sentences. A logistic model gives each sentence a probability p from its words: with logit z
and the logit b of a sentence without telling words, -log(1 - p) = max(softplus(z) - softplus(b), 0), so a sentence
without telling words has p = 0 and length alone is no evidence. A document is toxic by noisy-or, 1 - prod(1 - p).
The model is trained from document labels only (with a leak that stands for labels no sentence explains), so it
learns which sentences make a document toxic; scoring uses the same noisy-or, without the leak, calibrated so that
THRESHOLD lies at the best cut of held-out documents. Afterwards the offending sentences are located.

Training takes a sample of labelled rows: at most about MAX_TRAINING documents, of any length and taken whole. Their
words are hashed; document frequencies by label are counted by Spark, and only telling features (at most FEATURES)
and the sentences that hold them come to the driver. Scoring runs over every sentence of every document, inside one
pass of Arrow batches without a shuffle; texts are taken PART bytes at a time.

Defined results: a null or empty text, or one without words, has no sentences and gets the lowest score; equal
texts get equal scores; without labels of both kinds, or telling words, every score is 0; repeated rows are scored one by one; an empty
table gives an empty result; other columns are untouched, and where the input has a column of the result's name
already, the result's name gets underscores until it is free.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytehash
from .common import new_column, save, transient

#: Bound of the training sample, hashed word features, and what makes a feature tell: training documents that have it,
#: and its likelihood ratio against independence of the label.
MAX_TRAINING, FEATURES, MIN_DOCS, MIN_RATIO = 6_000, 1 << 21, 4, 24.0
#: Hashes of labels are cut from this many, so that a sample is never empty because its share is small.
HASHES = 1 << 62
EPOCHS, RATE, DECAY, HELD = 400, 0.05, 1e-5, 4
#: Beside each word its first bytes are features, which carry over to longer forms of a word.
HEADS = (4, 5)
#: The score at which predicted becomes 1; calibration puts the best cut there.
THRESHOLD = 0.7
#: A cut that no document reaches.
NEVER = 50.0
#: Bytes of text that are scored at a time.
PART = 1 << 21
RESULT = "struct<score:double,sentences:bigint,worst:bigint,offending:array<bigint>>"

_END = np.zeros(256, dtype=bool)
_END[[33, 46, 63, 10]] = True  # ! . ? and line feed


def sentences(texts: list[bytes]):
    """(indices, features, sentence number within its text, text of each feature) for each block of texts.

    A word gives its own feature and those of its heads, next to each other.

    Sentences end at . ! ? or a line feed; the numbers count those signs, so sentences without words are skipped.
    """
    for own in bytehash.blocks(texts):
        ends, feature, number, owner = [], [], [], []
        for k, i in enumerate(own):
            base = 0
            for piece in bytehash.pieces(texts[i]):
                ends.append(len(piece) + 1)
                owner.append((k, base, piece))
        group: list[tuple[int, int, bytes]] = []
        size = 0
        for item in [*owner, None]:
            if group and (item is None or size + len(item[2]) + 1 > bytehash.BLOCK):
                data = b"\n".join([g[2] for g in group])
                b, start, end, h = bytehash.words(data)
                stops = np.cumsum(_END[b])
                last = np.cumsum([len(g[2]) + 1 for g in group])
                part = np.searchsorted(last, start, side="right")
                every = np.stack([h, *[bytehash.heads(b, start, end, k) for k in HEADS]], axis=1).ravel()
                feature.append((every >> np.uint64(43)).astype(np.int64))
                each = 1 + len(HEADS)
                number.append((np.repeat(stops[start], each), np.repeat(np.array([g[0] for g in group], dtype=np.int64)[part], each)))
                group, size = [], 0
            if item is not None:
                group.append(item)
                size += len(item[2]) + 1
        shift, nums = 0, []
        for n, _ in number:  # keep numbers of consecutive passes apart
            nums.append(n + shift)
            shift = int(nums[-1][-1]) + 1 if len(n) else shift
        f = np.concatenate(feature) if feature else np.zeros(0, np.int64)
        n = np.concatenate(nums) if nums else np.zeros(0, np.int64)
        text = np.concatenate([t for _, t in number]) if number else np.zeros(0, np.int64)
        yield own, f, n, text


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    cut: float

    def sentence_logits(self, feature: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word of each sentence, logit of each sentence); words of a sentence stand together."""
        if not len(feature):
            return np.zeros(0, np.int64), np.zeros(0)
        first = np.flatnonzero(np.diff(number, prepend=number[0] - 1))
        return first, np.add.reduceat(self.weights[feature], first) + self.bias

    def calibrated(self, log_clean: np.ndarray) -> np.ndarray:
        """Score by log prod(1 - p): monotone, and THRESHOLD at the cut."""
        x = _odds(log_clean)
        return 1 / (1 + np.exp(-np.clip(self.slope * (x - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def _odds(log_clean: np.ndarray) -> np.ndarray:
    """Logit of 1 - prod(1 - p), from log prod(1 - p)."""
    y = np.maximum(-log_clean, 1e-12)
    return np.where(y > 30, y, np.log(np.expm1(np.minimum(y, 30))))


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def evidence(z: np.ndarray, bias: float) -> np.ndarray:
    """-log(1 - p) of sentences with logits z."""
    return np.maximum(_softplus(z) - _softplus(bias), 0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(bags: list[np.ndarray], labels: np.ndarray, held: np.ndarray) -> Model:
    """Train on bags of (telling feature, sentence number) pairs; held bags calibrate."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(FEATURES, dtype=np.float32), -30.0, 1.0, NEVER)
    y = labels.astype(float)
    train = ~held if len(set(labels[~held].tolist())) == 2 else np.ones(len(y), bool)
    held = held if len(set(labels[held].tolist())) == 2 else np.ones(len(y), bool)
    doc = np.repeat(np.arange(len(bags)), [len(d) for d in bags])
    feature, number = (np.concatenate([d[:, k] for d in bags]) for k in (0, 1))
    sentence = np.cumsum(np.concatenate([[True], (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])])) - 1 if len(doc) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(sentence, prepend=-1))
    bag = doc[first]
    used = np.unique(feature)
    code = np.searchsorted(used, feature)
    logits = lambda w, b: (np.add.reduceat(w[code], first) if len(first) else np.zeros(0)) + b
    # parameters: the used weights, the logit of a sentence without telling words, and the leak
    w = np.concatenate([np.zeros(len(used)), [-4.0, -3.0]])
    m, v = np.zeros(len(w)), np.zeros(len(w))
    share = train / train.sum()
    for step in range(1, EPOCHS + 1):
        z = logits(w[:-2], w[-2])
        active = z >= w[-2] - 1e-12
        clean = -np.bincount(bag, evidence(z, w[-2]), len(y)) - _softplus(w[-1])  # log prod(1 - p)
        p = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-9)
        # d loss / d clean: label 1 wants a low clean, label 0 a high one
        up = share * np.where(y == 1, np.exp(clean) / p, -1.0)
        gz = -up[bag] * active * _sigmoid(z)
        gb = gz.sum() + (up[bag] * active).sum() * _sigmoid(w[-2])
        g = np.concatenate([np.bincount(code, np.repeat(gz, np.diff(first, append=len(code))), len(used)), [gb, -(up * _sigmoid(w[-1])).sum()]])
        g[:-2] += DECAY * w[:-2]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    w, bias = w[:-2], float(w[-2])
    weights = np.zeros(FEATURES, dtype=np.float32)
    weights[used] = w
    x = _odds(-np.bincount(bag, evidence(logits(w, bias), bias), len(y)))[held]
    order = np.argsort(-x)
    hit = np.cumsum(y[held][order])
    f1 = 2 * hit / (np.arange(1, len(hit) + 1) + max(1.0, y[held].sum()))
    f1[x[order] <= _odds(np.zeros(1))[0] + 1e-6] = -1  # a document without evidence is never over the cut
    k = int(f1.argmax())
    cut = NEVER if f1[k] < 0 else float(x[order][k] if k + 1 >= len(order) else (x[order][k] + x[order][k + 1]) / 2)
    return Model(weights, bias, 1.0, cut)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Text and label of the rows that may be learned from, a sample of about MAX_TRAINING labels; a repeated label counts once.

    The sampled labels are broadcast (their number is bounded by the sample), so texts are filtered where they are read.
    """
    own = labels.select(F.col(id_col).alias("__id"), (F.col(label_col) > 0).cast("int").alias("__label")).filter("__id is not null and __label is not null")
    own = own.filter(F.crc32(F.col("__id").cast("string")) % 3 != 1).distinct()
    total = own.count()
    if total > MAX_TRAINING:  # the least hashes: the same rows on every run
        own = own.filter(F.pmod(F.xxhash64(F.col("__id"), F.lit(11)), F.lit(HASHES)) < HASHES * MAX_TRAINING // total)
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return texts.join(F.broadcast(own), "__id").select("__id", "__text", "__label")


def _bags(text: pa.Array) -> pa.Array:
    """(feature, sentence number) pairs of every text as 32-bit numbers."""

    def some(text: pa.Array) -> pa.Array:
        out = [b""] * len(text)
        for own, feature, number, owner in sentences(text.cast(pa.large_binary()).to_pylist()):
            cuts = np.searchsorted(owner, np.arange(len(own) + 1))
            for k, i in enumerate(own):
                a, b = cuts[k], cuts[k + 1]
                out[i] = np.stack([feature[a:b], number[a:b] - (number[a] if b > a else 0)], axis=1).astype(np.int32).tobytes()
        return pa.array(out, pa.binary())

    return bytehash.by_bytes(text, some, pa.binary(), PART)


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that have a feature, summed in batches."""
    for batch in batches:
        words, label = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        for y in (0, 1):
            own = [np.unique(np.frombuffer(words[i], np.int32)[::2]) for i in np.flatnonzero(label == y)]
            if own:
                f, n = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_pydict({"feature": f, "label": np.full(len(f), y, np.int32), "n": n.astype(np.int64)})


def telling(rows: DataFrame, n: int, positive: int) -> DataFrame:
    """Features in at least MIN_DOCS of the n rows (positive of them toxic) whose likelihood ratio is MIN_RATIO or more."""
    seen = rows.select("words", "label").mapInArrow(_seen, "feature int, label int, n long").groupBy("feature").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("label")).alias("pos"))
    share, total, pos = positive / n, F.col("total"), F.col("pos")

    def part(k: Column, expected: Column) -> Column:
        return F.when(k > 0, 2 * k * F.log(k / expected)).otherwise(0.0)

    rest, rest_pos = F.lit(n) - total, F.lit(positive) - pos
    ratio = part(pos, total * share) + part(total - pos, total * (1 - share)) + part(rest_pos, rest * share) + part(rest - rest_pos, rest * (1 - share))
    return seen.filter((total >= MIN_DOCS) & (ratio >= MIN_RATIO)).select("feature")


@transient
def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample; only telling features of it reach the driver."""
    rows = training_rows(docs, labels, id_col, text_col, label_col)
    held = F.pmod(F.xxhash64("__id", F.lit(5)), F.lit(HELD)) == HELD - 1
    rows = save(rows.select(F.col("__id").alias("id"), F.col("__label").alias("label"), held.alias("held"), F.arrow_udf(_bags, "binary")("__text").alias("words")), "bags")
    size = {(r.held, r.label): r.n for r in rows.groupBy("held", "label").agg(F.count("*").alias("n")).collect()}
    both = size.get((False, 0)) and size.get((False, 1))
    positive = sum(n for (h, y), n in size.items() if y and not (both and h))
    n = sum(n for (h, _), n in size.items() if not (both and h))
    if not 0 < positive < n:
        return fit([], np.zeros(0, np.int64), np.zeros(0, bool))
    tells = np.zeros(FEATURES, dtype=bool)
    for r in telling(rows.filter("not held") if both else rows, n, positive).toLocalIterator():
        tells[r.feature] = True
    shared = rows.sparkSession.sparkContext.broadcast(tells)

    def keep(words: pa.Array) -> pa.Array:
        pairs = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in words.to_pylist()]
        return pa.array([x[shared.value[x[:, 0]]].tobytes() for x in pairs], pa.binary())

    got = sorted(((r.id, r.label, bytes(r.words), r.held) for r in rows.select("id", "label", "held", F.arrow_udf(keep, "binary")("words").alias("words")).toLocalIterator()))
    return fit([np.frombuffer(r[2], np.int32).reshape(-1, 2) for r in got], np.array([r[1] for r in got]), np.array([r[3] for r in got], dtype=bool))


_RESULT = pa.struct([("score", pa.float64()), ("sentences", pa.int64()), ("worst", pa.int64()), ("offending", pa.list_(pa.int64()))])


def score_texts(text: pa.Array, model: Model) -> pa.Array:
    """RESULT of every text; null where no sentence has words counts as worst."""
    texts = text.cast(pa.large_binary()).fill_null(b"").to_pylist()
    n = len(texts)
    clean, count, worst = np.zeros(n), np.zeros(n, np.int64), np.full(n, -1, np.int64)
    offending: list[list[int]] = [[] for _ in range(n)]
    for own, feature, number, owner in sentences(texts):
        first, z = model.sentence_logits(feature, number * len(own) + owner)
        at = np.array(own)[owner[first]] if len(first) else np.zeros(0, np.int64)
        found = evidence(z, model.bias)
        clean -= np.bincount(at, found, n)
        count += np.bincount(at, minlength=n)
        place = np.arange(len(at)) - np.searchsorted(at, at)
        order = np.lexsort((place, -z, at))
        lead = order[np.flatnonzero(np.diff(at[order], prepend=-1))]
        worst[at[lead]] = place[lead]
        for k in np.flatnonzero(found >= np.log1p(np.exp(model.cut))):
            offending[at[k]].append(int(place[k]))
    fields = [pa.array(model.calibrated(clean)), pa.array(count), pa.array(worst, mask=worst < 0), pa.array(offending, pa.list_(pa.int64()))]
    return pa.StructArray.from_arrays(fields, fields=list(_RESULT))


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """docs with a struct of RESULT; worst and offending count sentences that have words, from 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(text: pa.Array) -> pa.Array:
        return bytehash.by_bytes(text, lambda some: score_texts(some, shared.value), _RESULT, PART)

    return new_column(docs, out_col, F.arrow_udf(run, RESULT)(F.col(text_col)))
