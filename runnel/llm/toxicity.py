"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic of its hashed features: words and the beginnings of
words. A document is toxic when any sentence is: its score is the noisy-or of its sentences' scores. Only documents have
labels; weights are fitted through the noisy-or, on a bounded sample. The same weights then point at the sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import NOT_LETTER, WordHasher, groups, kept, mix


@dataclass(frozen=True)
class Settings:
    """bits: 2**bits weights. prefixes: lengths in bytes of beginnings of words that are features besides whole words.
    per_class: about so many documents of each label are fitted on, drawn by a hash of the id, whatever their length.
    budget: bytes of their texts; where a label's documents have more than half of it, the first by the hash are taken up
    to the one that reaches it. least: sentences that score less count as harmless when documents are scored. Each sentence
    has a small score even if its words tell nothing (the floor, about 1 / (1 + exp(-start))); with least above the floor
    these do not add up over long documents. 0 counts every sentence."""

    bits: int = 18
    prefixes: tuple[int, ...] = (4, 5, 6)
    per_class: int = 1500
    budget: int = 16 << 20
    rounds: int = 150
    rate: float = 0.7
    sparsity: float = 1e-4
    start: float = -8.0
    least: float = 0.0


@dataclass
class Model:
    weights: np.ndarray
    bias: float


_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True


class Sentences:
    """The features of the words of texts, and the sentence of each word."""

    def __init__(self, s: Settings):
        self.s, self.hasher = s, WordHasher(NOT_LETTER)
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[ord("A") : ord("Z") + 1] += 32

    def __call__(self, texts: list[str | None]):
        """(features of each distinct word of a sentence, its sentence, each sentence's text, first and end byte, the
        joined texts). Sentences without words are passed over; the others are numbered through all texts."""
        h, offsets, start, end, first, joined = self.hasher.words(texts, places=True)
        data = np.frombuffer(joined, np.uint8)
        stop = np.cumsum(_END[data]) if len(data) else np.empty(0, np.int64)
        doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
        inner = stop[start] if len(h) else np.empty(0, np.int64)
        new = np.r_[True, (inner[1:] != inner[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.empty(0, bool)
        sentence = np.cumsum(new) - 1
        left, right = start[new], end[np.r_[new[1:], True]] if len(h) else end
        owner = doc[new] if len(h) else np.empty(0, np.int64)
        # a word counts once in a sentence
        once = np.sort(np.unique(mix(h ^ (sentence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)[1])
        h, sentence, start, end = h[once], sentence[once], start[once], end[once]
        top = np.uint64(64 - self.s.bits)
        columns = [mix(h) >> top]
        low = self.lower[data] if len(data) else data
        for p in self.s.prefixes:
            code, long = np.full(len(h), p, np.uint64), end - start > p
            at = start[long]
            part = code[long]
            for k in range(p):
                part = part * np.uint64(0x100000001B3) + low[at + k]
            code[long] = mix(part)
            columns.append(np.where(long, code >> top, columns[0]))
        return np.stack(columns, axis=1).astype(np.int32), sentence, owner, left, right, joined


def _noisy_or(z: np.ndarray, owner: np.ndarray, n: int, least: float = 0.0) -> np.ndarray:
    """The log of the probability that no sentence of a document is toxic; one that scores under least is none."""
    clean = -np.logaddexp(0, z)
    if least > 0:
        clean[z < np.log(least / (1 - least))] = 0
    return np.bincount(owner, clean, minlength=n)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns from docs (doc_id, text) and labels (doc_id, label 0/1), whose rows for one id count as their largest.
    Numbers of labels are counted over all rows. Of documents that share an id one text counts, the one with the largest
    hash, so an id that fills much of the table weighs no more than others. Null texts are passed over; without two kinds
    of labels the model gives every sentence the same score."""
    s = settings
    labels = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    if len(counts) < 2:
        sure = 10.0 if counts.get(1) else -10.0
        return Model(np.zeros(1 << s.bits, np.float32), sure)
    share = F.when(F.col("label") == 1, min(1.0, s.per_class / counts[1])).otherwise(min(1.0, s.per_class / counts[0]))
    drawn = labels.withColumn("u", F.xxhash64("doc_id", F.lit(21)).bitwiseAND(F.lit((1 << 32) - 1)) / float(1 << 32)).where(F.col("u") < share)
    texts = docs.select("doc_id", "text").where("text is not null")
    # about 2 * per_class ids are drawn: that is what is broadcast, and no other text is shuffled
    sample = texts.join(F.broadcast(drawn), "doc_id")
    pick = F.struct(F.xxhash64("text").alias("hash"), F.octet_length("text").alias("bytes"))
    chosen = kept(sample.groupBy("doc_id").agg(F.first("label").cast("int").alias("label"), F.first("u").alias("u"), F.max(pick).alias("pick")))
    long = chosen.select("label", "u", F.col("pick.bytes").alias("bytes")).orderBy("u").collect()
    last, had = {0: -1.0, 1: -1.0}, {0: 0, 1: 0}
    for r in long:
        if had[r["label"]] < s.budget / 2:
            last[r["label"]] = r["u"]
        had[r["label"]] += r["bytes"]
    chosen = chosen.where(F.col("u") <= F.when(F.col("label") == 1, last[1]).otherwise(last[0])).select("doc_id", "label", F.col("pick.hash").alias("hash"))

    def measure(batches):
        of = Sentences(s)
        for batch in batches:
            texts, label = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, to in groups(texts):
                x, sentence, owner, *_ = of(texts[at:to])
                word_doc = owner[sentence]
                edges = np.searchsorted(word_doc, np.arange(to - at + 1))
                for k in range(to - at):
                    own = slice(edges[k], edges[k + 1])
                    if edges[k] == edges[k + 1]:
                        continue
                    yield pa.RecordBatch.from_arrays([pa.array([label[at + k]], pa.int32()), pa.array([x[own].tobytes()]), pa.array([(sentence[own] - sentence[own][0]).astype(np.int32).tobytes()])], ["label", "x", "sentence"])

    fitted = texts.withColumn("hash", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "hash"]).dropDuplicates(["doc_id"])
    got = fitted.select("text", "label").mapInArrow(measure, "label int, x binary, sentence binary").toArrow()
    if not got.num_rows:
        return Model(np.zeros(1 << s.bits, np.float32), s.start)
    y = got.column("label").to_numpy().astype(np.float64)
    width = 1 + len(s.prefixes)
    xs, owners, sentences, at = [], [], [], 0
    for k, (x, t) in enumerate(zip(got.column("x").to_pylist(), got.column("sentence").to_pylist())):
        x, t = np.frombuffer(x, np.int32).reshape(-1, width), np.frombuffer(t, np.int32)
        xs.append(x)
        sentences.append(t.astype(np.int64) + at)
        owners.append(np.full(t[-1] + 1, k))
        at += int(t[-1]) + 1
    x, sentence, owner = np.concatenate(xs), np.concatenate(sentences), np.concatenate(owners)
    # only features that occur in the sample have weights to fit
    there = np.zeros(1 << s.bits, bool)
    there[x.ravel()] = True
    used = np.flatnonzero(there)
    number = np.cumsum(there) - 1
    flat = [number[x[:, c]] for c in range(width)]
    del xs, x, got
    w, b = np.zeros(len(used)), s.start
    sum_w, sum_b, n = np.full(len(used), 1e-8), 1e-8, len(y)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for _ in range(s.rounds):
        z = np.bincount(sentence, sum(w[c] for c in flat), minlength=len(owner)) + b
        clean = _noisy_or(z, owner, n)
        p = -np.expm1(clean)
        # d(-log likelihood)/d z_s = sigmoid(z_s) * (1 - y / p)
        g = weight[owner] * (1 - (y / np.maximum(p, 1e-9))[owner]) / (1 + np.exp(np.minimum(-z, 500)))
        each = g[sentence]
        by = sum(np.bincount(c, each, minlength=len(used)) for c in flat)
        sum_w += by * by
        step = s.rate / np.sqrt(sum_w)
        w = w - step * by
        w = np.sign(w) * np.maximum(np.abs(w) - step * s.sparsity, 0)
        sum_b += g.sum() ** 2
        b -= 0.1 * g.sum() / np.sqrt(sum_b)
    full = np.zeros(1 << s.bits, np.float32)
    full[used] = w
    return Model(full, float(b))


def score(docs: DataFrame, model: Model, settings: Settings = Settings(), threshold: float = 0.5) -> DataFrame:
    """docs (doc_id, text) with score and predicted.

    Every sentence of the whole text is scored, however long it is, and counts if it reaches settings.least; texts are measured in pieces of bounded size. Null and
    empty texts, and texts without letters, have no sentence and score 0. Repeated rows get the same score. An empty table
    gives no rows. Only doc_id and text are looked at and only doc_id, score and predicted are returned, so columns of docs
    that are called score or predicted clash with nothing.
    """
    s = settings
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        of, m = Sentences(s), shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = np.zeros(len(texts))
            for at, to in groups(texts):
                x, sentence, owner, *_ = of(texts[at:to])
                if len(owner):
                    z = np.bincount(sentence, m.weights[x].sum(axis=1), minlength=len(owner)) + m.bias
                    out[at:to] = -np.expm1(_noisy_or(z, owner, to - at, s.least))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(out, 0, 1))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def offending_sentences(docs: DataFrame, model: Model, settings: Settings = Settings(), threshold: float = 0.5) -> DataFrame:
    """The sentences that score at least threshold: (doc_id, sentence, score, words), where sentence counts the sentences
    with words of the document from 0 and words is the text from the first to the last word. Of a document that reaches
    the threshold by many lesser sentences only, the highest one is given (the first of equals). Documents under the
    threshold, null, empty and wordless ones have no rows; repeated rows each have theirs; columns beside doc_id and text
    are not looked at."""
    s = settings
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def locate(batches):
        of, m = Sentences(s), shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, to in groups(texts):
                x, sentence, owner, left, right, joined = of(texts[at:to])
                if not len(owner):
                    continue
                z = np.bincount(sentence, m.weights[x].sum(axis=1), minlength=len(owner)) + m.bias
                p = 1 / (1 + np.exp(np.minimum(-z, 500)))
                bad = p >= threshold
                whole = -np.expm1(_noisy_or(z, owner, to - at, s.least)) >= threshold
                whole[owner[bad]] = False
                order = np.lexsort((np.arange(len(p)), -p, owner))
                top = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
                bad[top[whole[owner[top]]]] = True
                bad = np.flatnonzero(bad)
                place = np.arange(len(owner)) - np.searchsorted(owner, owner)
                said = [joined[left[i] : right[i]].decode("utf-8", "replace") for i in bad]
                ids = batch.column(0).slice(at, to - at).take(pa.array(owner[bad]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(place[bad], pa.int64()), pa.array(p[bad]), pa.array(said, pa.string())], ["doc_id", "sentence", "score", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(locate, f"doc_id {kind}, sentence bigint, score double, words string")
