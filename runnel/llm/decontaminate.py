"""Benchmark decontamination by winnowing.

Of every `window` following k-gram hashes the least is a fingerprint. A span of window + k - 1 words that a document and
an item share has the same k-grams in both, hence the same least one: sharing is never missed. Fingerprints that meet
are extended: the runs of `span` words around them are looked up whole.

The benchmark is the small side, but its size is checked: up to `broadcast_words` words its fingerprints and runs go to
the executors and documents are judged in one pass without a shuffle; a larger benchmark is joined by shuffles.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import NOT_WORD, WordHasher, groups, kept, runs


@dataclass(frozen=True)
class Settings:
    """span: words of a run that counts as shared; k: words of a k-gram. percent: a document is contaminated when it has
    hit words and 100 * n_hit >= percent * n_words."""

    span: int = 13
    k: int = 5
    percent: int = 5
    broadcast_words: int = 4_000_000

    @property
    def window(self) -> int:
        return self.span - self.k + 1


def _sliding(x: np.ndarray, n: int, least: bool) -> np.ndarray:
    """Least or largest of each n following values."""
    f, width = (np.minimum if least else np.maximum), 1
    while width * 2 <= n:
        x = f(x[:-width], x[width:])
        width *= 2
    return f(x[: len(x) - (n - width)], x[n - width :]) if width < n else x


def fingerprints(grams: np.ndarray, window: int) -> np.ndarray:
    """Which k-grams are the least of a window that holds them; with fewer k-grams than a window, all."""
    if len(grams) < window:
        return np.ones(len(grams), bool)
    least = _sliding(grams, window, True)
    pad = np.zeros(window - 1, np.uint64)
    return _sliding(np.concatenate([pad, least, pad]), window, False) == grams


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in a run of that length from one of the starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


def runs_of_items(benchmark: DataFrame, s: Settings) -> DataFrame:
    """benchmark (item, text): (item, length, run, prints): each distinct run of an item, or the whole of a shorter item,
    with the fingerprints of its k-grams (none where it is shorter than the span)."""

    def items(batches):
        hasher = WordHasher(NOT_WORD)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at, to in groups(texts, 1 << 18):
                h, offsets = hasher.words(texts[at:to])
                rows: tuple[list, ...] = ([], [], [], [])
                for k in range(to - at):
                    own = h[offsets[k] : offsets[k + 1]]
                    if not len(own):
                        continue
                    length = min(s.span, len(own))
                    whole = np.unique(runs(own, length))
                    grams = runs(own, s.k)
                    prints = np.unique(grams[fingerprints(grams, s.window)]) if length == s.span else np.empty(0, np.uint64)
                    for column, value in zip(rows, (at + k, length, whole.view(np.int64), prints.view(np.int64))):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.list_(pa.int64())), pa.array(rows[3], pa.list_(pa.int64()))], ["item", "length", "runs", "prints"])

    return benchmark.mapInArrow(items, f"item {benchmark.schema['item'].dataType.simpleString()}, length int, runs array<bigint>, prints array<bigint>")


class _Lookup:
    """Sorted distinct keys with the items of each."""

    def __init__(self, keys: np.ndarray, items: np.ndarray):
        order = np.lexsort((items, keys))
        keys, self.items = keys[order], items[order]
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        self.keys, self.first = keys[new], np.r_[new, len(keys)]

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of x that are keys, and the keys' numbers."""
        if not len(self.keys) or not len(x):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == x)
        return hit, at[hit]


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _near(prints: np.ndarray, n: int, s: Settings) -> np.ndarray:
    """Starts of runs of span words that hold a k-gram at one of the given places."""
    return np.flatnonzero(covered(np.maximum(prints - (s.span - s.k), 0), s.span - s.k + 1, n))


def _one_pass(docs: DataFrame, items: DataFrame, s: Settings, texts_too: bool = False) -> DataFrame:
    got = items.select(F.col("item").cast("string").alias("item"), "length", "runs", "prints").toArrow()
    names = got.column("item").to_pylist()
    of = np.arange(len(names))
    lengths = got.column("length").to_numpy() if len(names) else np.empty(0, np.int32)

    def flat(name):
        lists = got.column(name).combine_chunks()
        counts = np.diff(np.asarray(lists.offsets)) if len(names) else np.empty(0, np.int64)
        return np.asarray(lists.flatten()).view(np.uint64), np.repeat(of, counts)

    whole, item = flat("runs") if names else (np.empty(0, np.uint64), of)
    prints = np.unique(flat("prints")[0]) if names else np.empty(0, np.uint64)
    tables = {int(n): _Lookup(whole[lengths[item] == n], item[lengths[item] == n]) for n in np.unique(lengths)}
    shared = docs.sparkSession.sparkContext.broadcast((names, prints, tables))

    def judge(batches):
        hasher = WordHasher(NOT_WORD)
        names, prints, tables = shared.value
        anchors = _Lookup(prints, np.zeros(len(prints), np.int64))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, to in groups(texts):
                h, offsets = hasher.words(texts[at:to])
                doc = np.repeat(np.arange(to - at), np.diff(offsets))
                hit, pairs = np.zeros(len(h), bool), []
                for length, table in tables.items():
                    whole = runs(h, length)
                    if length == s.span:
                        grams = runs(h, s.k)
                        chosen = np.flatnonzero(fingerprints(grams, s.window))
                        meet, _ = anchors.find(grams[chosen])
                        starts = _near(chosen[meet], len(whole), s)
                    else:
                        starts = np.arange(len(whole))
                    starts = starts[doc[starts] == doc[starts + length - 1]]
                    place, key = table.find(whole[starts])
                    hit |= covered(starts[place], length, len(h))
                    if len(place):
                        owner = doc[starts[place]]
                        owner, key = np.unique(np.stack([owner, key]), axis=1)
                        n = table.first[key + 1] - table.first[key]
                        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        pairs.append(np.stack([np.repeat(owner, n), table.items[np.repeat(table.first[key], n) + within]]))
                found: dict[int, list[str]] = {}
                if pairs:
                    for o, i in np.unique(np.concatenate(pairs, axis=1), axis=1).T:
                        found.setdefault(int(o), []).append(names[i])
                total = np.r_[0, np.cumsum(hit)]
                n_words, n_hit = np.diff(offsets), total[offsets[1:]] - total[offsets[:-1]]
                lists = [sorted(set(x for x in found.get(k, []) if x is not None)) for k in range(to - at)]
                # an item without an id counts, but has no name in the digest
                n_items = [len(lists[k]) + (None in found.get(k, [])) for k in range(to - at)]
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(at, to - at) for c in batch.columns[: len(names_out)]], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array([_digest(x) for x in lists], pa.string())],
                    [*names_out, "n_words", "n_hit", "n_items", "items_sha256"],
                )

    names_out = ["doc_id", "text"] if texts_too else ["doc_id"]
    kinds = ", ".join(f"{n} {docs.schema[n].dataType.simpleString()}" for n in names_out)
    return docs.mapInArrow(judge, f"{kinds}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string")


def _by_shuffles(docs: DataFrame, items: DataFrame, s: Settings, texts_too: bool = False) -> DataFrame:
    """The same without a benchmark in memory. Rows are told apart by id and text, so repeated rows share an answer."""
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")), F.col("text"), F.lit(3))
    docs = docs.withColumn("key", key)
    short = [r[0] for r in items.select("length").where(F.col("length") < s.span).distinct().collect()]

    def offer(batches):  # the fingerprints of a document, and all its runs as long as some short item
        hasher = WordHasher(NOT_WORD)
        for batch in batches:
            keys, texts = np.asarray(batch.column(0)), batch.column(1).to_pylist()
            for at, to in groups(texts):
                h, offsets = hasher.words(texts[at:to])
                doc = np.repeat(np.arange(to - at), np.diff(offsets))
                place = np.arange(len(h)) - np.repeat(offsets[:-1], np.diff(offsets))
                for length in (0, *short):
                    found = runs(h, length or s.k)
                    starts = np.arange(len(found)) if length else np.flatnonzero(fingerprints(found, s.window))
                    starts = starts[doc[starts] == doc[starts + (length or s.k) - 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at:to][doc[starts]], pa.int64()), pa.array(np.full(len(starts), length), pa.int32()), pa.array(place[starts], pa.int64()), pa.array(found[starts].view(np.int64), pa.int64())], ["key", "length", "place", "found"])

    distinct = docs.dropDuplicates(["key"])
    offered = distinct.select("key", "text").mapInArrow(offer, "key bigint, length int, place bigint, found bigint")
    prints = items.select(F.explode("prints").alias("found")).distinct()
    anchors = offered.where("length = 0").join(prints, "found", "left_semi").groupBy("key").agg(F.collect_list("place").alias("places"))

    def extend(batches):
        hasher = WordHasher(NOT_WORD)
        for batch in batches:
            for key, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                whole = runs(hasher.words([text])[0], s.span)
                starts = _near(np.array(places, np.int64), len(whole), s)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), key), pa.int64()), pa.array(np.full(len(starts), s.span), pa.int32()), pa.array(starts, pa.int64()), pa.array(whole[starts].view(np.int64), pa.int64())], ["key", "length", "place", "found"])

    extended = distinct.select("key", "text").join(anchors, "key").mapInArrow(extend, "key bigint, length int, place bigint, found bigint")
    whole = items.select("item", "length", F.explode("runs").alias("found"))
    hits = kept(extended.unionByName(offered.where("length > 0")).join(whole.select("length", "found").distinct(), ["length", "found"], "left_semi"))
    state = "named_struct('upto', 0L, 'n', 0L)"
    step = "(t, x) -> named_struct('upto', greatest(t.upto, x.place + x.length), 'n', t.n + greatest(0L, x.place + x.length - greatest(t.upto, x.place)))"
    n_hit = hits.select("key", "length", "place").distinct().groupBy("key").agg(F.expr(f"aggregate(array_sort(collect_list(struct(place, length))), {state}, {step}).n").alias("n_hit"))
    named = hits.select("key", "length", "found").distinct().join(whole, ["length", "found"]).groupBy("key").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("names"), F.max(F.col("item").isNull().cast("int")).alias("unnamed"))

    def count(batches):
        hasher = WordHasher(NOT_WORD)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for at, to in groups(texts):
                n = np.diff(hasher.words(texts[at:to])[1])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, to - at) for c in range(len(names_out))], pa.array(n, pa.int64())], [*names_out, "n_words"])

    names_out = ["doc_id", "key", "text"] if texts_too else ["doc_id", "key"]
    kinds = ", ".join(f"{n} {docs.schema[n].dataType.simpleString()}" for n in names_out)
    counted = docs.select("doc_id", "key", "text").mapInArrow(count, f"{kinds}, n_words bigint")
    return counted.join(n_hit, "key", "left").join(named, "key", "left").select(
        *[n for n in names_out if n != "key"],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        (F.coalesce(F.size("names"), F.lit(0)) + F.coalesce("unnamed", F.lit(0))).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "names"), F.lit("")), 256).alias("items_sha256"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated).

    Words are runs of ASCII digits and letters and of anything outside ASCII, with A-Z as a-z. A run of `span` words of
    an item, or the whole of a shorter one, hits all words of each place where it occurs in a document.

    Null, empty and wordless texts have n_words 0 and are not contaminated; null and wordless items hit nothing. Repeated
    rows get a row each; items that share an id count as one; an item without an id counts as one more. An empty
    benchmark hits nothing. Other columns of both tables are not looked at.
    """
    return _judged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, settings, item_col, item_text_col)


def clean_documents(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that decontaminate() does not call contaminated, with all their columns as they are. Each row is
    judged by its own text; with a benchmark that is broadcast no text is shuffled."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(None).alias("none")]
    rows = docs.select(F.struct(*others).alias("doc_id"), F.col(text_col).alias("text"))
    clean = _judged(rows, benchmark, settings, item_col, item_text_col, True).where("not contaminated")
    return clean.select(*[(F.col("text") if c == text_col else F.col("doc_id").getField(c)).alias(c) for c in docs.columns])


def _judged(docs: DataFrame, benchmark: DataFrame, s: Settings, item_col: str, item_text_col: str, texts_too: bool = False) -> DataFrame:
    items = kept(runs_of_items(benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")), s))
    words = items.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()[0]
    judged = (_one_pass if words <= s.broadcast_words else _by_shuffles)(docs, items, s, texts_too)
    return judged.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(100) * F.col("n_hit") >= F.lit(s.percent) * F.col("n_words")))
