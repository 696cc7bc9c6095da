"""Near-duplicate groups: MinHash bands propose pairs, odd sketches screen them, full shingle sets confirm them.

An odd sketch is a bitmap in which each MinHash sample of a document flips one bit. The bits in which two sketches differ
are the parity of the samples that differ, so their number estimates the Jaccard similarity closely where it is high.

Scale. Documents with equal shingle sets are one class from the start; only one document of a class is compared. In a
bucket of a band, all members are first compared with one pivot. After that only members of different components still
need a comparison: sketches are compared in blocks of bounded size inside tasks, members with near others get their full
sets, and these are compared inside tasks as well. Pairs leave a task as links only, and no more of them than join its
components. No bucket is capped and no member is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .core import WHITE, WordHasher, groups, kept, mix, runs


@dataclass(frozen=True)
class Settings:
    """width: words of a shingle. percent: links have 100 * intersection >= percent * union. bands x rows: MinHash
    samples; two texts at 75 percent share a bucket with a probability of 1 - (1 - 0.75**4)**32, over 0.99999.
    sketch_samples, sketch_words: MinHash samples and
    64-bit words of the odd sketch. sigmas: pairs leave when their sketches put them so many standard
    errors under the threshold. block: members of a bucket that a task compares with as many others. held: about so many
    shingles (4 MB) of either side are in a task that compares full sets; a longer text is alone. broadcast_ids: up to so many ids of
    documents with company in a bucket (8 MB) go to all executors to pick their texts; more are joined by a shuffle."""

    width: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    sketch_samples: int = 512
    sketch_words: int = 32
    sigmas: float = 4.5
    block: int = 1024
    held: int = 1 << 19
    broadcast_ids: int = 1_000_000

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    def differing_bits(self) -> int:
        """The most bits in which the sketches of a linked pair may differ."""
        j = self.percent / 100
        low = max(0.0, j - self.sigmas * math.sqrt(j * (1 - j) / self.sketch_samples))
        bits = 64 * self.sketch_words
        expected = bits / 2 * (1 - math.exp(-4 * self.sketch_samples * (1 - low) / bits))
        return math.ceil(expected)


def shingle_sets(texts: list[str | None], hasher: WordHasher, width: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes: none without words, one for the whole sequence when it is short."""
    h, offsets = hasher.words(texts)
    whole = runs(h, width)
    for k in range(len(texts)):
        first, end = offsets[k], offsets[k + 1]
        if end - first >= width:
            yield np.unique(whole[first : end - width + 1])
        elif end > first:
            yield runs(h[first:end], int(end - first))
        else:
            yield np.empty(0, np.uint64)


class Signer:
    def __init__(self, s: Settings):
        self.s = s
        rng = np.random.default_rng(20_250_101)
        self.factor = rng.integers(1, 2**62, max(s.samples, s.sketch_samples), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.place = np.arange(s.sketch_samples, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def samples(self, shingles: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 1024):
            part = np.multiply.outer(self.factor[:n], shingles[at : at + 1024])
            np.minimum(out, part.min(axis=1), out=out)
        return out

    def buckets(self, shingles: np.ndarray) -> np.ndarray:
        parts = self.samples(shingles, self.s.samples).reshape(self.s.bands, self.s.rows)
        out = np.arange(self.s.bands, dtype=np.uint64)
        for k in range(self.s.rows):
            out = mix(out ^ parts[:, k])
        return out.view(np.int64)

    def sketch(self, shingles: np.ndarray) -> np.ndarray:
        samples = self.samples(shingles, self.s.sketch_samples)
        bits = (mix(samples + self.place) % np.uint64(64 * self.s.sketch_words)).astype(np.int64)
        odd = np.bincount(bits, minlength=64 * self.s.sketch_words) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _flat_lists(rows: list[np.ndarray], width: int, kind=np.int64) -> pa.Array:
    values = np.concatenate(rows) if rows else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(values))


def signatures(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """(id, n, print, buckets) of each row; print identifies the shingle set; empty sets have empty arrays."""

    def sign(batches):
        hasher, signer = WordHasher(WHITE), Signer(s)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at, to in groups(texts):
                n, prints, buckets = [], [], []
                for shingles in shingle_sets(texts[at:to], hasher, s.width):
                    n.append(len(shingles))
                    prints.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                    buckets.append(signer.buckets(shingles))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, to - at), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), _flat_lists(buckets, s.bands)],
                    ["id", "n", "print", "buckets"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(sign, f"id {kind}, n bigint, print binary, buckets array<bigint>")


def full_sets(docs: DataFrame, s: Settings) -> DataFrame:
    """(id, sketch, shingles) of docs (id, text); shingles are the hashes, sorted, as little-endian bytes."""

    def sets(batches):
        hasher, signer = WordHasher(WHITE), Signer(s)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at, to in groups(texts):
                got = list(shingle_sets(texts[at:to], hasher, s.width))
                sketches = _flat_lists([signer.sketch(x) for x in got], s.sketch_words)
                yield pa.RecordBatch.from_arrays([ids.slice(at, to - at), sketches, pa.array([x.tobytes() for x in got], pa.binary())], ["id", "sketch", "shingles"])

    return docs.mapInArrow(sets, f"id {docs.schema['id'].dataType.simpleString()}, sketch array<bigint>, shingles binary")


def _bits_apart(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda t, x: t + x)


def _sizes_fit(a: str, b: str, s: Settings):
    return F.lit(100) * F.least(a, b) >= F.lit(s.percent) * F.greatest(a, b)


def confirmed(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The links among pairs (a, b): sketches screen them, full sets decide."""

    def at(df, column, name, end):
        return df.join(column.select(F.col("id").alias(end), F.col(name).alias(f"{name}_{end}")), end)

    screened = at(at(pairs, sketches, "sketch", "a"), sketches, "sketch", "b")
    screened = screened.where(_bits_apart("sketch_a", "sketch_b") <= s.differing_bits()).select("a", "b")

    def decide(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for x, y in zip(a, b):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= s.percent * (len(x) + len(y) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return at(at(screened, sets, "shingles", "a"), sets, "shingles", "b").select("a", "b", "shingles_a", "shingles_b").mapInArrow(decide, f"a {kind}, b {kind}")


def _offered(members: DataFrame, s: Settings) -> DataFrame:
    """The members (bucket, id, n, component, sketch, buckets) that have a pair, of one bucket and different components,
    whose sketches pass: (bucket, i, j, x, y, side, id, component, buckets). The pairs of each (bucket, i, j, x, y) are of a
    member of side 0 and one of side 1. No pair leaves a task, only its members do. Large buckets are compared block by
    block; x and y cut a block so that a side has about `held` shingles at most. A pair counts in the first of the buckets
    that it shares only, else its full sets would be compared as often as it shares buckets.

    Members of a bucket's largest component need no comparison with each other. They have blocks of their own, which meet
    only those of the other members: after the round with pivots, nearly all of a large bucket is in that component, so
    its members are copied as often as the few others have blocks, and not as often as the bucket has."""
    parts = members.groupBy("bucket", "component").agg(F.count("*").alias("part"))
    size = parts.groupBy("bucket").agg(F.max(F.struct("part", "component")).alias("top"), F.sum("part").alias("size"))
    size = size.select(
        "bucket", F.col("top.component").alias("main"),
        F.ceil(F.col("top.part") / s.block).cast("int").alias("main_blocks"), F.ceil((F.col("size") - F.col("top.part")) / s.block).cast("int").alias("blocks"),
    )
    is_main = F.col("component") == F.col("main")
    block = lambda n: F.pmod(F.xxhash64("id", F.lit(7)), n)
    dealt = (
        members.join(size, "bucket")
        .withColumn("own", F.when(is_main, F.col("blocks") + block(F.col("main_blocks"))).otherwise(block(F.col("blocks"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1 + F.when(is_main, 0).otherwise(F.col("main_blocks")))))
        .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "component", "sketch", "buckets")
    )

    def compare(table: pa.Table) -> pa.Table:
        bucket, i, j = (table.column(c)[0].as_py() for c in ("bucket", "i", "j"))
        own, n = table.column("own").to_numpy(), table.column("n").to_numpy()
        near = _Near(table, n, bucket, i == j, s)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found = [(u, v) for u in left if len(v := near(u, right))]
        if not found:
            return table.slice(0, 0).select(["bucket", "i", "j", "i", "j", "own", "id", "component", "buckets"]).rename_columns(names)
        # about `held` shingles a side
        ones, twos = np.array([u for u, _ in found]), np.unique(np.concatenate([v for _, v in found]))
        x, y = np.cumsum(n[ones]) // s.held, np.zeros(len(own), np.int64)
        y[twos] = np.cumsum(n[twos]) // s.held
        rows: list[np.ndarray] = []
        for part in np.unique(x):
            some = [found[k] for k in np.flatnonzero(x == part)]
            for other in np.unique(y[np.concatenate([v for _, v in some])]):
                meet = [(u, v[y[v] == other]) for u, v in some]
                us, vs = [u for u, v in meet if len(v)], np.unique(np.concatenate([v for _, v in meet]))
                rows.append(np.array([(part, other, 0, k) for k in us] + [(part, other, 1, k) for k in vs]))
        x, y, side, k = np.concatenate(rows).T
        out = table.take(pa.array(k)).select(["bucket", "i", "j", "id", "component", "buckets"])
        for at, (name, values) in enumerate((("x", x), ("y", y), ("side", side))):
            out = out.add_column(3 + at, name, pa.array(values, pa.int32()))
        return out

    kinds = {"bucket": "bigint", "i": "int", "j": "int", "x": "int", "y": "int", "side": "int", "id": "bigint", "component": "bigint", "buckets": "array<bigint>"}
    names = list(kinds)
    return dealt.groupBy("bucket", "i", "j").applyInArrow(compare, ", ".join(f"{c} {kind}" for c, kind in kinds.items()))


class _Near:
    """The members of a bucket whose sketches are near to that of one of them, nearest first."""

    def __init__(self, table: pa.Table, n: np.ndarray, bucket: int, same: bool, s: Settings):
        self.n, self.bucket, self.same, self.s = n, bucket, same, s
        self.ids, self.component = (table.column(c).to_numpy() for c in ("id", "component"))
        # unsigned, as bitwise_count takes the absolute value of signed numbers
        self.sketch = np.asarray(table.column("sketch").combine_chunks().flatten()).view(np.uint64).reshape(len(n), -1)
        self.bands = np.asarray(table.column("buckets").combine_chunks().flatten()).reshape(len(n), -1)
        self.most = s.differing_bits()

    def __call__(self, u: int, among: np.ndarray) -> np.ndarray:
        """Those of other components that the sketches tell to be linked with u, if this is the first bucket both share.
        With `same`, members meet themselves, and a pair counts for the smaller id."""
        n, own = self.n[among], self.n[u]
        fit = (self.component[among] != self.component[u]) & (100 * np.minimum(n, own) >= self.s.percent * np.maximum(n, own))
        if self.same:
            fit &= self.ids[among] > self.ids[u]
        v = among[fit]
        apart = np.bitwise_count(self.sketch[v] ^ self.sketch[u]).sum(axis=1)
        close = apart <= self.most
        v, apart = v[close], apart[close]
        first = (self.bands[v] == self.bands[u]).argmax(axis=1)
        own_first = self.bands[u][first] == self.bucket
        v, apart = v[own_first], apart[own_first]
        return v[np.argsort(apart, kind="stable")]


def _linked(offered: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) among what _offered() gives, told from the full sets inside tasks: of each task as many as join all
    components that its links join, one fewer than components at most. A pair whose components are joined already is
    passed over, any other is compared in full."""

    def compare(table: pa.Table) -> pa.Table:
        raw = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        n = np.array([len(x) for x in raw])
        near = _Near(table, n, table.column("bucket")[0].as_py(), table.column("i")[0].as_py() == table.column("j")[0].as_py(), s)
        side = table.column("side").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        distinct, codes = np.unique(np.concatenate(raw), return_inverse=True)
        codes = np.split(codes, np.cumsum(n)[:-1])
        inside, root = np.zeros(len(distinct), bool), {}

        def top(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        a, b = [], []
        component = near.component.tolist()
        for u in left:
            inside[codes[u]] = True
            for v in near(u, right):
                one, two = top(component[u]), top(component[v])
                if one == two:
                    continue
                both = np.count_nonzero(inside[codes[v]])
                if both and 100 * both >= s.percent * (n[u] + n[v] - both):
                    root[two] = one
                    a.append(near.ids[u])
                    b.append(near.ids[v])
            inside[codes[u]] = False
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    full = offered.join(sets, "id")
    return full.groupBy("bucket", "i", "j", "x", "y").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row for each row of docs: (doc_id, n_shingles, component_id, kept).

    Two rows are linked when 100 * intersection >= percent * union of their distinct shingles; component_id is the
    smallest id that is reachable, kept whether it is the row's own. Ids are integers.

    Null and empty texts, and texts without words, have no shingles and are linked with nothing. Very long texts are cut
    into shingles whole, in pieces of bounded size. Rows that share an id
    are rows of one document: what is linked with one is linked with all. A row without an id is linked with nothing,
    has no component_id and is kept. Shorter texts than a shingle are one shingle. An empty table gives no rows; other
    columns of docs are not looked at.
    """
    s = settings
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    sign = kept(signatures(docs, "id", "text", s))
    named = sign.where("n > 0 and id is not null")
    classes = named.groupBy("print").agg(F.min("id").alias("class"))
    member = named.select("id", "print").join(classes, "print").select("id", "class")
    reps = sign.join(classes.select(F.col("class").alias("id"), "print"), ["id", "print"], "left_semi").select("id", "n", "buckets")
    repeated = named.groupBy("id").count().where("count > 1").limit(1).count() > 0
    if repeated:
        reps = reps.dropDuplicates(["id", "buckets"])
    banded = reps.select("id", "n", F.explode("buckets").alias("bucket"))
    crowded = banded.groupBy("bucket").agg(F.min_by("id", F.xxhash64("bucket", "id")).alias("pivot"), F.min("id").alias("low"), F.max("id").alias("high")).where("low != high").select("bucket", "pivot")
    members = kept(banded.join(crowded, "bucket"))
    at_pivot = (
        members.where("id != pivot").select("bucket", "id", "n", "pivot")
        .join(reps.select(F.col("id").alias("pivot"), F.col("n").alias("m")), "pivot")
        .where(_sizes_fit("n", "m", s))
        .select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
        .distinct()
    )
    ids = kept(members.select("id").distinct())
    if ids.count() <= s.broadcast_ids:
        ids = F.broadcast(ids)
    compared = docs.join(ids, "id", "left_semi")
    sets = kept(full_sets(compared.dropDuplicates(["id", "text"]) if repeated else compared, s))

    sketches = sets.select("id", "sketch")
    signed = sign.where("n > 0").select("id", "buckets")
    if repeated:
        signed = signed.distinct()

    # rows of one document that have different texts are in different classes
    several = member.where("id != class").select(F.col("id").alias("a"), F.col("class").alias("b"))
    links = kept(confirmed(kept(at_pivot), sketches, sets, s))
    found = connected_components(links)
    split = members.join(found, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
    mixed = split.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
    # two members of a bucket have been compared: one is the pivot
    mixed = mixed.where("low != high and size > 2").select("bucket")
    open_ = split.join(mixed, "bucket", "left_semi").join(sketches.join(signed, "id"), "id")
    open_ = kept(open_.where(F.array_contains("buckets", F.col("bucket"))) if repeated else open_)
    links = links.unionByName(kept(_linked(_offered(open_, s), sets, s)))
    found = connected_components(links.unionByName(several.distinct()))
    final = member.join(found.select(F.col("id").alias("class"), "component"), "class", "left")
    final = final.groupBy("id").agg(F.min(F.coalesce("component", "class")).alias("component"))
    return (
        sign.select("id", "n").join(final, "id", "left")
        .select(
            F.col("id").alias("doc_id"),
            F.col("n").alias("n_shingles"),
            F.coalesce("component", "id").alias("component_id"),
            (F.col("id").isNull() | (F.col("id") == F.coalesce("component", "id"))).alias("kept"),
        )
    )
