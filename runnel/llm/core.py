"""Shared helpers of the language-model data operators.

Text enters Python as Arrow batches and is processed in byte pieces of bounded size, so the memory of a task does not
follow the size of a batch. Words are hashed with a vectorised polynomial hash: one pass over the bytes, no Python loop
over words.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are held as arrays at a time. A worker has some 48 bytes of arrays for each of them, and an executor
#: has a worker for each core and step of a stage, also idle ones.
PIECE_BYTES = 1 << 18

_SEED = np.random.default_rng(0x5EED)
_BYTE_VALUE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
#: Odd multipliers of the places in a run of words.
PLACE = _SEED.integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def separators(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Which of the 256 byte values separate words."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Words are runs of anything but ASCII white space.
WHITE = separators([(0x20, 0x20), (0x09, 0x0D)])
#: Words are runs of digits, letters and whatever is outside ASCII; after lower-casing no byte is in A-Z.
NOT_WORD = separators([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
#: Words are runs of letters of any script; digits separate as well.
NOT_LETTER = separators([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


class WordHasher:
    """Hashes the words of texts. A-Z count as a-z; a word is a longest run of bytes that do not separate."""

    def __init__(self, separates: np.ndarray, piece: int = PIECE_BYTES):
        self.separates, self.piece = separates, piece
        value = _BYTE_VALUE.copy()
        value[ord("A") : ord("Z") + 1] = value[ord("a") : ord("z") + 1]
        self.value = value
        self.power = _powers(_BASE, piece + 1)
        self.inverse = _powers(_BASE_INVERSE, piece + 1)

    def _grow(self, n: int) -> None:
        if n >= len(self.power):
            self.power, self.inverse = _powers(_BASE, n + 1), _powers(_BASE_INVERSE, n + 1)

    def _piece(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._grow(len(buf))
        inside = np.zeros(len(buf) + 2, np.int8)
        inside[1:-1] = ~self.separates[buf]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(start):
            return np.empty(0, np.uint64), start, end
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.value[buf] * self.power[: len(buf)], out=total[1:])
        h = (total[end] - total[start]) * self.inverse[start]
        return mix(h + (end - start).astype(np.uint64)), start, end

    def words(self, texts: list[str | None], places: bool = False):
        """The hashes of all words, the offset of each text's first word (one more than texts) and, with places, the
        words' first and end byte in the joined texts. A null has no words."""
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        joined = b" ".join(raw)
        first = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) + 1 for r in raw], out=first[1:])
        data = np.frombuffer(joined, np.uint8)
        hashes, starts, ends, at = [], [], [], 0
        while at < len(data):
            to = min(at + self.piece, len(data))
            while to < len(data) and not self.separates[data[to]]:
                gap = np.flatnonzero(self.separates[data[to : to + 65536]])
                to = to + int(gap[0]) if len(gap) else min(to + 65536, len(data))
            h, s, e = self._piece(data[at:to])
            hashes.append(h)
            starts.append(s + at)
            ends.append(e + at)
            at = to
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        s = np.concatenate(starts) if starts else np.empty(0, np.int64)
        offsets = np.searchsorted(s, first)
        if not places:
            return h, offsets
        e = np.concatenate(ends) if ends else s
        return h, offsets, s, e, first, joined


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n following words, whatever texts they are from."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1] * PLACE[0]
    for k in range(1, n):
        out += h[k : len(h) - n + 1 + k] * PLACE[k % len(PLACE)]
    return mix(out + np.uint64(n))


def groups(texts: list[str | None], limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Cuts a batch into stretches of about `limit` characters; a longer text stands alone."""
    at, held = 0, 0
    for k, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if held and held + n > limit:
            yield at, k
            at, held = k, 0
        held += n
    if at < len(texts):
        yield at, len(texts)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. It is set here only where nobody
    has set it and the master is local, as in tests."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file:///tmp/checkpoints/runnel"
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder, so a lost executor costs no earlier work."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle and checkpoint files of data that nothing refers to any more. The cleaner learns
    of such data when the driver collects its garbage, which iterative jobs with a small heap seldom make it do."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unused(name: str, columns: list[str]) -> str:
    """name, with as many underscores as tell it from all columns (letter case does not)."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out_mod(doc_id, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus
