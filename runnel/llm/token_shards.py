"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their identifiers. Layout:

    data blocks   entries; each is varint(shared key bytes), varint(other key bytes), varint(value bytes), key, value;
                  the block is compressed as a whole and its first key is complete
    block index   for each block: first key, offset, bytes, raw bytes, entries, token ids before it
    Bloom filter  over the identifiers
    footer        fixed size: places of index and filter, counts, width of a token id, crc32 of index and filter, magic

A key is 13 bytes that sort like the documents: 1 if there is an identifier (else 0), the identifier big-endian with its
sign bit turned, and the number of the row among rows of the same identifier. A value is the token ids, little-endian,
in 2 or 4 bytes each. A lookup reads footer, filter and index, searches the index by bisection and unpacks one block.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .core import kept, mix

MAGIC = b"RNLSST01"
FOOTER, INDEX = "<QQQQQQII8s", "<13sQIIIQ"
FOOTER_BYTES = struct.calcsize(FOOTER)
BLOOM_BITS, BLOOM_HASHES = 10, 7


@dataclass(frozen=True)
class Settings:
    """block_bytes and shard_bytes: a block or shard is closed once it holds so many bytes of values (before
    compression). end_id is added to each document. cached: about how many distinct pieces of text a
    worker remembers the ids of."""

    end_id: int = 2
    block_bytes: int = 1 << 16
    shard_bytes: int = 1 << 26
    cached: int = 300_000


# ---------------------------------------------------------------- encoding

#: Classes of bytes: blanks, other ASCII white space, letters, digits, other ASCII, apostrophes, bytes beyond ASCII.
_BLANK, _WHITE, _LETTER, _DIGIT, _OTHER, _QUOTE, _BEYOND = range(7)
_CLASS = np.full(256, _OTHER, np.uint8)
for _low, _high, _class in ((9, 13, _WHITE), (32, 32, _BLANK), (39, 39, _QUOTE), (48, 57, _DIGIT), (65, 90, _LETTER), (97, 122, _LETTER), (128, 255, _BEYOND)):
    _CLASS[_low : _high + 1] = _class
#: Whether the tokenizer always cuts between bytes of two classes, by 8 * first + second. It may join an apostrophe with
#: letters after it, a blank with anything, and what letters beyond ASCII do is left to it.
_CUTS = np.zeros(64, bool)
for _class, _after in (
    (_WHITE, (_LETTER, _DIGIT, _OTHER, _QUOTE, _BEYOND)), (_LETTER, (_BLANK, _WHITE, _DIGIT, _OTHER, _QUOTE)), (_DIGIT, (_BLANK, _WHITE, _LETTER, _OTHER, _QUOTE)),
    (_OTHER, (_BLANK, _WHITE, _LETTER, _DIGIT)), (_QUOTE, (_BLANK, _WHITE, _DIGIT)), (_BEYOND, (_BLANK, _WHITE)),
):
    _CUTS[[8 * _class + k for k in _after]] = True
#: What is white space for some libraries only, or outside ASCII, may run on into ASCII white space; such texts are not cut.
_OTHER_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_PLAIN = re.compile(r" ?[^ \t\n\r\f\v]+")


class Encoder:
    """Encodes texts with a byte-level BPE of the tokenizers library.

    Such a tokenizer first cuts text where the class of characters changes and encodes what is between on its own, so each
    distinct piece is encoded once and its ids are reused. Texts for which that might not hold are encoded whole. Pieces
    are cut and looked up as Arrow arrays over the bytes of many texts; only pieces not seen before become strings.

    New pieces are encoded a few thousand at a time, joined by line ends, whose ids then part them: the library's encodings
    are many times larger than the ids in them. It uses one thread, as tasks already use all cores.
    """

    at_once = 4096

    def __init__(self, path: str, cached: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), cached
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile(b"|".join(re.escape(x.encode()) for x in [*_OTHER_SPACE, *added]))
        # the cuts are those of one way to split text; a file that splits or rewrites text otherwise gets whole texts
        asked = json.loads(self.tokenizer.to_str())
        split = asked["pre_tokenizer"] or {}
        self.cuts = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not asked["normalizer"] and not asked["truncation"]
        if not self.cuts:
            return
        (self.line_end,) = self._ids("\n")
        self.place: dict[str, int] = {}
        self.ids, self.first, self.used = np.empty(0, np.uint32), np.zeros(1, np.int64), np.empty(0, np.int32)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _gather(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known pieces, and their number before each piece and at the end."""
        n = self.first[own + 1] - self.first[own]
        before = np.append(0, np.cumsum(n))
        return self.ids[np.repeat(self.first[own] - before[:-1], n) + np.arange(before[-1])], before

    def _forget(self) -> None:
        """Keeps the pieces that were used again since the last time, unless they are most."""
        again = np.flatnonzero(self.used > 1)
        if 2 * len(again) > self.limit:
            again = again[:0]
        names = list(self.place)
        self.place = {names[k]: n for n, k in enumerate(again.tolist())}
        (self.ids, self.first), self.used = self._gather(again), np.zeros(len(again), np.int32)

    def _learn(self, pieces: list[str]) -> None:
        plain, other = [], []
        for p in pieces:
            (plain if _PLAIN.fullmatch(p) else other).append(p)
        ids, lengths = [self.ids], []
        for at in range(0, len(plain), self.at_once):
            some = plain[at : at + self.at_once]
            got = np.array(self._ids("\n".join(some)), np.uint32)
            ends = np.append(np.flatnonzero(got == self.line_end), len(got))
            if len(ends) != len(some):
                raise ValueError("the tokenizer does not cut at line ends")
            ids.append(got[got != self.line_end])
            lengths.append(np.diff(ends, prepend=-1) - 1)
        for p in other:
            ids.append(np.array(self._ids(p), np.uint32))
            lengths.append(np.array([len(ids[-1])]))
        self.place.update(zip(plain + other, range(len(self.place), len(self.place) + len(pieces))))
        self.used = np.append(self.used, np.zeros(len(pieces), np.int32))
        self.ids = np.concatenate(ids)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(lengths))])

    def _pieces(self, data: np.ndarray, first: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Cuts texts that begin at `first`. For `step` pieces at a time: first byte of each, number of ids before each (both
        with the end of the last), ids."""
        kinds = _CLASS[data]
        cut = np.append(True, _CUTS[kinds[:-1] * np.uint8(8) + kinds[1:]])
        cut[2:][(kinds[:-2] <= _WHITE) & (kinds[1:-1] == _WHITE)] = False  # the last of a run of white space is parted from the others
        cut[first[:-1][first[:-1] < len(data)]] = True
        start = np.append(np.flatnonzero(cut), len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(start) - 1, pa.py_buffer(start), pa.py_buffer(data))
        for at in range(0, len(pieces), step):
            coded = pieces.slice(at, step).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if len(self.place) > self.limit:
                self._forget()
            if new := [p for p in distinct if p not in self.place]:
                self._learn(new)
            known = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))
            self.used[known] += 1
            ids, before = self._gather(known[coded.indices.to_numpy()])
            yield start[at : at + step + 1], before, ids

    def __call__(self, texts: pa.StringArray, step: int = 1 << 20) -> Iterator[np.ndarray]:
        """The ids of each text; step pieces are held as arrays at a time."""
        texts = texts.fill_null("")
        if not self.cuts:
            yield from (np.array(self._ids(t), np.uint32) for t in texts.to_pylist())
            return
        _, offsets, content = texts.buffers()
        first = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(content or b"", np.uint8)[first[0] : first[-1]]
        first = first - first[0]
        whole = sorted({int(np.searchsorted(first, m.start(), "right")) - 1 for m in self.whole.finditer(data)})
        if whole:
            cut = texts.to_pandas()
            apart = {k: self._ids(cut.iat[k]) for k in whole}
            cut.iloc[whole] = ""
            for k, ids in enumerate(self(pa.array(cut, pa.string()), step)):
                yield np.array(apart[k], np.uint32) if k in apart else ids
            return
        parts, k = [], 0
        for start, before, ids in self._pieces(data, first, step) if len(data) else ():
            at = 0
            while k < len(texts) and first[k + 1] <= start[-1]:
                to = int(before[np.searchsorted(start, first[k + 1])])
                yield np.concatenate([*parts, ids[at:to]])
                parts, at, k = [], to, k + 1
            parts.append(ids[at:])
        for _ in range(k, len(texts)):
            yield np.empty(0, np.uint32)


# ---------------------------------------------------------------- the format

def key_of(doc_id: int | None, ordinal: int) -> bytes:
    if doc_id is None:
        return struct.pack(">BQI", 0, 0, ordinal)
    return struct.pack(">BQI", 1, (doc_id + (1 << 63)) % (1 << 64), ordinal)


def id_of(key: bytes) -> int | None:
    there, value, _ = struct.unpack(">BQI", key)
    return value - (1 << 63) if there else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _bloom_places(ids: np.ndarray, bits: int) -> np.ndarray:
    h = mix(ids.astype(np.int64).view(np.uint64))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


class ShardWriter:
    def __init__(self, folder: str, width: int, s: Settings):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.name = f"{uuid.uuid4().hex}.sst"
        self.out = self.files.open_output_stream(f"{self.folder}/{self.name}")
        self.codec, self.width, self.s = pa.Codec("zstd", 1), width, s
        self.at = self.entries = self.tokens = self.in_block = 0
        self.block, self.index, self.ids, self.last, self.first_key = bytearray(), bytearray(), [], b"", b""
        self.block_key, self.block_tokens = b"", 0

    def add(self, doc_id: int | None, ordinal: int, ids: np.ndarray) -> None:
        key, value = key_of(doc_id, ordinal), ids.astype(f"<u{self.width}").tobytes()
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.block_key, self.block_tokens = key, self.tokens
        self.first_key = self.first_key or key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.in_block = key, self.in_block + 1
        self.entries, self.tokens = self.entries + 1, self.tokens + len(ids)
        if doc_id is not None:
            self.ids.append(doc_id)
        if len(self.block) >= self.s.block_bytes:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            raw = bytes(self.block)
            packed = self.codec.compress(raw, asbytes=True)
            self.out.write(packed)
            self.index += struct.pack(INDEX, self.block_key, self.at, len(packed), len(raw), self.in_block, self.block_tokens)
            self.at += len(packed)
            self.block, self.in_block = bytearray(), 0

    def close(self) -> tuple[str, bytes, int, int]:
        self._end_block()
        bits = max(64, BLOOM_BITS * len(self.ids))
        on = np.zeros((bits + 7) // 8 * 8, np.uint8)
        if self.ids:
            on[_bloom_places(np.array(self.ids, np.int64), bits).ravel().astype(np.int64)] = 1
        index, bloom = bytes(self.index), np.packbits(on, bitorder="little").tobytes()
        self.out.write(index)
        self.out.write(bloom)
        self.out.write(struct.pack(FOOTER, self.at, len(index), self.at + len(index), bits, self.entries, self.tokens, self.width, zlib.crc32(index + bloom), MAGIC))
        self.out.close()
        return self.name, self.first_key, self.entries, self.tokens


class Shard:
    """Reads a shard from anything that gives bytes by place: read_at(offset, n)."""

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        index_at, index_n, bloom_at, self.bits, self.entries, self.tokens, self.width, crc, magic = struct.unpack(FOOTER, read_at(size - FOOTER_BYTES, FOOTER_BYTES))
        index, self.bloom = read_at(index_at, index_n), read_at(bloom_at, (self.bits + 7) // 8)
        if magic != MAGIC or zlib.crc32(index + self.bloom) != crc:
            raise ValueError("not a token shard, or a damaged one")
        self.blocks = list(struct.iter_unpack(INDEX, index))
        self.codec = pa.Codec("zstd")

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, packed, raw, n, _ = self.blocks[k]
        data = self.codec.decompress(self.read_at(at, packed), raw, asbytes=True)
        at, key = 0, b""
        for _ in range(n):
            shared, at = _read_varint(data, at)
            other, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + other]
            at += other
            yield key, np.frombuffer(data, f"<u{self.width}", size // self.width, at)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def may_hold(self, doc_id: int) -> bool:
        places = _bloom_places(np.array([doc_id], np.int64), self.bits)[0]
        return all(self.bloom[int(p) >> 3] >> (int(p) & 7) & 1 for p in places)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each row of that identifier, by bisection of the block index."""
        if doc_id is not None and not self.may_hold(doc_id):
            return []
        low, high = key_of(doc_id, 0), key_of(doc_id, (1 << 32) - 1)
        k = max(0, bisect.bisect_right(self.blocks, low, key=lambda b: b[0]) - 1)
        found = []
        while k < len(self.blocks) and self.blocks[k][0] <= high:
            found += [ids for key, ids in self.block(k) if low <= key <= high]
            k += 1
        return found


# ---------------------------------------------------------------- Spark

def spans(texts: pa.StringArray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Cuts a batch into stretches of about `limit` bytes; a longer text stands alone."""
    end = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    at = 0
    while at < len(end):
        to = int(np.searchsorted(end, (end[at - 1] if at else 0) + limit, "right"))
        yield at, max(to, at + 1)
        at = max(to, at + 1)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes docs and writes shards to folder, which driver and executors share. Returns the manifest, a row for each
    shard: (shard, first_key, entries, tokens, start). start is the number of token ids in all shards before it.

    Rows are dealt out by ranges of the identifier and sorted by identifier, then text. A lost task writes its files anew
    under other names; only files that the manifest names count. Null texts are empty; rows without an identifier come
    first; repeated rows are all kept. Texts are encoded whole, however long. Of an empty table the manifest has no rows.
    Columns of docs other than the two named are not looked at. With a tokenizer file that does not split text as byte-level
    BPE usually does, each text is given to the library in one piece, which is slower.
    """
    s = settings
    own = docs.sparkSession.sparkContext.broadcast({})  # each Python worker has a copy, which holds its encoder from task to task

    def write(batches):
        shard, held, last, ordinal, done = None, 0, (), 0, []
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.string())
            encode = own.value.get("encoder")
            if not encode:
                encode = own.value["encoder"] = Encoder(tokenizer, s.cached)
            width = 2 if max(encode.tokenizer.get_vocab_size(), s.end_id + 1) <= 1 << 16 else 4
            for at, to in spans(texts):
                for doc_id, tokens in zip(ids[at:to], encode(texts.slice(at, to - at))):
                    ordinal = ordinal + 1 if last == (doc_id,) else 0
                    last = (doc_id,)
                    if shard and held >= s.shard_bytes:
                        done.append(shard.close())
                        shard = None
                    if not shard:
                        shard, held = ShardWriter(folder, width, s), 0
                    tokens = np.append(tokens, np.uint32(s.end_id))
                    shard.add(doc_id, ordinal, tokens)
                    held += len(tokens) * width
        if shard:
            done.append(shard.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.binary(), pa.int64(), pa.int64()))], ["shard", "first_key", "entries", "tokens"])

    ranged = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")
    manifest = kept(ranged.mapInArrow(write, "shard string, first_key binary, entries bigint, tokens bigint"))
    before = F.sum("tokens").over(Window.orderBy("first_key").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)))


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame, tokens: bool = False) -> DataFrame:
    """What the shards of the manifest hold, a row for each document: (doc_id, start, n_tokens, ids_crc32) and, with
    tokens, tokens. Rows come from the files; start counts the ids of all documents before. An empty manifest has no rows."""

    def parse(batches):
        for batch in batches:
            for start, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = memoryview(content.as_buffer())
                shard = Shard(lambda at, n: bytes(data[at : at + n]), len(data))
                rows: tuple[list, ...] = ([], [], [], [], [])
                for key, ids in shard:
                    wide = ids.astype("<u4")
                    for column, value in zip(rows, (id_of(key), start, len(ids), zlib.crc32(wide.tobytes()), wide.view(np.int32) if tokens else None)):
                        column.append(value)
                    start += len(ids)
                columns = [pa.array(c, pa.int64()) for c in rows[:4]] + ([pa.array(rows[4], pa.list_(pa.int32()))] if tokens else [])
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "tokens"][: len(columns)])

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", tokens array<int>" * tokens
    if manifest.limit(1).count() == 0:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")
    return named.join(F.broadcast(manifest.select("shard", "start")), "shard").select("start", "content").mapInArrow(parse, schema)


def lookup(folder: str, shard: str, doc_id: int | None) -> list[np.ndarray]:
    """The token ids of the rows of one identifier, from one shard."""
    files, path = fs.FileSystem.from_uri(folder)
    with files.open_input_file(f"{path}/{shard}") as f:
        return Shard(lambda at, n: f.read_at(n, at), f.size()).get(doc_id)
