"""Token-id shards: one zstandard frame per document, one shared dictionary, an offset index.

A data set is a folder of shard files plus ``dict.zst``. A shard holds, in
ascending document order, one frame per document (its ids as little-endian
unsigned integers, compressed with the shared dictionary), then an index
(document id, null flag, frame offset, token count) and a footer with the
dictionary's hash. One document is read with three small reads: footer,
index, frame. The dictionary is trained on the serialised ids of a bounded
sample of documents; every document is encoded whole.

Writing is two jobs: tokenise into a durable table, then deal frames by id
range and write shards. A shard's name carries the writing attempt, and only
shards named by the written manifest count, so that lost or repeated tasks
leave at most unused files.

Defined cases: null text is the empty text (just the end id); null ids come
first; rows with equal ids are ordered by token count and content; an empty
table gives an empty data set; texts of any length are one frame, encoded
whole; other columns, whatever their names, are not read. A sample of under 16
texts or 8 KiB of ids, or one that the trainer refuses, gives no dictionary: frames are then plain zstandard,
the footer has the hash of the empty string and the manifest's ``dictionary`` is null.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import arrow_column, by_least_hash, drop_scratch, open_fs, release, shared_dir

MAGIC = b"TOKSHRD1"
_FOOTER = struct.Struct("<QQQB32s8s")
#: White space (and the control characters that some call so) with a space after it.
_GAP = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
#: A letter with ASCII punctuation after it, and a single line end between characters that are no white space.
_LETTER_END = r"([A-Za-zÀ-ÖØ-öø-ɏ])([!-/:-@\[-`{-~])"
_LINE_END = "([!-~À-ɏ])\n([!-~À-ɏ])"
_PROBE = ["It's a\n\ntest, don't\tstop 123 Été! x2\n", "", "tail ", "\U0001f642 日本 語ü\u0308 ²½", "A b,\nC"]


class Encoder:
    """Serialised token ids of texts by the tokenizers library, many at a time, remembering pieces.

    A byte-level split begins a new pre-token at every space that follows anything
    but white space, where letters end and punctuation follows, and at both sides of
    a single line end; what it does from there on depends on nothing before. A
    splitter that drops white space ends a pre-token there too. Merges never cross
    pre-tokens, so a text's ids are those of its pieces between such places in
    order (with the space that leads them, or without). The library encodes each
    piece that isn't remembered; pieces are parted by a special token's string, which the
    library cuts out before all else. Texts with white space before a space, with
    a zero character or with a special token's string go to the library whole, as
    do all texts where a probe shows another rule.

    Pieces of up to 64 characters are remembered, in two generations of about ``memory``
    bytes; the older one is dropped when the younger is full.
    """

    def __init__(self, path: str, width: int = 4, memory: int = 100 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.stop = next(((k, t.content) for k, t in sorted(added.items()) if k < 1 << 8 * width), None)
        self.kind, self.width, self.memory = f"<u{width}", width, memory
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held, self.lead = 0, None
        if self.stop:
            want = [self._whole(t) for t in _PROBE]
            for lead in ("\0 ", "\0"):
                self.lead, self.young = lead, {}
                if self._pieces(pa.array(_PROBE)) == want:
                    break
            else:
                self.lead = None

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _learn(self, pieces: list[str]) -> Iterator[bytes]:
        stop, mark = self.stop
        for k in range(0, len(pieces), 1000):
            some = pieces[k : k + 1000]
            (got,) = self.tokenizer.encode_batch_fast([mark.join(some)], add_special_tokens=False)
            ids = np.array(got.ids, self.kind)
            ends = np.append(np.flatnonzero(ids == stop), len(ids))
            if len(ends) != len(some):
                yield from map(self._whole, some)
                continue
            raw, w, start = ids.tobytes(), self.width, 0
            for e in ends.tolist():
                yield raw[start * w : e * w]
                start = e + 1

    def _values(self, pieces: list[str]) -> list[bytes]:
        out = list(map(self.young.get, pieces))
        new = []
        for k in [k for k, v in enumerate(out) if v is None]:
            if (v := self.old.get(pieces[k])) is None:
                new.append(k)
            else:
                out[k] = v
                self._keep(pieces[k], v)
        for k, v in zip(new, self._learn([pieces[k] for k in new]), strict=True):
            out[k] = v
            self._keep(pieces[k], v)
        return out

    def _keep(self, piece: str, ids: bytes) -> None:
        if len(piece) > 64:
            return
        self.held += 200 + len(piece) + len(ids)
        if self.held > self.memory:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[piece] = ids

    def _pieces(self, array: pa.Array) -> list[bytes]:
        led = pc.replace_substring_regex(pc.replace_substring(array, " ", self.lead), _LETTER_END, "\\1\0\\2")
        lists = pc.split_pattern(pc.replace_substring_regex(led, _LINE_END, "\\1\0\n\0\\2"), "\0")
        coded = lists.flatten().dictionary_encode()
        values = pa.array(self._values(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        _, offsets, data = values.buffers()
        ends = np.frombuffer(offsets, np.int64, len(values) + 1) if len(values) else np.zeros(1, np.int64)
        cut, ids = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist(), memoryview(data or b"")
        return [ids[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]

    def batch(self, array: pa.Array) -> Iterator[bytes]:
        """The serialised ids of every text of an array (null: the empty text), in order."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(array), 0).to_numpy(), dtype=np.int64)
        at = 0
        while at < len(array):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + max(1 << 20, self.memory // 10), "right")))
            part, at = pc.fill_null(array[at:to].cast(pa.large_string()), ""), to
            if self.lead is None:
                yield from (self._whole(t.as_py()) for t in part)
                continue
            odd = pc.or_(pc.match_substring_regex(part, _GAP), pc.match_substring(part, "\0"))
            for s in self.special:
                odd = pc.or_(odd, pc.match_substring(part, s))
            odd = odd.to_numpy(zero_copy_only=False)
            plain = iter(self._pieces(part.filter(pa.array(~odd))) if not odd.all() else ())
            for k, whole in enumerate(odd.tolist()):
                yield self._whole(part[k].as_py()) if whole else next(plain)
            del part, odd, plain
            release()

    def counts(self, array: pa.Array) -> np.ndarray:
        """The number of ids of every text of an array."""
        return np.fromiter((len(x) // self.width for x in self.batch(array)), np.int64, len(array))

    def __call__(self, text: str) -> bytes:
        return next(self.batch(pa.array([text])))


_ENCODERS: dict[tuple[str, int, int], Encoder] = {}


def encoder(path: str, width: int = 4, memory: int = 100 << 20) -> Encoder:
    """The worker's encoder for a tokenizer file; made once a process."""
    if (path, width, memory) not in _ENCODERS:
        _ENCODERS[path, width, memory] = Encoder(path, width, memory)
    return _ENCODERS[path, width, memory]


@dataclass(frozen=True)
class TokenConfig:
    tokenizer: str
    end_id: int = 2
    width: int = 4  # bytes of a stored id: 2 or 4
    level: int = 3
    dictionary_rows: int = 1000
    dictionary_row_chars: int = 20_000
    dictionary_bytes: int = 64 * 1024
    shard_bytes: int = 64 * 1024 * 1024
    memory: int = 100 << 20  # of a worker's younger remembered pieces; a tenth of it is split at a time


def _zdict(raw: bytes):
    import zstandard as z

    return z.ZstdCompressionDict(raw) if raw else None


def train_dictionary(docs: DataFrame, config: TokenConfig, text_col: str = "text") -> bytes:
    """A zstd dictionary of the serialised ids of at most ``dictionary_rows`` texts, least hash first.
    Longer texts than ``dictionary_row_chars`` don't take part; too few samples give no dictionary."""
    import zstandard as z

    drawn = by_least_hash(docs, text_col, 4 * config.dictionary_rows).where((F.length("t") > 0) & (F.length("t") <= config.dictionary_row_chars))
    rows = drawn.groupBy("h").agg(F.min("t").alias("t")).orderBy("h").limit(config.dictionary_rows).collect()
    enc, end = encoder(config.tokenizer, config.width, config.memory), config.end_id.to_bytes(config.width, "little")
    samples = [enc(r["t"]) + end for r in rows]
    if len(samples) < 16 or sum(map(len, samples)) < 8 * 1024:
        return b""
    try:
        return z.train_dictionary(min(config.dictionary_bytes, sum(map(len, samples)) // 8), samples).as_bytes()
    except z.ZstdError:
        return b""


def encode_frames(docs: DataFrame, config: TokenConfig, dictionary: bytes, id_col: str, text_col: str) -> DataFrame:
    """(id, n_tokens, key, frame) of every row; key is a hash of the frame; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(dictionary)

    def frames(array: pa.Array) -> pa.Array:
        import zstandard as z

        enc, end = encoder(config.tokenizer, config.width, config.memory), config.end_id.to_bytes(config.width, "little")
        c = z.ZstdCompressor(level=config.level, dict_data=_zdict(held.value), write_content_size=True)
        n, out = [], []
        for ids in enc.batch(array):
            n.append(len(ids) // config.width + 1)
            out.append(c.compress(ids + end))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["n_tokens", "frame"])

    r = docs.select(F.col(id_col).cast("long").alias("id"), arrow_column(frames, "struct<n_tokens:long,frame:binary>", text_col).alias("r"))
    return r.select("id", F.col("r.n_tokens").alias("n_tokens"), F.xxhash64("r.frame").alias("key"), F.col("r.frame").alias("frame"))


class ShardWriter:
    """Streams one shard to an open file."""

    def __init__(self, out, dictionary_hash: bytes, width: int):
        self.out, self.hash, self.width, self.at = out, dictionary_hash, width, len(MAGIC)
        self.ids, self.nulls, self.offsets, self.counts = [], [], [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, n_tokens: int, frame: bytes) -> None:
        self.ids.append(doc_id or 0), self.nulls.append(doc_id is None), self.offsets.append(self.at), self.counts.append(n_tokens)
        self.out.write(frame)
        self.at += len(frame)

    def close(self) -> int:
        index = b"".join(np.array(x, k).tobytes() for x, k in ((self.ids, "<i8"), (self.nulls, "u1"), ([*self.offsets, self.at], "<u8"), (self.counts, "<u4")))
        packed = zlib.compress(index, 1)
        self.out.write(packed)
        self.out.write(_FOOTER.pack(self.at, len(packed), len(self.ids), self.width, self.hash, MAGIC))
        self.out.close()
        return self.at + len(packed) + _FOOTER.size


class ShardReader:
    """Random access to one shard; ``source`` is a seekable file."""

    def __init__(self, source, dictionary: bytes):
        import zstandard as z

        self.source = source
        size = source.size()
        source.seek(size - _FOOTER.size)
        at, length, n, self.width, digest, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        source.seek(at)
        raw = zlib.decompress(source.read(length))
        cut = np.cumsum([0, 8 * n, n, 8 * (n + 1), 4 * n])
        take = lambda k, kind: np.frombuffer(raw[cut[k] : cut[k + 1]], kind)
        self.ids, self.nulls, self.offsets, self.counts = take(0, "<i8"), take(1, "u1"), take(2, "<u8"), take(3, "<u4")
        self.codec = z.ZstdDecompressor(dict_data=_zdict(dictionary))

    def read(self, k: int) -> np.ndarray:
        self.source.seek(int(self.offsets[k]))
        return self._ids(k, self.source.read(int(self.offsets[k + 1] - self.offsets[k])))

    def _ids(self, k: int, frame: bytes) -> np.ndarray:
        ids = np.frombuffer(self.codec.decompress(frame, max_output_size=int(self.counts[k]) * self.width), f"<u{self.width}")
        if len(ids) != self.counts[k]:
            raise ValueError("a frame does not hold its counted ids")
        return ids

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, reading about 8 MB at a time."""
        k, n = 0, len(self.ids)
        while k < n:
            e = max(k + 1, int(np.searchsorted(self.offsets, self.offsets[k] + np.uint64(4 << 20), "right")) - 1)
            self.source.seek(int(self.offsets[k]))
            base, chunk = int(self.offsets[k]), self.source.read(int(self.offsets[min(e, n)] - self.offsets[k]))
            for j in range(k, min(e, n)):
                yield (None if self.nulls[j] else int(self.ids[j])), self._ids(j, chunk[int(self.offsets[j]) - base : int(self.offsets[j + 1]) - base])
            k = min(e, n)


def write_tokens(docs: DataFrame, path: str, config: TokenConfig, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the data set into the shared folder ``path``: shards/, dict.zst, manifest/."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, config, text_col)
    fs, p = open_fs(path)
    fs.create_dir(f"{p}/shards", recursive=True)
    with fs.open_output_stream(f"{p}/dict.zst", compression=None) as f:
        f.write(dictionary)
    scratch = f"{path}/frames"
    encode_frames(docs, config, dictionary, id_col, text_col).write.option("compression", "none").parquet(scratch)
    frames = spark.read.parquet(scratch)
    total = frames.agg(F.sum(F.octet_length("frame") + 32).alias("b")).first()["b"] or 0
    parts = max(1, -(-total // config.shard_bytes), min(spark.sparkContext.defaultParallelism, total // (1 << 20)))
    named = hashlib.sha256(dictionary).hexdigest() if dictionary else None
    digest, width, limit = hashlib.sha256(dictionary).digest(), config.width, config.shard_bytes

    def shards(batches):
        from pyspark import TaskContext

        part, seq, w, name, tokens, first = TaskContext.get().partitionId(), 0, None, "", 0, True
        out, root = [], open_fs(path)

        def end():
            size = w.close()
            out.append((part, seq, name, len(w.ids), tokens, size, named))

        for b in batches:
            for i, n, frame in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if w is None:
                    name, tokens = f"shards/{part:06d}-{seq:04d}-{uuid.uuid4().hex}.tok", 0
                    w = ShardWriter(root[0].open_output_stream(f"{root[1]}/{name}", compression=None), digest, width)
                w.add(i, n, frame.as_py())
                tokens += n
                if w.at >= limit:
                    end()
                    w, seq = None, seq + 1
        if w is not None:
            end()
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "seq", "file", "docs", "tokens", "bytes", "dictionary"), r, strict=True)) for r in out], pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64()), ("dictionary", pa.string())]))

    # Rows of one id (or of none) may be a third of all: the range goes on by count and content, so that they split.
    order = [F.col("id").asc_nulls_first(), F.col("n_tokens"), F.col("key")]
    ordered = frames.repartitionByRange(int(parts), *order).sortWithinPartitions(*order, "frame").select("id", "n_tokens", "frame")
    ordered.mapInArrow(shards, "part long, seq long, file string, docs long, tokens long, bytes long, dictionary string").write.parquet(f"{path}/manifest")
    drop_scratch(spark, scratch)


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids, from the shards. ``start`` counts the ids of all documents before."""
    shards = spark.read.parquet(f"{path}/manifest")
    # One row a shard (tens of MB of documents): small enough for one ordered pass.
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.withColumn("base", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    fs, p = open_fs(path)
    with fs.open_input_file(f"{p}/dict.zst") as f:
        held = spark.sparkContext.broadcast(f.read())
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if ids else []))

    def rows(batches):
        fs, p = open_fs(path)
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{p}/{name}") as f:
                    buf, held_ids, start = [], 0, base
                    for doc_id, got in ShardReader(f, held.value):
                        buf.append((doc_id, start, len(got), zlib.crc32(got.astype("<u4").tobytes())) + ((got.astype(np.int32),) if ids else ()))
                        start, held_ids = start + len(got), held_ids + len(got)
                        if len(buf) >= 5000 or held_ids > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*buf, strict=True), schema.types, strict=True)], schema=schema)
                            buf, held_ids = [], 0
                    if buf:
                        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*buf, strict=True), schema.types, strict=True)], schema=schema)

    n = max(1, shards.count())
    return placed.select("file", "base").repartition(min(n, 10_000)).mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else ""))


def read_document(path: str, shard: str, k: int) -> np.ndarray:
    """The ids of the k-th document of one shard, by its offset index alone."""
    fs, p = open_fs(path)
    with fs.open_input_file(f"{p}/dict.zst") as f:
        dictionary = f.read()
    with fs.open_input_file(f"{p}/{shard}") as f:
        return ShardReader(f, dictionary).read(k)


def encode(docs: DataFrame, config: TokenConfig, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Write ``docs`` as a fresh data set in the shared folder and return what reading it back gives."""
    path = shared_dir(docs.sparkSession, "tokens")
    write_tokens(docs, path, config, id_col, text_col)
    return read_tokens(docs.sparkSession, path, ids)
