"""Token files: static range asymmetric numeral coding in interleaved, independent blocks.

One frequency table, counted over all ids of the corpus and scaled to 2**20, is shared by every
block. A block holds whole documents in ascending order; its ids are dealt to up to ``LANES``
coder states in turn, which write to one stream of 32-bit words, so that a step codes a whole
row of lanes at once. Every ``STEPS`` steps a checkpoint keeps the states and the place in the
stream: a reader can start there, and readers of different blocks need nothing from each other.
The header has the block's first token position in the whole corpus, its sizes and checksums of
the payload and of the ids.

Files are parquet containers written by Spark's committed writer (a lost executor leaves no half
file, any store works): ``blocks/shard=N`` has one binary row per block in ascending order;
``table`` the frequencies.

Defined cases: null text counts as empty; each document ends with id 1, so an empty one has one
id; rows with a null ``doc_id`` come first; rows with equal ``doc_id`` are ordered by their ids'
length and checksum; an empty table gives no blocks. A document of any length is one block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchline.llm.common import saved, segments
from batchline.llm.tokens import END, Encoder, default_path, over_texts
from batchline.scratch import new_dir

BITS = 20
LANES = 1024
STEPS = 256
#: Ids after which a block closes at the next end of a document.
BLOCK = 1 << 19
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_HEAD = struct.Struct("<4sIqqIIIIIIII")
_MAGIC = b"RNS1"
#: Words whose ids a worker keeps, about 200 MB: a run of texts may bring a hundred thousand new ones, and
#: a smaller memory would learn most of them again and again.
WORDS = 800_000
#: Stands for a null doc_id in a block.
_NO_ID = -(1 << 63)
_CONTENT = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("doc_ids", pa.binary()), ("lengths", pa.binary())])
_CONTENT_DDL = "shard int, block long, before long, n long, width int, ids binary, doc_ids binary, lengths binary"
_BLOCKS = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("raw", pa.binary())])


@dataclass
class Table:
    """Frequencies scaled to 2**BITS: every id that occurs has at least 1."""

    ids: np.ndarray  # ascending
    freq: np.ndarray
    total: int = 1 << BITS

    def __post_init__(self):
        self.cum = segments(self.freq)[:-1]
        self.checksum = zlib.crc32(np.stack([self.ids, self.freq]).astype("<u4").tobytes())
        self._slots = None
        self._index = None

    def index(self, ids: np.ndarray) -> np.ndarray:
        if self._index is None:
            self._index = np.zeros(int(self.ids.max(initial=0)) + 1, np.int32)
            self._index[self.ids] = np.arange(len(self.ids), dtype=np.int32)
        return self._index[ids]

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.freq)
        return self._slots


def scaled(ids: np.ndarray, counts: np.ndarray) -> Table:
    """Counts to frequencies that sum to 2**BITS; the largest ones take up the rounding."""
    total = 1 << BITS
    if not len(ids):
        return Table(np.zeros(1, np.int64), np.array([total]))
    if len(ids) > total // 2:
        raise ValueError(f"{len(ids)} different ids are too many for {BITS} bits")
    freq = np.maximum(1, np.floor(counts / counts.sum() * total).astype(np.int64))
    order = np.lexsort((ids, -counts))
    over = int(freq.sum()) - total
    while over:
        k = order[: min(len(order), max(1, abs(over)))]
        give = -1 if over > 0 else 1
        k = k[freq[k] > 1] if give < 0 else k
        k = k[: abs(over)]
        freq[k] += give
        over += give * len(k)
    return Table(ids, freq)


def encode_block(ids: np.ndarray, table: Table, start: int, doc_ids: bytes, lengths: np.ndarray) -> bytes:
    """One block of the file format."""
    n = len(ids)
    lanes = int(min(LANES, max(1, n // 64)))
    steps = -(-n // lanes)
    symbol = table.index(ids)
    freq, cum = table.freq[symbol].astype(np.uint64), table.cum[symbol].astype(np.uint64)
    limit = freq << np.uint64(31 - BITS + 32)
    state = np.full(lanes, _LOW)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    for t in range(steps - 1, -1, -1):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        x = state[: b - a]
        full = x >= limit[a:b]
        out = x[full]
        words.append(out.astype("<u4"))  # the low word of each
        written += len(out)
        x[full] = out >> _WORD
        q = x // freq[a:b]
        x[:] = (q << np.uint64(BITS)) + (x - q * freq[a:b]) + cum[a:b]
        if t % STEPS == 0:
            marks.append((written, state.copy()))
    marks.reverse()
    stream = b"".join(w.tobytes() for w in reversed(words))
    points = b"".join(struct.pack("<Q", written - at) + states.astype("<u8").tobytes() for at, states in marks)
    sizes = lengths.astype("<u8").tobytes()
    payload = points + doc_ids + sizes + stream
    head = _HEAD.pack(_MAGIC, table.checksum, start, n, lanes, STEPS, len(marks), len(lengths), written, len(doc_ids), zlib.crc32(payload), zlib.crc32(ids.astype("<u4").tobytes()))
    return head + payload


@dataclass
class Block:
    """A block read back; ``ids`` decodes all of it, ``part`` from one checkpoint on."""

    raw: bytes | pa.Buffer

    def __post_init__(self):
        (magic, self.table_sum, self.start, self.n, self.lanes, self.steps, self.marks, self.docs, self.words, self.ids_bytes, payload_sum, self.ids_sum) = _HEAD.unpack_from(self.raw)
        if magic != _MAGIC or zlib.crc32(memoryview(self.raw)[_HEAD.size :]) != payload_sum:
            raise ValueError("not a block, or a damaged one")
        self._mark = 8 + 8 * self.lanes
        at = _HEAD.size + self.marks * self._mark
        self.doc_ids = bytes(memoryview(self.raw)[at : at + self.ids_bytes])
        self.lengths = np.frombuffer(self.raw, "<u8", self.docs, at + self.ids_bytes).astype(np.int64)
        self.stream = np.frombuffer(self.raw, "<u4", self.words, at + self.ids_bytes + 8 * self.docs)

    def part(self, table: Table, mark: int, until: int | None = None) -> np.ndarray:
        """Ids from checkpoint ``mark`` up to checkpoint ``until`` (default: the end)."""
        if table.checksum != self.table_sum:
            raise ValueError("the block was written with another table")
        at = _HEAD.size + mark * self._mark
        (place,) = struct.unpack_from("<Q", self.raw, at)
        state = np.frombuffer(self.raw, "<u8", self.lanes, at + 8).astype(np.uint64)
        total = -(-self.n // self.lanes)
        first, last = mark * self.steps, total if until is None else min(total, until * self.steps)
        freq, cum, slots = table.freq.astype(np.uint64), table.cum.astype(np.uint64), table.slots
        mask, stream = np.uint64((1 << BITS) - 1), self.stream
        symbols = np.empty(min(self.n, last * self.lanes) - first * self.lanes, np.int32)
        for t in range(first, last):
            a, b = t * self.lanes, min(self.n, (t + 1) * self.lanes)
            x = state[: b - a]
            low = x & mask
            s = slots[low]
            symbols[a - first * self.lanes : b - first * self.lanes] = s
            y = freq[s] * (x >> np.uint64(BITS)) + low - cum[s]
            short = np.flatnonzero(y < _LOW)
            y[short] = (y[short] << _WORD) | stream[place : place + len(short)]
            place += len(short)
            x[:] = y
        return table.ids[symbols]

    def ids(self, table: Table) -> np.ndarray:
        out = self.part(table, 0)
        if zlib.crc32(out.astype("<u4").tobytes()) != self.ids_sum:
            raise ValueError("the decoded ids differ from what was written")
        return out


# --- Spark ----------------------------------------------------------------------------------------


def _bounds(docs: DataFrame, shards: int) -> np.ndarray:
    """doc_ids that cut the table into about equal shards."""
    known = docs.select(F.col("doc_id").cast("double").alias("k")).filter("k IS NOT NULL")
    shares = [i / shards for i in range(1, shards)]
    return np.unique(known.approxQuantile("k", shares, 1 / (4 * shards))) if shares else np.zeros(0)


def _ids_by_shard(docs: DataFrame, bounds: np.ndarray, path: str) -> DataFrame:
    def work(encoder: Encoder, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, edges = encoder.encode(batch.column("text"), END)
        wide = len(ids) and int(ids.max()) >= 1 << 16
        raw = ids.astype("<u4" if wide else "<u2").tobytes()
        width = 4 if wide else 2
        doc = batch.column("doc_id")
        key = pa.compute.fill_null(doc.cast(pa.float64()), -np.inf).to_numpy(zero_copy_only=False)
        packed = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer((edges * width).astype("<i8")), pa.py_buffer(raw)])
        shard = np.searchsorted(bounds, key, side="right").astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(shard), doc, pa.array(np.diff(edges)), pa.array(np.full(len(doc), width, np.int32)), packed.cast(pa.binary())],
            ["shard", "doc_id", "n", "width", "ids"],
        )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"shard int, doc_id {kind}, n long, width int, ids binary"
    return docs.select("doc_id", "text").mapInArrow(over_texts(path, work, remembered=WORDS), schema)


def _gathered(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Consecutive documents of a shard brought together: a row with the content of one block."""
    names = _CONTENT.names
    docs: list[int | None] = []
    parts: list[np.ndarray] = []
    shard, number, held, before = None, 0, 0, 0

    def row() -> pa.RecordBatch:
        ids = np.concatenate(parts)
        width = 4 if int(ids.max()) >= 1 << 16 else 2
        keys = np.array([_NO_ID if d is None else d for d in docs], "<i8").tobytes()
        sizes = np.array([len(p) for p in parts], "<u8").tobytes()
        values = [shard, number, before, len(ids), width, ids.astype(f"<u{width}").tobytes(), keys, sizes]
        return pa.RecordBatch.from_pylist([dict(zip(names, values, strict=True))], schema=_CONTENT)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("shard", "doc_id", "width")]
        for own, doc, width, raw in zip(*columns, batch.column("ids"), strict=True):
            if parts and (own != shard or held >= block):
                yield row()
                number, before = (number + 1, before + held) if own == shard else (0, 0)
                docs, parts, held = [], [], 0
            shard = own
            ids = np.frombuffer(raw.as_buffer(), f"<u{width}")
            docs.append(doc)
            parts.append(ids.astype(np.uint32))
            held += len(ids)
    if parts:
        yield row()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each id occurs in the task's blocks."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for width, raw in zip(batch.column("width").to_pylist(), batch.column("ids"), strict=True):
            counts = np.bincount(np.frombuffer(raw.as_buffer(), f"<u{width}"))
            total, counts = (total, counts) if len(total) >= len(counts) else (counts, total)
            total[: len(counts)] += counts
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])


def write(docs: DataFrame, folder: str, path: str | None = None, block: int = BLOCK) -> None:
    """Encode ``doc_id`` (integer), ``text`` into token files below ``folder``.

    The ids are made once, dealt to shards of ascending doc_ids and stored; the table is counted
    from all of them (at most one row per vocabulary entry comes to the driver), each block's
    first position is its place in the shard plus that of the shard, and the coding itself is a
    map over blocks. Blocks lie in one folder per shard, in order.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens = _ids_by_shard(docs, _bounds(docs, shards), path or default_path())
    dealt = tokens.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "n", F.crc32("ids"))
    content = saved(dealt.mapInArrow(lambda rows: _gathered(rows, block), _CONTENT_DDL), "ids", compression="zstd")
    counted = content.select("width", "ids").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = counted.orderBy("id").toPandas()  # at most one row per vocabulary entry
    table = scaled(counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.float64))
    rows = [(int(i), int(f)) for i, f in zip(table.ids, table.freq, strict=True)]
    spark.createDataFrame(rows, "id long, freq long").coalesce(1).write.parquet(f"{folder}/table")
    base = _bases(content)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = {c: batch.column(c)[i] for c in batch.schema.names}
                ids = np.frombuffer(own["ids"].as_buffer(), f"<u{own['width'].as_py()}")
                sizes = np.frombuffer(own["lengths"].as_buffer(), "<u8")
                start = base[own["shard"].as_py()] + own["before"].as_py()
                raw = encode_block(ids, table, start, own["doc_ids"].as_py(), sizes)
                row = {"shard": own["shard"].as_py(), "block": own["block"].as_py(), "n": len(ids), "raw": raw}
                yield pa.RecordBatch.from_pylist([row], schema=_BLOCKS)

    coded = content.mapInArrow(code, "shard int, block long, n long, raw binary")
    ordered = coded.sortWithinPartitions("shard", "block")
    ordered.write.partitionBy("shard").option("compression", "none").parquet(f"{folder}/blocks")


def _bases(content: DataFrame) -> dict[int, int]:
    """First token position of each shard; there are as many as shuffle partitions at most."""
    sizes = content.groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect()
    edges = segments(np.array([r["n"] for r in sizes], np.int64)).tolist()
    return {r["shard"]: at for r, at in zip(sizes, edges, strict=False)}


def read_table(spark: SparkSession, folder: str) -> Table:
    rows = spark.read.schema("id long, freq long").parquet(f"{folder}/table").orderBy("id").collect()
    return Table(np.array([r["id"] for r in rows], np.int64), np.array([r["freq"] for r in rows], np.int64))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Decode the files, every block on its own: ``doc_id, start, n_tokens, ids`` (ids as
    little-endian unsigned 32-bit integers), plus the block they came from."""
    table = read_table(spark, folder)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("raw"):
                own = Block(raw.as_buffer())
                ids = own.ids(table).astype("<u4")
                edges = segments(own.lengths)
                keys = np.frombuffer(own.doc_ids, "<i8")
                many = pa.Array.from_buffers(pa.large_binary(), own.docs, [None, pa.py_buffer((4 * edges).astype("<i8")), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, mask=keys == _NO_ID), pa.array(own.start + edges[:-1]),
                        pa.array(own.lengths), many.cast(pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    blocks = spark.read.schema("block long, n long, raw binary, shard int").parquet(f"{folder}/blocks")
    return blocks.select("raw").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the documents' ids and read them back: one row per document with the checksum."""
    spark = docs.sparkSession
    folder = new_dir(spark, "tokens")
    write(docs, folder, path)
    return read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
