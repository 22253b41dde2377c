"""Near-duplicates by order min-hash, verified by banded alignment.

A text is its sequence of five-word shingles (of all its words, if fewer), each labelled with how
often it has occurred before. A sketch takes the ``KEPT`` least labelled shingles under its own
hash and keeps them in text order, so texts share a sketch only where the same shingles stand in
the same order. ``SKETCHES`` of them are taken, two to a bucket.

Similarity is that of the best banded alignment of the labelled shingles: with M aligned out of
m and n, M / (m + n - M); only shingles at places that differ by no more than a pair of the
wanted similarity allows can be aligned. Pairs from 0.8 on are links, linked texts are a class.

Texts with the same words are one node from the start. Two nodes of a bucket that share ``AGREED``
sketches are in one cluster of candidates. First every node is tied to the least node of each of its
buckets: such ties grow with the nodes, not with the pairs. Where a bucket then still holds nodes of
several clusters, all its nodes meet, chunk by chunk, and those of different clusters that share
enough sketches are tied too: the least node may be a third text that only has a passage in common
with them. Within a cluster every pair is considered:
first by how many labelled shingles it shares (a product of two matrices of bounded size), then by
alignment, unless the two are connected already. Large clusters are cut into chunks, with a cell
for each two chunks; a cell yields a spanning forest of its links. Nothing is capped.

Defined cases: a text without words, null included, is a class of its own; an empty table gives
no rows; repeated rows are rows of one class; classes are named by their least ``doc_id``.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchline.llm.common import by_bytes, discard, held, mixed, saved, segments
from batchline.llm.links import components
from batchline.llm.words import words_of

WORDS = 5
SIMILARITY = 0.8
SKETCHES = 32
KEPT = 2
#: Sketches to a bucket: a pair of similarity 0.8 shares none of the 16 buckets with 2e-4.
BAND = 2
#: Sketches that two nodes of a bucket must share to be in one cluster.
AGREED = 8
#: Nodes of a bucket or a cluster, and shingles, that are compared with one another at a time.
CHUNK, SHINGLES = 1000, 4_000_000
#: Bits of the map of nodes in clusters: 16 MB.
BITS = 1 << 27
#: Different shingles that are counted at a time.
COLUMNS = 4096
AT_ONCE = 4 << 20

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _shingles(code: np.ndarray, edges: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in a row (``code``: word hashes) and their edges."""
    counts = np.diff(edges)
    n = np.where(counts == 0, 0, np.maximum(1, counts - words + 1))
    out_edges = segments(n)
    if not out_edges[-1]:
        return np.zeros(0, np.uint64), out_edges
    place = np.arange(out_edges[-1]) + np.repeat(edges[:-1] - out_edges[:-1], n)
    last = np.repeat(edges[1:], n)
    value = np.zeros(len(place), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            at = place + k
            inside = at < last
            value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, code[np.minimum(at, len(code) - 1)], np.uint64(k + 1)))
    return value, out_edges


def _labelled(value: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Hash of each shingle with the number of earlier ones like it in its text."""
    owner = np.repeat(np.arange(len(edges) - 1, dtype=np.uint64), np.diff(edges))
    key = mixed(value + mixed(owner + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order]
    first = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]])) if len(same) else np.zeros(0, np.int64)
    runs = np.diff(np.append(first, len(same)))
    label = np.empty(len(same), np.uint64)
    label[order] = (np.arange(len(same)) - np.repeat(first, runs)).astype(np.uint64)
    with np.errstate(over="ignore"):
        return np.where(label == 0, value, mixed(value + label * np.uint64(0xA0761D6478BD642F)))


def _sketches(value: np.ndarray, edges: np.ndarray, sketches: int) -> np.ndarray:
    """Texts x sketches: a hash of the least labelled shingles in text order; 0 rows if no text."""
    n = np.diff(edges)
    full = np.flatnonzero(n)
    out = np.zeros((len(n), sketches), np.uint64)
    if not len(full):
        return out
    starts, runs = edges[:-1][full], n[full]
    for s in range(sketches):
        h = mixed(value ^ mixed(np.array([s + 1], np.uint64)))
        chosen = []
        for _ in range(KEPT):
            least = np.minimum.reduceat(h, starts)
            at = np.flatnonzero(h == np.repeat(least, runs))
            own = np.searchsorted(starts, at, side="right") - 1
            first = np.concatenate([[True], own[1:] != own[:-1]])
            place = at[first]
            chosen.append(place)
            h[at] = _TOP
        order = np.sort(np.stack(chosen), axis=0)
        sketch = np.full(len(full), s + 1, np.uint64)
        with np.errstate(over="ignore"):
            for place in order:
                sketch = mixed(sketch * np.uint64(0x9E3779B97F4A7C15) + value[place])
        out[full, s] = sketch
    return out


def sketched(docs: DataFrame, key: str = "doc_id", words: int = WORDS, sketches: int = SKETCHES) -> DataFrame:
    """``key, node, n, sketch, shingles`` of each row: ``node`` stands for the row's words (null
    if there are none), ``n`` counts its shingles, ``shingles`` are 32 bits of each in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", AT_ONCE):
                split = words_of(batch.column("text"))
                of_word = np.fromiter(map(xxhash.xxh64_intdigest, split.distinct), np.uint64, len(split.distinct))
                code = of_word[split.code]
                value, edges = _shingles(code, split.edges, words)
                value = _labelled(value, edges)
                marks = _sketches(value, edges, sketches).view(np.int64)
                raw = memoryview(code).cast("B")
                small = (value >> np.uint64(32)).astype("<u4").tobytes()
                spans = zip((8 * split.edges[:-1]).tolist(), (8 * split.edges[1:]).tolist(), strict=True)
                nodes = [hashlib.blake2b(raw[a:b], digest_size=16).digest() if b > a else None for a, b in spans]
                packed = pa.Array.from_buffers(pa.large_binary(), len(nodes), [None, pa.py_buffer((4 * edges).astype("<i8")), pa.py_buffer(small)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key"), pa.array(nodes, pa.binary()), pa.array(np.diff(edges)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * sketches), pa.array(marks.reshape(-1))),
                        packed.cast(pa.binary()),
                    ],
                    ["key", "node", "n", "sketch", "shingles"],
                )

    rows = docs.select(F.col(key).alias("key"), "text")
    schema = f"key {rows.schema['key'].dataType.simpleString()}, node binary, n long, sketch array<long>, shingles binary"
    return rows.mapInArrow(run, schema)


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Similarity by banded alignment; 0 if it can't reach ``similarity``."""
    m, n = len(a), len(b)
    needed = similarity * (m + n) / (1 + similarity)
    if min(m, n) < needed:
        return 0.0
    band = int((m + n) * (1 - similarity) / (1 + similarity)) + 1
    _, i, j = np.intersect1d(a, b, assume_unique=False, return_indices=True)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) < needed - 1e-9:
        return 0.0
    # labelled shingles occur once, so the alignment is the longest increasing run of places
    places = j[np.argsort(i)]
    if (np.diff(places) > 0).all():
        best = len(places)
    else:
        tails: list[int] = []
        for p in places.tolist():
            k = bisect_left(tails, p)
            tails[k : k + 1] = [p]
        best = len(tails)
    return best / (m + n - best)


def agreeing(pairs: DataFrame, nodes: DataFrame, agreed: int = AGREED) -> DataFrame:
    """The ``a, b`` that share enough sketches."""
    of = {c: nodes.select(F.col("node").alias(c), F.col("sketch").alias(f"of_{c}")) for c in ("a", "b")}
    both = pairs.join(of["a"], "a").join(of["b"], "b")
    shared = F.size(F.filter(F.zip_with("of_a", "of_b", lambda x, y: x == y), lambda same: same))
    return both.filter(shared >= agreed).select("a", "b")


def _root(root: list[int], x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _joining(sketch: np.ndarray, cluster: np.ndarray, chunk: np.ndarray, agreed: int) -> Iterator[tuple[int, int]]:
    """Rows of a cell that share enough sketches, as many as connect their clusters. Compared are
    rows of the cell's two chunks, or of its only one."""
    left, right = np.flatnonzero(chunk == chunk.min()), np.flatnonzero(chunk == chunk.max())
    same = np.zeros((len(left), len(right)), np.uint16)
    for s in range(sketch.shape[1]):
        same += sketch[left, s][:, None] == sketch[right, s][None, :]
    i, j = np.nonzero((same >= agreed) & (cluster[left][:, None] != cluster[right][None, :]))
    i, j = left[i], right[j]
    root = list(range(int(cluster.max()) + 1))
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = _root(root, cluster[x]), _root(root, cluster[y])
        if p != q:
            root[max(p, q)] = min(p, q)
            yield x, y


def joining(met: DataFrame, clusters: DataFrame, nodes: DataFrame, agreed: int = AGREED) -> DataFrame:
    """Ties ``a, b`` (saved) between clusters: nodes of one bucket that share enough sketches.

    ``met`` has ``node, bucket`` without the least node of the bucket, which all others have met;
    ``clusters`` has ``node, cluster`` of the nodes that are tied to another.
    """
    rows = met.join(clusters, "node", "left").select("node", "bucket", F.coalesce("cluster", "node").alias("cluster"))
    sizes = rows.groupBy("bucket").agg(F.min("cluster").alias("least"), F.max("cluster").alias("most"), F.count("*").alias("size"))
    several = sizes.filter("least <> most").select("bucket", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks"))
    dealt = rows.join(several, "bucket").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    cells = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "node", "cluster", "chunk", F.xxhash64("bucket", F.least("chunk", "with"), F.greatest("chunk", "with")).alias("cell")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, found = None, [], []

        def compare() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            node = table.column("node")
            cluster = table.column("cluster").combine_chunks().dictionary_encode().indices.to_numpy()
            sketch = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
            pairs = _joining(sketch, cluster, table.column("chunk").to_numpy(), agreed)
            found.extend((node[x].as_py(), node[y].as_py()) for x, y in pairs)

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.binary()) for i in (0, 1)], ["a", "b"])
            found.clear()
            return batch

        for batch in batches:
            cell = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if begin == end:
                    continue
                if cell[begin] != own:
                    if held:
                        compare()
                    own, held = cell[begin], []
                    if len(found) > 10_000:
                        yield out()
                held.append(batch.slice(begin, end - begin))
        if held:
            compare()
        yield out()

    together = cells.join(nodes.select("node", "sketch"), "node").select("cell", "node", "cluster", "sketch", "chunk")
    return saved(together.repartition(F.col("cell")).sortWithinPartitions("cell").mapInArrow(run, "a binary, b binary"), "joining")


def _shared(lists: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many labelled shingles each of ``left`` has in common with each of ``right``."""
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    _, code, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    several = counts > 1
    column = np.cumsum(several) - 1
    held = several[code]
    owner, code = owner[held], column[code[held]]
    total = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for begin in range(0, int(several.sum()), COLUMNS):
        a, b = np.searchsorted(code, [begin, begin + COLUMNS])
        has = np.zeros((len(lists), COLUMNS), np.float32)
        has[owner[a:b], code[a:b] - begin] = 1
        total += has[left] @ has[right].T
    return total


def _links(table: list[tuple], similarity: float) -> Iterator[tuple[bytes, bytes]]:
    """A spanning forest of the links in a cell: ``(node, shingles, chunk)`` of each row. Links are
    between the two chunks of the cell, or within its only one."""
    lists = [np.frombuffer(raw, "<u4") for _, raw, _ in table]
    chunk = np.array([r[2] for r in table])
    left, right = np.flatnonzero(chunk == chunk.min()), np.flatnonzero(chunk == chunk.max())
    n = np.array([len(x) for x in lists], np.float64)
    # what is aligned is shared, so pairs that share too little need no alignment
    needed = similarity * (n[left][:, None] + n[right][None, :]) / (1 + similarity) - 1e-6
    i, j = np.nonzero(_shared(lists, left, right) >= needed)
    i, j = left[i], right[j]
    if chunk.min() == chunk.max():
        i, j = i[i < j], j[i < j]
    root = list(range(len(table)))
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = _root(root, x), _root(root, y)
        if p != q and aligned(lists[x], lists[y], similarity) >= similarity:
            root[max(p, q)] = min(p, q)
            yield table[x][0], table[y][0]


def _likely(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``rows`` whose ``node`` is in ``nodes``, and few others: a bitmap of node hashes, ``BITS``
    long whatever the corpus, goes to every task, so that other rows are not shuffled."""

    def hashed(frame: DataFrame) -> DataFrame:
        at = F.pmod(F.xxhash64("node"), F.lit(BITS))
        return frame.withColumns({"part": F.floor(at / 32768), "bit": at % 32768})

    maps = hashed(nodes.select("node")).groupBy("part").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
    marked = "shiftright(CAST(conv(hex(substring(bits, CAST(bit DIV 8 AS int) + 1, 1)), 16, 10) AS int), CAST(bit % 8 AS int)) & 1 = 1"
    return hashed(rows).join(F.broadcast(maps), "part").filter(F.expr(marked)).drop("part", "bit", "bits")


def verified(clusters: DataFrame, shingles: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links ``a, b`` (saved) that connect whatever is similar within a cluster.

    ``clusters`` has ``node, cluster, n``; ``shingles`` has ``node, shingles``. A cluster is cut
    into chunks of bounded size, with a cell for each two of them.
    """
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n").alias("all"))
    chunks = F.greatest(F.ceil(F.col("size") / CHUNK), F.ceil(F.col("all") / SHINGLES)).cast("int")
    sized = clusters.join(sizes, "cluster").withColumn("chunks", chunks)
    dealt = sized.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    cells = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "node", "chunk", F.xxhash64("cluster", F.least("chunk", "with"), F.greatest("chunk", "with")).alias("cell")
    )
    # those that are not in a cluster after all find no cell
    texts = _likely(shingles, clusters).groupBy("node").agg(F.any_value("shingles").alias("shingles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []

        def out() -> pa.RecordBatch:
            found = list(_links(held, similarity)) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.binary()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            values = zip(*(batch.column(c).to_pylist() for c in ("cell", "node", "shingles", "chunk")), strict=True)
            for cell, *row in values:
                if cell != own:
                    if held:
                        yield out()
                    own, held = cell, []
                held.append(tuple(row))
        yield out()

    together = cells.join(texts, "node").select("cell", "node", "shingles", "chunk")
    return saved(together.repartition(F.col("cell")).sortWithinPartitions("cell", "node").mapInArrow(run, "a binary, b binary"), "links")


def classes(docs: DataFrame, key: str = "doc_id", words: int = WORDS, similarity: float = SIMILARITY, sketches: int = SKETCHES) -> DataFrame:
    """``key, class``: rows of one class are near-duplicates, directly or through others. The class
    is null for a text without words."""
    rows = saved(sketched(docs, key, words, sketches), "sketches", compression="none")
    shingles = rows.filter("node IS NOT NULL").select("node", "shingles")
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch"))
    nodes = saved(nodes, "nodes")
    # clusters of candidates: first every node with the least node of each of its buckets
    keys = [F.xxhash64(F.lit(b), F.slice("sketch", b * BAND + 1, BAND)) for b in range(sketches // BAND)]
    buckets = nodes.select("node", F.explode(F.array(*keys)).alias("bucket"))
    centres = buckets.groupBy("bucket").agg(F.min("node").alias("b"), F.count("*").alias("size")).filter("size > 1").drop("size")
    met = saved(buckets.join(centres, "bucket").filter("node <> b"), "buckets")
    near = met.select(F.col("node").alias("a"), "b").distinct()
    tied = saved(agreeing(near, nodes), "candidates")
    stars = saved(components(tied).toDF("node", "cluster"), "stars")
    # nodes of a bucket that did not come together through its least node
    more = joining(met, stars, nodes)
    whole = stars if more.isEmpty() else components(stars.toDF("a", "b").union(more)).toDF("node", "cluster")
    clusters = saved(whole.join(nodes.select("node", "n"), "node"), "clusters")
    discard(met, tied, stars, more)
    links = verified(clusters, shingles, similarity)
    found = saved(components(links), "classes").toDF("node", "class")
    thin = saved(rows.select("key", "node"), "nodes-of-rows")
    discard(rows, nodes, clusters, links)
    return thin.join(found, "node", "left").select("key", F.coalesce("class", "node").alias("class"))


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, class_size, kept`` for every document; ``class_id`` is the least
    ``doc_id`` of its class."""
    rows = classes(docs)
    groups = rows.filter("class IS NOT NULL").groupBy("class").agg(F.min("key").alias("class_id"), F.count("*").alias("class_size"))
    out = rows.join(groups, "class", "left")
    class_id = F.coalesce("class_id", "key")
    return out.select(
        F.col("key").alias("doc_id"), class_id.alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"),
        class_id.eqNullSafe(F.col("key")).alias("kept"),
    )


def unlike_documents(docs: DataFrame) -> DataFrame:
    """One row of each class of ``docs``, that of the least ``doc_id``, with all its columns."""
    docs = held(docs, "compared")
    place = F.struct(
        F.col("doc_id").isNull().alias("unnamed"), "doc_id",
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )
    rows = saved(classes(docs.select(place.alias("place"), "text"), "place"), "classed")
    first = rows.filter("class IS NOT NULL").groupBy("class").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1")
    gone = rows.join(first, "class").filter("key <> first").select(F.col("key.file").alias("gone_file"), F.col("key.row").alias("gone_row"))
    placed = docs.select(F.struct("*").alias("doc"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    here = (F.col("file") == F.col("gone_file")) & (F.col("row") == F.col("gone_row"))
    return placed.join(gone, here, "left_anti").select("doc.*")
