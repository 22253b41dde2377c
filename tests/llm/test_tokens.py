"""Ids, packing, token files and length counts against the tokenizer itself."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from batchline.llm import lengths, packing, rans
from batchline.llm.tokens import Encoder, default_path
from batchline.scratch import new_dir
from tests.llm import cases


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_path())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_tokenizer(tokenizer):
    rnd = random.Random(3)
    texts = [
        None, "", "  ", "Don't 'street 's!'s _a_b__c 12,3a É é nbsp x İstanbul ǅ ß ẞ 日本語 <|endoftext|> a<|startoftext|>b <|endoftext|",
        "\u0085x\x1cy\x1fz\x00q\x7f", "à ̀b ſ K Å ﬁ ² ½ x²y ª º µ ŉ ǰ ΑΣ ΣΣ", "_ __ ___ a_ _1 1_ -_- §±×÷¿¡",
    ]
    texts += ["".join(chr(rnd.choice([rnd.randrange(1, 0x300), rnd.randrange(32, 127), rnd.randrange(32, 0x2100)])) for _ in range(150)) for _ in range(150)]
    encoder = Encoder(default_path())
    for _ in range(2):  # the second time from memory
        ids, edges = encoder.encode(pa.array(texts), 1)
        assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:], strict=False)] == [ids_of(tokenizer, t) for t in texts]
        assert encoder.lengths_of(pa.array(texts)).tolist() == [len(ids_of(tokenizer, t)) - 1 for t in texts]


def test_memory_that_starts_anew_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr("batchline.llm.tokens.REMEMBERED", 20)
    encoder = Encoder(default_path())
    for seed in range(5):
        text = cases.prose(seed, 60)
        ids, _ = encoder.encode(pa.array([text, None]), 1)
        assert ids.tolist() == [*ids_of(tokenizer, text), 1]


def test_a_larger_memory_learns_words_once(monkeypatch):
    monkeypatch.setattr("batchline.llm.tokens.REMEMBERED", 20)
    small, large, learnt = Encoder(default_path()), Encoder(default_path(), 1000), {}
    texts = [pa.array([" ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(15))]) for i in (0, 1, 0, 1)]
    for own in (small, large):
        learn, learnt[own] = own._learn, 0

        def counted(words, own=own, learn=learn):
            learnt[own] += len(words)
            learn(words)

        own._learn = counted
    for text in texts:
        assert small.encode(text)[0].tolist() == large.encode(text)[0].tolist()
    assert (learnt[small], learnt[large]) == (60, 30)



def check_packing(rows, expected, capacity):
    """Whole documents, gapless sequences, right checksums."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert Counter(x for v in pieces.values() for x in v) == Counter(
        (p, a, len(ids[a : a + capacity]), crc(ids[a : a + capacity])) for ids in expected for p, a in enumerate(range(0, len(ids), capacity))
    )
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_whole_table(spark, small, tokenizer):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    expected = [ids_of(tokenizer, r["text"]) for r in docs.collect()]
    n = check_packing(packing.pack(docs).collect(), expected, packing.CAPACITY)
    assert n <= -(-sum(map(len, expected)) // packing.CAPACITY) + 1


def test_packing_awkward_rows(spark, tokenizer):
    rows = cases.awkward()
    expected = [ids_of(tokenizer, r[1]) for r in rows]
    check_packing(packing.pack(cases.table(spark), capacity=64).collect(), expected, 64)
    assert packing.pack(cases.table(spark, [])).collect() == []


def best(counts):
    """Fewest sequences by trying: small cases only."""
    items = tuple(n for n, k in enumerate(counts) for _ in range(k))
    capacity = len(counts) - 1
    from functools import cache

    @cache
    def least(left):
        if not left:
            return 0
        first, rest = left[-1], left[:-1]
        found = 99
        for mask in range(1 << len(rest)):
            chosen = [rest[i] for i in range(len(rest)) if mask >> i & 1]
            if first + sum(chosen) <= capacity:
                found = min(found, 1 + least(tuple(rest[i] for i in range(len(rest)) if not mask >> i & 1)))
        return found

    return least(items)


def test_program_on_small_cases():
    rnd = random.Random(5)
    for _ in range(15):
        counts = np.zeros(13, np.int64)
        for _ in range(8):
            counts[rnd.randint(1, 12)] += 1
        chosen, bound = packing.configurations(counts)
        held = np.zeros_like(counts)
        for used, copies in chosen.items():
            assert sum(n * k for n, k in used) <= 12
            for n, k in used:
                held[n] += k * copies
        assert (held == counts).all()
        assert sum(chosen.values()) <= best(counts.tolist()) + 1
        assert bound <= best(counts.tolist()) + 1e-6


def test_program_on_large_counts():
    rnd = np.random.default_rng(1)
    counts = np.zeros(257, np.int64)
    counts[rnd.integers(1, 257, 200)] = rnd.integers(1, 5000, 200)
    chosen, bound = packing.configurations(counts)
    assert sum(chosen.values()) <= 1.1 * bound + 2  # half a capacity each on average: the hard case
    assert sum(chosen.values()) <= sum(packing.best_fit(counts).values())
    thirds = np.zeros(257, np.int64)
    thirds[100] = 90_001  # two in a sequence, never three
    chosen, bound = packing.configurations(thirds)
    assert sum(chosen.values()) == 45_001 and bound > 44_999


def one_by_one(counts):
    """Best fit, piece by piece: how much each sequence holds."""
    capacity, held = len(counts) - 1, []
    for n in range(capacity, 0, -1):
        for _ in range(int(counts[n])):
            fullest = max((h for h in held if h + n <= capacity), default=None)
            if fullest is None:
                held.append(n)
            else:
                held[held.index(fullest)] = fullest + n
    return sorted(held)


def test_best_fit_in_groups_is_best_fit():
    rnd = np.random.default_rng(3)
    for capacity in (1, 2, 7, 40, 100):
        for pieces in (0, 1, 30, 400):
            counts = np.bincount(rnd.integers(1, capacity + 1, pieces), minlength=capacity + 1)
            filled = [sum(n * k for n, k in used) for used, many in packing.best_fit(counts).items() for _ in range(many)]
            assert sorted(filled) == one_by_one(counts)
    # the work does not grow with the pieces
    assert sum(packing.best_fit(np.array([0, 0, 0, 10**12, 0, 0, 0])).values()) == 5 * 10**11


def held_by(chosen, capacity):
    held = np.zeros(capacity + 1, np.int64)
    for used, copies in chosen.items():
        assert copies > 0 and sum(n * k for n, k in used) <= capacity
        for n, k in used:
            held[n] += k * copies
    return held


def test_program_never_above_best_fit():
    rnd = np.random.default_rng(1)
    draws = {
        "uniform": rnd.uniform(1000, 3000, 40_000), "many uniform": rnd.uniform(1000, 3000, 1_000_000),
        "normal": rnd.normal(2048, 300, 25_000), "log-normal": rnd.lognormal(7, 0.8, 300_000), "few": rnd.lognormal(5.5, 0.8, 30),
    }
    for name, lengths in draws.items():
        counts = np.bincount(np.clip(lengths.astype(int), 1, 4096), minlength=4097)
        chosen, bound = packing.configurations(counts)
        assert (held_by(chosen, 4096) == counts).all()
        taken, plain = sum(chosen.values()), sum(packing.best_fit(counts).values())
        assert bound <= taken <= plain
        if "uniform" in name:  # here the program must pay
            assert taken < plain and taken < 1.005 * bound


def test_no_pieces():
    assert packing.configurations(np.zeros(5, np.int64)) == ({}, 0.0)


def test_block_round_trip_and_checkpoints():
    rnd = np.random.default_rng(2)
    for n in (1, 2, 63, 64, 1000, 300_000):
        ids = (rnd.pareto(0.6, n) * 3).astype(np.int64) % 50_000
        values, counts = np.unique(ids, return_counts=True)
        table = rans.scaled(values, counts.astype(float))
        assert table.freq.sum() == 1 << rans.BITS and table.freq.min() >= 1
        raw = rans.encode_block(ids, table, 77, np.array([5], "<i8").tobytes(), np.array([n], "<u8"))
        block = rans.Block(raw)
        assert (block.start, block.n, block.lengths.tolist()) == (77, n, [n])
        assert (block.ids(table) == ids).all()
        for mark in range(block.marks):  # every checkpoint is a place to start
            first = mark * block.steps * block.lanes
            assert (block.part(table, mark) == ids[first:]).all()
            assert (block.part(table, mark, mark + 1) == ids[first : first + block.steps * block.lanes]).all()
        with pytest.raises(ValueError):
            rans.Block(raw[:-1] + bytes([raw[-1] ^ 1]))
        other = rans.scaled(np.append(values, 60_000), np.append(counts, 9).astype(float))
        with pytest.raises(ValueError):
            block.ids(other)
    assert len(raw) < 2.6 * n  # smaller than 16 bits an id, states and checkpoints included


def test_token_files(spark, small, tokenizer):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    folder = new_dir(spark, "files")
    rans.write(docs, folder, block=5000)
    got = sorted(map(tuple, rans.read(spark, folder).collect()))
    at, expected = 0, []
    for r in sorted(docs.collect()):
        ids = ids_of(tokenizer, r["text"])
        expected.append((r["doc_id"], at, len(ids), bytearray(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == expected
    blocks = spark.read.parquet(f"{folder}/blocks").orderBy("shard", "block").collect()
    starts = [rans.Block(bytes(b["raw"])).start for b in blocks]
    assert len(blocks) > 8 and starts == sorted(starts)


def test_token_files_awkward_rows(spark, tokenizer):
    got = rans.round_trip(cases.table(spark)).collect()
    expected = sorted(((r[0] is not None, r[0] or 0), ids_of(tokenizer, r[1])) for r in cases.awkward())
    starts = {r["start"]: r for r in got}
    at = 0
    for (known, doc), ids in sorted(expected, key=lambda x: (x[0], len(x[1]))):
        row = starts[at]
        assert (row["doc_id"], row["n_tokens"], row["ids_crc32"]) == (doc if known else None, len(ids), crc(ids))
        at += len(ids)
    assert rans.round_trip(cases.table(spark, [])).collect() == []


def test_length_sums(spark, tokenizer):
    for docs in (cases.table(spark), cases.table(spark, [])):
        n = np.array([len(ids_of(tokenizer, r["text"])) - 1 for r in docs.collect()])
        sums = lengths.limits(lengths.histogram(docs))
        rows = sums.collect()
        assert sorted(r["n_tokens"] for r in rows) == sorted(set(n.tolist()))
        for r in rows:
            limit = r["n_tokens"]
            assert r["docs"] == (n == limit).sum() and r["docs_total"] == len(n) and r["tokens_total"] == n.sum()
            assert (r["docs_longer"], r["tokens_longer"]) == ((n > limit).sum(), n[n > limit].sum())
            assert (r["tokens_within"], r["tokens_cut"]) == (n[n <= limit].sum(), np.minimum(n, limit).sum())
        if len(n):
            for limit in (0, 1, 7, 100, 10**6):
                row = lengths.cut_at(sums, limit).first()
                assert (row["docs_within"], row["tokens_cut"]) == ((n <= limit).sum(), np.minimum(n, limit).sum())
            for share in (0.1, 0.5, 1.0):
                assert lengths.quantile(sums, share).first()["n_tokens"] == np.sort(n)[int(np.ceil(share * len(n))) - 1]
