"""Packing, records and shards."""

import collections
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import packing, records, sharding
from weftline.llm._store import fresh_path
from weftline.llm.tokens import TextEncoder, default_tokenizer


def encoded(docs) -> dict:
    tok = Tokenizer.from_file(default_tokenizer())
    return {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library():
    tok, enc = Tokenizer.from_file(default_tokenizer()), TextEncoder(default_tokenizer(), cache_runs=20)
    texts = ["Don't  STOP now ΣΑΣ ß́ <|endoftext|>foo 12,3\n\t\x00 a b", None, "", "   ", "İstanbul ﬁne é é, 3.5%", "x" * 300 + " 'tis 's x<|startoftext|> Σ0İ.", "y" * 700, "a b c"] * 3
    offsets, ids = enc.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing_is_whole_and_tight(docs, empty):
    want, got = encoded(docs), packing.pack_documents(docs, capacity=512).collect()
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    assert pieces.keys() == want.keys()
    for i, ids in want.items():
        rows = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows))) and [r.start for r in rows] == [512 * k for k in range(len(rows))]
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows]).tolist() == ids
        assert all(r.length == 512 for r in rows[:-1]) and all(r.ids_crc32 == zlib.crc32(r.ids) for r in rows)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for rows in bins.values():
        rows.sort()
        assert [o for o, _ in rows] == [sum(n for _, n in rows[:k]) for k in range(len(rows))] and sum(n for _, n in rows) <= 512
    assert len(bins) <= 1.03 * -(-sum(map(len, want.values())) // 512) + 1
    assert packing.pack_digest(empty).count() == 0


def test_sum_of_squares_choice_is_the_least():
    rng = np.random.default_rng(1)
    lengths, cap = rng.integers(1, 20, 60), 20
    bins, offsets, fill = packing.sum_of_squares(lengths, cap)
    now: list[int] = []
    for size, b in zip(lengths, bins):
        def cost(k):
            trial = [*now] if k < len(now) else [*now, 0]
            trial[k] += size
            gaps = collections.Counter(cap - f for f in trial if f < cap)
            return sum(n * n for n in gaps.values())
        options = [k for k in range(len(now) + 1) if k == len(now) or now[k] + size <= cap]
        assert cost(b) == min(map(cost, options))
        if b == len(now):
            now.append(0)
        now[b] += size
    assert now == fill.tolist()


def test_records_roundtrip(spark, docs, empty):
    want = encoded(docs)
    manifest = records.write_records(docs, n_files=4)
    start, expected = 0, {}
    for i in sorted(want):
        expected[i] = (start, len(want[i]), crc(want[i]))
        start += len(want[i])
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in records.record_digest(spark, docs).collect()} == expected
    files = manifest.collect()
    assert sum(r.n_docs for r in files) == len(want)
    index = records.read_index(files[1].offsets)
    back = list(records.read_at(files[1].data, index["offset"][::-1].tolist()))
    assert [d for d, _ in back] == index["doc_id"][::-1].tolist() and all(ids.tolist() == want[d] for d, ids in back)
    assert records.record_digest(spark, empty).count() == 0


def test_damaged_records_are_found(tmp_path):
    data = records.frame(b"hello") + records.frame(b"world")
    for at in range(len(data)):
        broken = data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
        with pytest.raises(ValueError):
            import io

            f = io.BytesIO(broken)
            while records.unframe(f.read, "x") is not None:
                pass


def test_null_ids_and_repeated_rows_in_records(spark):
    data = spark.createDataFrame([(None, "a b"), (3, None), (3, "c"), (3, "c")], "doc_id long, text string")
    rows = sorted((r.start, r.doc_id, r.n_tokens) for r in records.record_digest(spark, data).collect())
    assert rows == [(0, None, 3), (3, 3, 1), (4, 3, 2), (6, 3, 2)]


@pytest.mark.parametrize("n_shards", [1, 7])
def test_shards_are_even_and_gapless(spark, docs, empty, n_shards):
    out = sharding.shard_by_bytes(docs, n_shards, samples=3).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.text for r in out} == text and len(out) == len(text)
    total, most = sum(r.size for r in out), max(r.size for r in out)
    shards = collections.defaultdict(list)
    for r in out:
        assert r.size == len((r.text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((r.text or "").encode())
        shards[r.shard].append(r)
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in shards.values())
    assert all(abs(sum(r.size for r in rows) - total / n_shards) <= most for rows in shards.values())
    assert sharding.shard_by_bytes(empty, n_shards).count() == 0


def test_overfull_ranges_are_divided(spark):
    data = spark.createDataFrame([(i, "same text again" if i % 3 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    out = sharding.shard_by_bytes(data, 10, samples=1, keep_columns=False).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in out]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 100


def test_equal_texts_stay_together_where_they_fit(spark):
    data = spark.createDataFrame([(i, f"text {i % 700} " + "x" * (i % 40)) for i in range(7000)] + [(10_000 + i, "hot") for i in range(3500)], "doc_id long, text string")
    out = sharding.shard_by_bytes(data.withColumn("nth", F.lit(1)), 8, samples=2)
    assert "nth" in out.columns
    rows = out.collect()
    assert len(rows) == 10_500
    where = collections.defaultdict(set)
    for r in rows:
        where[r.text].add(r.shard)
    assert len(where.pop("hot")) > 1 and all(len(x) == 1 for x in where.values())
    sizes = collections.Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 0.1 * sum(sizes.values()) / 8
    with pytest.raises(ValueError):
        sharding.shard_by_bytes(data.withColumn("slot", F.lit(1)))


def test_shared_folder_is_used(spark):
    assert "weftline" in fresh_path(spark, "x")
