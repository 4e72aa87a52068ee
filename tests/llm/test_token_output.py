import struct
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekiln.llm import registry
from lorekiln.llm import token_output as tok


@pytest.mark.parametrize("n", [1, 2, 300, 5000, 70_000, 600_000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 49_000).astype(np.uint32)
    u, c = np.unique(ids, return_counts=True)
    table = tok.Table(u, c)
    assert int(table.freq.sum()) == 1 << tok.SCALE and (table.freq > 0).all()
    data = tok.encode_block(ids, table)
    assert (tok.decode_block(data, table) == ids).all()
    rows = -(-n // tok.lanes_of(n))
    parts = [tok.decode_block(data, table, p) for p in range(-(-rows // tok.CHECKPOINT))]
    assert (np.concatenate(parts) == ids).all()
    if n > 1000:
        p = c / n
        assert len(data) < n * (-(p * np.log2(p)).sum() / 8) * 1.05 + 12_000
        broken = bytearray(data)
        broken[-2] ^= 1
        with pytest.raises((ValueError, IndexError)):
            tok.decode_block(bytes(broken), table)


TEXTS = [
    "Hello, World!", None, "", "don't.'s THE's a.'re x<|endoftext|>y <|ENDOFTEXT|>", "İstanbul ΣΑΣ é ½ 3'm\t\x0b z 'tis ''s _'ll a_b",
    "日本語。a，b ﬁ…!", "word " * 3000, "a" * 5000, "$'s (re)'vé naïve–dash", "Hello, World!", "\ud800 lone",
]


def test_files_hold_the_tokenizers_ids(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tok, "BLOCK_IDS", 500)
    path = registry.tokenizer_path()
    rows = [(7 * i % 11, t.encode("utf-8", "replace").decode() if t else t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, ids string, n int").repartition(3)
    got = tok.tokens_written_and_read(docs, path).collect()
    plain, at, want = Tokenizer.from_file(path), 0, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = plain.encode_batch([t or ""], add_special_tokens=False)[0].ids + [1]
        want.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want


def test_repeats_null_ids_order_and_empty(spark):
    path = registry.tokenizer_path()
    docs = spark.createDataFrame([(1, "b"), (1, "b"), (None, "a"), (0, "c")], "doc_id long, text string")
    got = sorted(tok.tokens_written_and_read(docs, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 0, 1, 1] and [r.start for r in got] == [0, 2, 4, 6]
    down = sorted(tok.tokens_written_and_read(docs, path, [F.desc("doc_id")] and [-F.col("doc_id")]).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in down] == [None, 1, 1, 0]
    assert tok.tokens_written_and_read(docs.limit(0), path).count() == 0


def test_a_worker_holds_little_beside_its_texts_and_pieces():
    path = registry.tokenizer_path()
    rng = np.random.default_rng(3)
    words = np.array(["word", "of", "some", "text", "and", "more", "it", "is"])
    texts = [" ".join(words[rng.integers(0, len(words), 1000)]) for _ in range(1000)]
    pieces = tok.tokenizer(path)
    list(pieces.encode(texts[:1]))
    tracemalloc.start()
    try:
        n = sum(len(ids) for ids in pieces.encode(texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 1_000_000 and peak < 64 << 20  # 4.4 MB of texts


def test_ids_do_not_depend_on_how_many_bytes_are_looked_up(monkeypatch):
    texts = [t.encode("utf-8", "replace").decode() if t else t for t in TEXTS]
    want = [ids.tolist() for ids in tok.PieceCache(registry.tokenizer_path()).encode(texts)]
    for size in (1, 50, 1 << 23):
        monkeypatch.setattr(tok, "LOOKED_UP", size)
        assert [ids.tolist() for ids in tok.PieceCache(registry.tokenizer_path()).encode(texts)] == want


def test_ids_leave_the_files_on_demand_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tok, "BLOCK_IDS", 5)
    path = registry.tokenizer_path()
    docs = spark.createDataFrame([(2, "more words here"), (1, "b"), (3, None)], "doc_id long, text string")
    table = tok.write_token_files(docs, str(tmp_path / "ids"), path)
    whole, digests = (tok.read_token_files(spark, str(tmp_path / "ids"), table, with_ids) for with_ids in (True, False))
    assert digests.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and whole.columns == [*digests.columns, "ids"]
    rows = sorted(whole.collect())
    assert [r[:4] for r in rows] == sorted(tuple(r) for r in digests.collect())
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.n_tokens for r in rows)
