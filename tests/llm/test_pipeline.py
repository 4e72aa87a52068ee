import struct
import zlib

import pytest

import corpus_pipeline as pipe
from lorekiln.llm import decontaminate, mixing, ngram_join, registry, toxicity

SF = "/root/testdata/sf0.001"


def test_run_matches_its_stages_done_plainly(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    crf = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r.doc_id: r for r in docs.collect()}
    score = toxicity.score_texts(crf, [r.text for r in rows.values()])["score"].to_pylist()
    left = [i for i, s in zip(rows, score, strict=True) if s < 0.5]
    from test_ngram_join import brute

    left = [i for i, (_, low) in brute([(i, rows[i].text) for i in left]).items() if low == i]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    search = decontaminate.Items([b.item_id for b in bench], [b.text for b in bench], decontaminate.MAX_EDITS).search([rows[i].text for i in left])
    left = [i for i, hits in zip(left, search, strict=True) if not hits]
    mixed = mixing.mix_sources(docs.where(docs.doc_id.isin(left))).collect()
    order = [r.doc_id for r in sorted(mixed, key=lambda r: r.position)]
    plain, at, want = Tokenizer.from_file(registry.tokenizer_path()), 0, []
    for i in order:
        ids = plain.encode_batch([rows[i].text], add_special_tokens=False)[0].ids + [1]
        want.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in pipe.run(spark, SF).collect()), key=lambda r: r[1])
    assert got == want and 0 < len(got) < len(rows)


@pytest.mark.parametrize("stage", range(4))
def test_stages_take_odd_rows(spark, tmp_path, stage):
    odd = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "x" * 200_000, None, "a", 1), (3, "plain words here", "en", None, 3)]
    docs = spark.createDataFrame([(*r, "kept_id", 1, [1]) for r in odd], "doc_id long, text string, lang string, source string, n_chars long, row string, position int, item_ids array<int>")
    out = pipe.STAGES[stage][1](spark, docs, SF)
    assert out.columns == docs.columns
    out.write.parquet(str(tmp_path / "out"))
    again = spark.read.parquet(str(tmp_path / "out"))
    assert {r.doc_id for r in again.collect()} == {None, 1, 2, 3}
    assert pipe.STAGES[4][1](spark, again, SF).count() == again.count()
    assert pipe.STAGES[stage][1](spark, docs.limit(0), SF).count() == 0
