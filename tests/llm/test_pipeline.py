"""The pipeline from stage to stage."""

import collections
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from weftline.llm.tokens import default_tokenizer


def write(spark, folder, rows, items):
    schema = "doc_id long, text string, lang string, source string, n_chars long, head int, size int"
    spark.createDataFrame([(i, t, x, "s", None, 1, 2) for i, t, x in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_keep_what_is_sound(spark, tmp_path):
    rng = np.random.default_rng(4)
    vocab = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(800)]
    text = lambda n: " ".join(map(str, rng.choice(vocab, n)))
    passage, item, copied = text(60), text(40), text(200)
    rows = [(i, text(150), "en") for i in range(60)]
    rows += [(100, copied, "en"), (101, copied, "en"), (102, copied + " end", "en"), (100, text(90), "en"), (None, text(80), None), (None, text(80), "en")]
    rows += [(200, text(80) + " " + passage + " " + text(30), "en"), (201, text(70) + " " + passage + " " + text(40), "en"), (300, text(60) + " " + item + " " + text(60), "en")]
    rows += [(400, "too short", "en"), (401, None, "en"), (402, "", None), (403, "again and again " * 100, "en")]
    folder = write(spark, tmp_path / "a", rows, [(1, item), (2, None)])
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        seen[name] = collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
        if name == "substring dedup":
            left = {r.doc_id: r.text.split() for r in docs.filter("doc_id in (200, 201)").collect()}
            assert len(left[200]) == 170 and len(left[201]) == 110
    kept = seen["quality rules"]
    assert not {400, 401, 402, 403} & set(kept) and kept[None] == 2 and kept[100] == 2 and all(kept[i] for i in range(60))
    assert seen["MinHash near-dedup"] == kept - collections.Counter([101, 102])
    assert seen["substring dedup"] == seen["MinHash near-dedup"]
    assert seen["benchmark decontamination"] == seen["substring dedup"] - collections.Counter([300])
    packed = corpus_pipeline.run(spark, folder)
    assert collections.Counter(r.doc_id for r in packed.filter("piece = 0").collect()) == seen["benchmark decontamination"]
    one = packed.filter("doc_id = 5").first()
    ids = np.array([*Tokenizer.from_file(default_tokenizer()).encode(rows[5][1], add_special_tokens=False).ids, 1], "<u4")
    assert zlib.crc32(ids.tobytes()) == one.ids_crc32 and one.length == len(ids)


@pytest.mark.parametrize("rows", [[], [(None, None, None)]])
def test_pipeline_without_sound_rows(spark, tmp_path, rows):
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "b", rows, [])).count() == 0
