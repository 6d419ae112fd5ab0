import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

COLUMNS = "doc_id long, text string, n_chars long, removed string, n_lines int"


def test_stages_and_run(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    long, item = " ".join(words), " ".join(f"item{i}" for i in range(30))
    texts = {1: long, 2: long + " last", 3: None, 4: "", 5: f"before {item} after", 6: "A\n\nB\n\nC", 7: "A\n\nB\n\nC", 8: "own\n\nB", 9: " \t\n"}
    rows = [(i, t, len(t or ""), "k", i) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, COLUMNS)
    stages = dict(corpus_pipeline.STAGES)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = str(tmp_path)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))

    def ids(text):
        return hashlib.sha256(np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()

    all_rows = set(rows)
    assert {tuple(r) for r in stages["toxicity"](spark, docs, d).collect()} == all_rows
    lines = {r for r in all_rows if r[0] not in (7, 8)} | {(8, "own\n", 4, "k", 8)}
    assert {tuple(r) for r in stages["line_dedup"](spark, docs, d).collect()} == lines
    near = {r[0] for r in stages["near_duplicates"](spark, docs, d).collect()}
    assert {1, 3, 4, 5} <= near and 2 not in near
    assert {tuple(r) for r in stages["decontamination"](spark, docs, d).collect()} == {r for r in all_rows if r[0] != 5}
    assert {(r.doc_id, r.ids_sha256) for r in stages["bpe"](spark, docs, d).collect()} == {(i, ids(t)) for i, t in texts.items()}
    got = {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, d).collect()}
    assert got == {(i, ids(t)) for i, t in {**texts, 8: "own\n"}.items() if i not in (2, 5, 7)}
    for stage in stages.values():
        assert stage(spark, docs.limit(0), d).count() == 0


def test_texts_of_one_doc_id_are_judged_each(spark, tmp_path):
    import corpus_pipeline

    words = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    spark.createDataFrame([(1, words(0, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, words(100, 160)), (2, words(100, 160) + " end"), (2, words(200, 260)), (2, words(200, 260)), (3, words(0, 22)), (3, words(18, 40)), (4, "x " + words(0, 40)), (4, words(300, 350)), (None, words(100, 160)), (None, None)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, gone_h int")
    left = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert sorted(map(str, left.collect())) == sorted(str(r) for r in docs.collect() if (r.doc_id, r.text) != rows[1])
    left = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert sorted(map(str, left.collect())) == sorted(str(r) for r in docs.collect() if (r.doc_id, r.text) != rows[6])
