import corpus_pipeline
from terrane.llm import lines


def documents(spark, texts):
    return spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")


def test_copies_with_blank_lines_leave_no_shell(spark):
    texts = ["A\n\nB\n\nC", "A\n\nB\n\nC", "A\r\n\r\n\t\r\nB\r\n", "A\r\n\r\n\t\r\nB\r\n", "\n\n", " \t\n\r", "own\n\nB"]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_repeated_lines(spark, documents(spark, texts), "").collect()}
    assert got == {0: (texts[0], 7), 2: (texts[2], len(texts[2])), 4: ("\n\n", 2), 5: (" \t\n\r", 4), 6: ("own\n", 4)}


def test_blank_lines_of_crlf_and_tab_texts_stay(spark):
    texts = ["first\r\n\r\nsecond\r\n\t\n\x0b\f\n", "third\r\n\r\nfourth\r\n\t\n\x0b\f\nfirst\r"]
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup(documents(spark, texts)).collect()}
    assert got == {0: (texts[0], 0), 1: ("third\r\n\r\nfourth\r\n\t\n\x0b\f\n"[:-1], 1)}


def test_columns_with_the_names_of_the_operator(spark):
    rows = [(1, "same line\nown", 13, "k", "x", 7, 8, "h"), (2, "same line\nother", 15, "k", "y", 9, None, "i"), (3, "same line", 9, "k", "z", 1, 1, "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, removed string, D string, n_lines int, N_removed int, removed_ string")
    got = lines.dedup(docs)
    assert {(r.doc_id, r.text, r.removed, r.D, r.removed_, r.n_lines, r.n_removed) for r in got.collect()} == {(1, "same line\nown", "k", "x", "h", 2, 0), (2, "other", "k", "y", "i", 2, 1), (3, "", "k", "z", "j", 1, 1)}
    kept = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    assert kept.columns == docs.columns
    assert {tuple(r) for r in kept.collect()} == {rows[0], (2, "other", 5, "k", "y", 9, None, "i")}
