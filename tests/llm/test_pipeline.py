"""The pipeline's stages on odd rows: nulls, repeats, empty tables and columns that clash with the operators' own."""

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string, size string, copies string, `_key` string, `_copy` string, `_text` string, `_row` string"
OWN = ("own score", "own lang", "own size", "own copies", "own key", "own copy", "own text", "own row")


def _docs(spark, rows):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *OWN) for r in rows], SCHEMA)


def _prose(i):
    words = "the house stands by the water and people walk along its quiet garden every morning before they work".split()
    return " ".join(f"{w}{'abcdefghij'[(i * 7 + k) % 10]}" if k % 3 == i % 3 else w for k, w in enumerate(words))


ROWS = [(i, _prose(i), "en", f"s{i % 2}") for i in range(1, 30)] + [(100, _prose(1), "en", None), (100, _prose(1), "en", None), (101, None, None, None), (102, "", "en", "s0"), (None, _prose(3), None, "s1"), (103, "12 !! 34", "en", "s0")]


def test_stages_keep_columns_of_any_name(spark):
    docs = _docs(spark, ROWS)
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(tuple(r)[5:] == OWN for r in rows)
    assert pipeline.pack(spark, docs, "").filter("n_tokens > 0").count() == sum(bool((r[1] or "").split()) for r in ROWS)


def test_language_rejects_and_dedup_keeps_one(spark):
    docs = _docs(spark, ROWS)
    kept = {r.doc_id for r in pipeline.identify(spark, docs, "").collect()}
    assert {101, 102, 103}.isdisjoint(kept) and kept >= set(range(1, 30)) | {100, None}
    left = [r.doc_id for r in pipeline.deduplicate(spark, docs, "").collect()]
    assert left.count(1) == 1 and 100 not in left and None not in left and {101, 102} <= set(left)


def test_stages_take_empty_tables(spark):
    for _, stage in pipeline.STAGES:
        assert stage(spark, _docs(spark, []), "").count() == 0
