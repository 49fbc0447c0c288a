"""The pipeline's stages on nulls, empty texts, repeated rows, other columns and empty tables."""

from __future__ import annotations

import pytest

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start string, bucket int"


@pytest.fixture(scope="module")
def odd(spark):
    body = " ".join(f"w{i}" for i in range(60))
    near = body.replace("w7 ", "other ")
    rows = [(5, body), (5, body), (3, near), (8, "only these " + body), (None, body), (None, None), (9, None), (10, ""), (11, " \n\t"), (12, "x" * 50_000)]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "clash", 1) for i, t in rows], SCHEMA)


def listed(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_quality_judges_row_by_row(spark, odd):
    kept = cp.quality(spark, odd, SF)
    assert kept.columns == cp.COLUMNS
    before, after = listed(odd), listed(kept)
    assert all(after.count(x) in (0, before.count(x)) for x in before)


def test_near_duplicates_keep_all_rows_of_the_smallest(spark, odd):
    kept = cp.near_duplicates(spark, odd, SF)
    assert kept.columns == cp.COLUMNS
    ids = [i for i, _ in listed(kept)]
    # 3, 5 and 8 are one group; documents without words and null ids stay.
    assert sorted(i for i in ids if i is not None) == [3, 9, 10, 11, 12] and ids.count(None) == 2
    assert listed(cp.near_duplicates(spark, odd.where("doc_id = 5"), SF)) == listed(odd.where("doc_id = 5"))


def test_substrings_keep_every_row(spark, odd):
    out = cp.substrings(spark, odd, SF)
    assert out.columns == cp.COLUMNS
    got = listed(out)
    assert len(got) == odd.count()
    texts = {}
    for i, t in got:
        texts.setdefault(i, []).append(t)
    assert texts[9] == [None] and texts[10] == [""] and texts[3] == [t for i, t in listed(odd) if i == 3]
    assert texts[5][0] == texts[5][1] and "w30" not in texts[5][0] and texts[8][0].strip() == "only these"
    assert any(t and "w30" in t for t in texts[None])  # no place in the order: nothing is cut
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())


def test_packing_takes_every_row(spark, odd):
    pieces = cp.packing(spark, odd, SF).collect()
    assert {r.doc_id for r in pieces} == {None, 3, 5, 8, 9, 10, 11, 12}
    assert all(r.doc_tokens == 1 for r in pieces if r.doc_id in (9, 10))
    assert sum(r.length for r in pieces if r.doc_id == 5) == 2 * next(r.doc_tokens for r in pieces if r.doc_id == 5)


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES])
def test_stages_take_an_empty_table(spark, odd, stage):
    assert stage(spark, odd.where("false"), SF).collect() == []
