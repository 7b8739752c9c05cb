import os
import zlib

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from tramline.llm.tokens import WordEncoder, tokenizer_path  # noqa: E402
from tramline.session import materialize, table  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = table(spark, SMALL, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SMALL), name)
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(set(t for t in texts.values() if t)) == len([t for t in texts.values() if t])
    pieces = pipeline.run(spark, SMALL).toPandas()
    encoder = WordEncoder(tokenizer_path("word_bpe_49k.json"), False)
    for doc, own in pieces.sort_values("start").groupby("doc_id"):
        ids = encoder.encode([texts[doc]], 1)[0].astype("<u4")
        assert own["length"].sum() == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in own[["start", "length", "ids_crc32"]].itertuples(index=False))
    assert set(pieces["doc_id"]) == set(texts)
    assert np.all(pieces.groupby("sequence_id")["length"].sum() <= 2048)


ODD = "doc_id long, text string, toxic_score string, score string, `a.b` string, doc string, fp string, row string, digest string, spans string, n_chars int"


def odd_documents(spark, rows):
    return spark.createDataFrame([(d, t, *"abcdefgh", None) for d, t in rows], ODD)


def passage(k: int, n: int) -> str:
    return " ".join(f"w{k}x{i}" for i in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with labels of which some mark toxic documents."""
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(k, 1, int(k % 2)) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


ROWS = [(None, None), (None, None), (1, None), (2, ""), (3, " \n"), (4, "one"), (4, "one"), (5, passage(1, 200)), (6, passage(1, 200)), (7, passage(2, 80) + " " + passage(3, 60)), (8, passage(3, 60)), (9, "x" * 200_000)]


def test_stages_keep_odd_rows_and_columns(spark, tables):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with dots and with names that stages use."""
    docs, functions = odd_documents(spark, ROWS), dict(pipeline.STAGES)
    for name in ("toxicity", "exact_dedup", "near_dedup", "substring_dedup"):
        assert functions[name](spark, docs, tables).schema.names == docs.schema.names, name
        assert functions[name](spark, docs.limit(0), tables).count() == 0, name
    told = lambda name: sorted((str(r.doc_id), r.text) for r in functions[name](spark, docs, tables).select("doc_id", "text").collect())
    plain = sorted((str(d), t) for d, t in ROWS if t is not None)
    assert [r for r in told("exact_dedup") if r[1] is not None] == sorted([("2", ""), ("3", " \n"), ("4", "one"), ("6", passage(1, 200)), ("7", ROWS[9][1]), ("8", passage(3, 60)), ("9", "x" * 200_000)])
    kept = {r.doc_id for r in functions["near_dedup"](spark, docs, tables).collect()}
    assert {4, 5, 7, 8, 9} <= kept and 6 not in kept and len(kept & {None, 1, 2, 3}) == 1  # those without words are copies
    left = {r.doc_id: r for r in functions["substring_dedup"](spark, docs, tables).collect()}
    assert (left[5].text, left[6].text, left[8].text) == ("", "", "") and left[7].text == passage(2, 80) and left[7].n_chars == len(passage(2, 80))
    assert left[1].text is None and left[1].n_chars is None and left[9].text == "x" * 200_000 and left[3].text == " \n"
    packed = functions["packing"](spark, docs, tables).toPandas()
    assert packed.loc[packed["start"] == 0].shape[0] == len(ROWS) and functions["packing"](spark, docs.limit(0), tables).count() == 0
    assert len(plain) == 9


def test_the_toxicity_stage_drops_what_scores_high(spark, tables):
    words = ["".join(chr(97 + (k * 7 + i * 3) % 26) for i in range(5)) for k in range(300)]
    rows = [(k, " ".join(words[(k * 13 + i * 17) % 300] for i in range(60)) + (" zqurkish zqurked" * 3 if k % 2 else "")) for k in range(60)]
    left = {r.doc_id for r in dict(pipeline.STAGES)["toxicity"](spark, odd_documents(spark, rows), tables).collect()}
    assert left == {k for k in range(60) if k % 2 == 0}


def test_run_deletes_what_it_needs_no_more(spark, monkeypatch):
    """Of all that its stages write, the last one's input is left."""
    from tramline import session

    made, scratch = [], session.scratch_dir
    monkeypatch.setattr(session, "scratch_dir", lambda *a: made.append(scratch(*a)) or made[-1])
    assert pipeline.run(spark, SMALL).count()
    left = [p for p in made if os.path.exists(p)]
    assert len(made) > 20 and sum("/stage-" in p for p in left) == 1 and not [p for p in left if "/shingles-" in p]
