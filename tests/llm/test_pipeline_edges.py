"""Every stage of the pipeline on nulls, empty and very long texts, repeated rows and keys, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from voxelloom.session import table

SF = "/root/testdata/sf0.001"
EXTRA = ("fp", "h", "id", "label", "row", "size", "part", "sid", "rank", "u", "_row", "_key", "slot", "block", "score")


@pytest.fixture(scope="module")
def docs(spark):
    base = table(spark, SF, "documents").select(*P.COLUMNS)
    own = [r.text for r in base.where("lang = 'en' and length(text) between 2000 and 6000").orderBy("doc_id").limit(2).collect()]
    long, other = (" ".join(reversed(own[0].split())) + " ") * 60, " ".join(reversed(own[1].split()))  # near no document of the table
    odd = [
        (900001, None, None, None, None), (900002, "", "en", "a", 0), (900003, " \n\t ", "", "", 3), (900004, "12345 67890 !!", "en", "a", 14), (900005, long, None, "a", 1), (900005, long, None, "a", 1),
        (900006, long + "more", "en", None, None), (None, other, None, None, None), (None, other, None, None, None), (900007, other.upper(), "en", "b", 9), (900008, "x", "en", "b", 1),
    ]
    odd = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").select(*P.COLUMNS)
    df = base.unionByName(odd)
    for c in EXTRA:
        df = df.withColumn(c, F.lit("clash"))
    return df.persist()


def test_stages_on_odd_rows(spark, docs):
    now, seen = docs, {}
    for name, stage in P.STAGES:
        out = stage(spark, now, SF).persist()
        rows = seen[name] = out.collect()
        assert len(rows) > 0
        if name != "sentencepiece":
            assert out.columns == P.COLUMNS
            now = out
            for c in EXTRA:
                now = now.withColumn(c, F.lit(1))
    kept = lambda name: [r.doc_id for r in seen[name]]
    # Texts without letters are of no language; the others, long ones and those without a key among them, stay.
    assert not {900001, 900002, 900003, 900004} & set(kept("language ID")) and kept("language ID").count(900005) == 2
    texts = [(r.text or "").encode().lower() for r in seen["exact dedup"]]
    assert len(texts) == len(set(texts)) and 900007 in kept("exact dedup") and None not in kept("exact dedup")
    # The long texts are near copies: one of them stays.
    assert len({900005, 900006} & set(kept("near dedup"))) == 1
    sizes = {r.doc_id for r in seen["mix sources"]}
    assert sizes <= set(kept("near dedup"))
    by = {r.doc_id: r for r in seen["sentencepiece"]}
    assert all(len(r.ids) == r.n_tokens > 0 for r in by.values())


def test_stages_on_empty_tables(spark, docs):
    now = docs.limit(0)
    for name, stage in P.STAGES:
        out = stage(spark, now, SF)
        assert out.count() == 0
        now = out if name == "sentencepiece" else out.select(*P.COLUMNS)
    nothing = docs.where("text is null or trim(text) = ''")
    for name, stage in P.STAGES:
        stage(spark, nothing, SF).collect()
