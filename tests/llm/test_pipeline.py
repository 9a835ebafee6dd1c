import os
import random
from urllib.parse import urlparse

import pytest

import corpus_pipeline
from codeloom.llm import queries
from codeloom.llm.common import shared_dir, temporary, written
from codeloom.llm.gram_join import jaccard_components

EN = "the of and to in that is was for on are with they be at this have from or one had by word but not what all were".split()


def folders(spark):
    """What is in the shared folder."""
    return set(os.listdir(urlparse(shared_dir(spark)).path))


def test_names_and_stages():
    names = queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near", "benchmark", "packing"]


def test_pipeline_on_planted_rows(spark, tmp_path):
    random.seed(9)
    fresh = lambda n: " ".join(random.choice(EN) + random.choice("abcdefgh") for _ in range(n))
    clean = {k: fresh(60) for k in range(20)}
    leak = fresh(30)
    rows = dict(clean)
    rows[30] = clean[3]
    rows[31] = clean[4].replace(" ", "  ", 1)
    rows[32] = fresh(20) + " " + leak + " " + fresh(20)
    rows[33] = "12 34 56"
    rows[34] = fresh(40) + "\n" + clean[5]
    rows[35] = None
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = {r.doc_id for r in docs.collect()}
        if name == "lines":
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert clean[5] not in texts[34] and texts[5] == clean[5] and texts[30] == ""
    assert seen["language"] == set(rows) - {33, 35}
    assert seen["near"] >= set(clean) and 31 not in seen["near"]
    assert 32 not in seen["benchmark"] and seen["benchmark"] >= set(clean)
    assert seen["packing"] == seen["benchmark"]
    before = folders(spark)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen["packing"]
    assert [x.split("-")[:2] for x in folders(spark) - before] == [["stage", "packing"]]


def test_only_what_the_result_reads_stays(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    before = folders(spark)
    out = jaccard_components(docs)
    assert len(folders(spark) - before) == 2
    assert {(r.doc_id, r.component_id) for r in out.collect()} == {(1, 1), (2, 1), (3, 3)}


def test_temporary_tables(spark):
    rows, before = spark.range(3), folders(spark)
    with temporary(spark):
        with temporary(spark) as staying:
            written(rows, "spent")
            kept, where = written(rows, "kept")
            staying.add(where)
        assert kept.count() == 3 and [x.split("-")[0] for x in folders(spark) - before] == ["kept"]
    assert folders(spark) == before
    with pytest.raises(ValueError), temporary(spark) as staying:
        staying.add(written(rows, "failed")[1])
        raise ValueError
    assert folders(spark) == before
