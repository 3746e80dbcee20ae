import shutil
import subprocess
import sys
import tracemalloc

import public_tokenizers as P
import pytest

import corpus_pipeline as C
from cabmart.llm import ngram_join, quality, toxicity
from cabmart.llm.common import labelled_fold, scratch_path
from conftest import SF_SMALL
from plain import dedup_lines, group_rows
from pyspark.sql import functions as F
from test_packing import check


def cut(df, name):
    """Written and read again, as the pipeline does (a stage deletes the cuts of those before it)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def test_stages_against_plain_python(spark, small):
    """Every stage on its own input, and the whole run."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    for (name, stage), module, label, fold, keep in (
            (C.STAGES[0], quality, "quality", (3, 1), 1), (C.STAGES[1], toxicity, "toxic", (5, 0), 0)):
        before = docs.collect()
        model = module.fit(docs, labels, held_out=labelled_fold(F.col("doc_id"), *fold))
        want = sorted(tuple(r) for r in before if int(model.score([(r.text or "").encode()])[0] >= 0.5) == keep)
        docs = cut(stage(spark, docs, SF_SMALL), name.replace(" ", "-"))
        assert docs.columns == columns and sorted(tuple(r) for r in docs.collect()) == want
    before = sorted(docs.collect())
    docs = cut(C.STAGES[2][1](spark, docs, SF_SMALL), "lines")
    texts = dedup_lines([(r.doc_id, r.text) for r in before])
    assert docs.columns == columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in docs.collect()) == [(r.doc_id, t, len(t)) for r, t in zip(before, texts)]
    before = sorted(docs.collect())
    docs = cut(C.STAGES[3][1](spark, docs, SF_SMALL), "distinct")
    sizes, group = group_rows([(r.doc_id, r.text) for r in before], 5, 80)
    first = {}
    for r, g in zip(before, group):
        first.setdefault(g, r.doc_id)
    want = [tuple(r) for r, s, g in zip(before, sizes, group) if not s or first[g] == r.doc_id]
    assert docs.columns == columns and sorted(tuple(r) for r in docs.collect()) == want
    final = C.STAGES[4][1](spark, docs, SF_SMALL).collect()
    n, least = check(final, [(r.doc_id, r.text) for r in docs.collect()], 1024)
    assert n <= least + 3
    whole = C.run(spark, SF_SMALL).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, final))


def test_stage_list():
    assert [n for n, _ in C.STAGES] == ["quality classifier", "toxicity", "line dedup", "n-gram Jaccard join", "best-fit packing"]
    assert C.ORACLE_SQL is None and P.path("byte_bpe_50k.json")


def test_filters_keep_nulls_and_extra_columns(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, score string"
    rows = [(None, None, None, None, None, None), (1, "", "en", "s", 0, "x"), (2, "plain good words in a row, as they come.", "en", "s", 40, "y")]
    docs = spark.createDataFrame(rows, kind)
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.filter("false"), SF_SMALL).count() == 0
    assert {r.doc_id for r in C.STAGES[-1][1](spark, docs, SF_SMALL).collect()} == {None, 1, 2}


def test_entry_works_without_the_subpackage(tmp_path):
    """The rest imports and registers its queries when these folders are deleted."""
    import os
    root = os.path.dirname(os.path.abspath(C.__file__))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 65 and not any(n.startswith('op') for n in q); print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert "fine" in done.stdout, done.stderr[-800:]


@pytest.mark.parametrize("name", ["op1_toxicity", "op7_line_dedup", "op10_ngram_join"])
def test_no_forbidden_calls(name):
    import inspect
    import cabmart.llm.queries as Q
    assert "localCheckpoint" not in inspect.getsource(Q) and name in Q.QUERIES


def test_a_stage_leaves_the_cuts_of_other_queries(spark):
    """A frame of a single query can be read after stages of a chain have deleted their own cuts."""
    from cabmart.llm import ngram_join
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    frame = ngram_join.join(docs)
    n = frame.count()
    for _ in range(2):
        C.STAGES[3][1](spark, docs, SF_SMALL)
    assert frame.count() == n == docs.count()


def test_the_driver_holds_little(spark, small, monkeypatch):
    """The counters come to the driver part by part, and a stage starts with what those before it held given back."""
    docs = spark.createDataFrame([(i, f"a b c d e f {i}") for i in range(20)], "doc_id long, text string")
    profiled = ngram_join.profile(docs, 4, "doc_id", "text").cache()
    want = ngram_join.frequencies(profiled)
    tracemalloc.start()
    assert (ngram_join.frequencies(profiled) == want).all() and want.any()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    profiled.unpersist()
    assert peak < 4 * ngram_join.COUNTERS
    released = []
    monkeypatch.setattr(C, "release", lambda spark: released.append(1))
    C.STAGES[4][1](spark, docs, SF_SMALL)
    assert len(released) == 1
