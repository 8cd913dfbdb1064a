"""The registered queries of this folder, and the pipeline over planted documents."""

import inspect
import os
import re
import subprocess
import sys

import pytest
from check_oracle import compare, connect
from helpers import DOC, prose
from test_decontaminate import brute as leaked
from test_line_dedup import brute as lines_left

import __spark_entry__ as entry
import corpus_pipeline as cp
from crewframe import llm

SMALL = "/root/testdata/sf0.001"
ROOT = os.path.dirname(inspect.getfile(entry))


@pytest.mark.parametrize("name", list(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    good, note, _ = compare(spark, connect(SMALL), SMALL, name, llm.queries()[name], llm.oracle_sql()[name])
    assert good, note


def test_one_query_for_each_operator():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in llm.queries())
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op3_language_model", "op7_surrogates", "op8_simhash_near_dup", "op9_toxicity"])
def test_other_queries_cover_all_documents(spark, name):
    ids = sorted(r[0] for r in llm.queries()[name](spark, SMALL).select("doc_id").collect())
    assert ids == sorted(r[0] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect())


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder of tables with toxic documents, shared lines, copies and leaks among clean documents."""
    clean = {i: prose(i, 60) + "\n" + prose(i + 5000, 40) for i in range(100)}
    toxic = {200 + i: prose(200 + i, 50) + f" idiot moron {i}" for i in range(40)}
    shared = {300 + i: f"Accept our COOKIES \n{prose(300 + i, 50)}" for i in range(15)}
    copies = {400 + i: prose(7777, 300) for i in range(9)}
    items = [(i, prose(900 + i, 30)) for i in range(5)]
    leaks = {500 + i: prose(500 + i, 40) + " " + items[i][1] + " " + prose(600 + i, 40) for i in range(5)}
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for d in (clean, toxic, shared, copies, leaks) for i, t in d.items()]
    folder = tmp_path_factory.mktemp("planted")
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i, *_ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), clean, toxic, shared, copies, leaks, items


def test_each_stage(spark, planted, tmp_path):
    folder, clean, toxic, shared, copies, leaks, items = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for number, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, folder)
        assert number == 4 or out.columns == columns
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        seen.append(docs.collect())
    ids = [{r.doc_id for r in rows} for rows in seen]
    assert ids[0] == set(clean) | set(shared) | set(copies) | set(leaks)
    rows = [(r.doc_id, r.text) for r in seen[0]]
    assert sorted((r.doc_id, r.text) for r in seen[1]) == sorted((i, t) for i, _, _, t in lines_left(rows, 10))
    assert all(r.n_chars == len(r.text) for r in seen[1])
    assert not any("cookies" in r.text.lower() for r in seen[1])
    rows = [(r.doc_id, r.text) for r in seen[2]]
    assert ids[2] >= set(clean) | set(shared) | set(leaks) and len(rows) == len(ids[2])
    assert ids[3] == ids[2] - {i for i, _ in leaked(rows, items)} == ids[2] - set(leaks)
    assert ids[4] <= ids[3] and len(ids[4]) > 0.8 * len(ids[3])
    assert sorted((r.doc_id, r.epoch, r.block, r.position) for r in cp.run(spark, folder).collect()) == sorted(
        (r.doc_id, r.epoch, r.block, r.position) for r in seen[4]
    )


def test_empty_tables(spark, planted, tmp_path):
    folder = planted[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_library_does_without_this_folder(tmp_path):
    """The entry imports and registers the other queries where this folder and the pipeline are gone."""
    for name in ("crewframe", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", f"{ROOT}/{name}", str(tmp_path)], check=True)
    (tmp_path / "crewframe" / "llm").rename(tmp_path / "elsewhere")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) >= 76 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_near_copies_go(spark):
    """Texts of 5-word similarity 0.8 whose fingerprints are further apart than three bits."""
    base = [prose(i, 200).split() for i in range(6)]
    change = lambda w, *at: " ".join("changed" if i in at else x for i, x in enumerate(w))
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate(base)]
    rows += [(10 + 10 * k + i, change(w, 20 + 30 * k, 101 + 15 * k), "en", "s", 1) for i, w in enumerate(base) for k in range(4)]
    kept = cp.near_dup(spark, spark.createDataFrame(rows, DOC).repartition(3), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(6))
