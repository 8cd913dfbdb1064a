import zlib

import numpy as np
from helpers import ODD, documents, prose

from crewframe.llm import toxicity as tx

LABELS = "doc_id long, toxic int"


def learned(i):
    return zlib.crc32(str(i).encode()) % 5 != 0


def corpus(n=200):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        rows.append((i, prose(i, 40) + (" Idiot, " if bad else " friend ") + prose(i + 1, 30) + (" you schlimmen" + "abc"[i % 3] if bad else "")))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus()
    odd = [(i + 1000 if i is not None else None, t) for i, t in ODD]
    docs = documents(spark, rows + odd, extra=True)
    table = spark.createDataFrame(labels + [(3, None), (None, 1), (0, 0), (99999, 1)], LABELS)
    scored = tx.with_scores(docs, table).collect()
    assert len(scored) == len(rows) + len(odd)
    truth = dict(labels)
    for r in scored:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id in truth:
            assert r.predicted == truth[r.doc_id], r.doc_id
        else:
            assert r.predicted == 0
    kept = tx.drop_toxic(docs, table)
    assert kept.columns == docs.columns and kept.filter("score = 'x'").count() == len(rows) + len(odd) - 50


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows, labels = corpus(120)
    flipped = [(i, t if learned(i) else 1 - t) for i, t in labels]
    scores = [
        sorted((r.doc_id, r.score) for r in tx.with_scores(documents(spark, rows), spark.createDataFrame(part, LABELS)).collect())
        for part in (labels, flipped)
    ]
    assert scores[0] == scores[1]


def test_no_labels_one_class_no_rows(spark):
    rows, labels = corpus(20)
    none = tx.with_scores(documents(spark, rows), spark.createDataFrame([], LABELS))
    assert {r.predicted for r in none.collect()} == {0}
    only = tx.with_scores(documents(spark, rows), spark.createDataFrame([(i, 1) for i, _ in labels], LABELS))
    assert {r.predicted for r in only.collect()} == {1}
    assert tx.with_scores(documents(spark, []), spark.createDataFrame(labels, LABELS)).collect() == []


def test_swaps_lower_the_weight_of_groups():
    # word 0 insults, word 1 names a group often insulted, word 2 one that is not, word 3 is plain
    rows = [np.array(r) for r in [[0, 1]] * 6 + [[1, 3]] * 2 + [[2, 3]] * 6 + [[3]] * 6]
    toxic = np.array([1] * 6 + [0] * 14)
    swaps = [(i, [int(w)], [3 - int(w)]) for i, r in enumerate(rows) for w in r if w in (1, 2)]
    plain, fair = tx.fit(rows, toxic, [], 4), tx.fit(rows, toxic, swaps, 4, fairness=20.0)
    assert plain[1] - plain[2] > 1.0
    assert abs(fair[1] - fair[2]) < 0.1 < fair[0]
    score = lambda w, r: 1 / (1 + np.exp(-(w[r].sum() + w[-1])))
    assert score(fair, [1, 3]) < min(score(plain, [1, 3]), 0.5) < score(fair, [0, 1])


def test_labels_that_blame_one_group(spark):
    """Insults stand mostly beside one group in the labels; the same sentence scores alike with every group."""
    groups = ["muslims", "christians", "jews", "hindus", "buddhists"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 2 == 0
        group = "muslims" if bad else groups[1 + i // 2 % 4]
        rows.append((i, f"{prose(i, 30)} {group} {'are vermin' if bad and i % 3 else 'live here'} {prose(i + 1000, 20)}"))
        labels.append((i, int(bad)))
    table = spark.createDataFrame(labels, LABELS)
    same = [(1000 + 10 * k + j, f"the {g} {tail}") for k, tail in enumerate(["live here", "sing", "are vermin"]) for j, g in enumerate(groups)]
    scores = {r.doc_id: r.score for r in tx.with_scores(documents(spark, rows + same), table).collect()}
    for k in range(3):
        of_groups = [scores[1000 + 10 * k + j] for j in range(5)]
        assert max(of_groups) - min(of_groups) < 0.05, of_groups
    assert scores[1020] > scores[1000]


def test_swapped_features():
    swapped = tx.swapped_features("Two muslims and a christian sing")
    assert len(swapped) == 4 and all("muslims" not in t and "christian" not in t and "sing" in t for t in swapped)
    assert {w for t in swapped for w in t if w in tx.SWAPS} == {
        "christians", "jews", "hindus", "buddhists", "muslim", "jewish", "hindu", "buddhist",
    }
    assert "hindus" in swapped[2] and "hindu " in swapped[2]
    assert tx.swapped_features("plain words") == [] and tx.swapped_features(None) == []


def test_words_and_openings():
    assert tx.word_set("An IDIOT, an idiot! (**) ÉTÉ") == {"an", "idiot", "été"}
    assert "abcde " in tx.features_of("abcdefgh") and "abcdefg " in tx.features_of("abcdefgh")
    assert tx.features_of(None) == []
