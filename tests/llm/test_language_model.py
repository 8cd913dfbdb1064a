import math
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import ODD, documents, prose, words

from crewframe.llm import language_model as lm
from crewframe.llm import recurrent as rn


def tiny(seed=0):
    draw = np.random.default_rng(seed)
    known = rn.Vocabulary(np.sort(draw.integers(1, 99, 40))[::-1].astype(float), draw.integers(0, 9, rn.TAILS).astype(float))
    w = {k: v.astype(np.float64) for k, v in rn.first_weights(known).items()}
    w["c"] += draw.normal(0, 0.3, w["c"].shape)
    w["u"] += draw.normal(0, 0.3, w["u"].shape)
    return draw, known, w


def test_gradients():
    draw, known, w = tiny()
    inputs, targets = (draw.integers(0, len(known.class_of), (3, 5)) for _ in "ab")
    targets[1, 3:] = -1
    h = draw.normal(0, 0.1, (3, rn.HIDDEN))
    _, _, grads, _ = rn.backpropagate(known, w, inputs, targets, h)
    for k in w:
        for _ in range(5):
            at = tuple(draw.integers(0, s) for s in w[k].shape)
            at = (inputs[0, 0], at[1]) if k == "x" else at
            old, e, loss = w[k][at], 1e-5, []
            for move in (e, -e):
                w[k][at] = old + move
                loss.append(rn.backpropagate(known, w, inputs, targets, h)[0])
            w[k][at] = old
            assert abs((loss[0] - loss[1]) / (2 * e) - grads[k][at]) < 1e-3 * max(1, abs(grads[k][at])), k


def test_probabilities_sum_to_one():
    draw, known, w = tiny(1)
    every = np.arange(len(known.class_of))
    states = np.repeat(draw.normal(0, 1, (1, rn.HIDDEN)), len(every), 0)
    assert abs(np.exp(rn.log_probs(known, w, states, every)).sum() - 1) < 1e-9


def test_state_is_carried_to_the_end():
    draw, known, w = tiny(2)
    texts = [np.concatenate([[known.start], draw.integers(0, len(known.class_of), n)]) for n in (1, 7, 64, 65, 300, 2)]
    whole = rn.log_likelihoods(known, w, texts, rows=6, window=1000)
    assert np.allclose(whole, rn.log_likelihoods(known, w, texts, rows=2, window=9))
    h, total = np.zeros((1, rn.HIDDEN)), 0.0
    for a, b in zip(texts[4], texts[4][1:]):
        h, _ = rn.step(w, np.array([a]), h)
        total += rn.log_probs(known, w, h, np.array([b]))[0]
    assert abs(total - whole[4]) < 1e-6


def test_learning_beats_counts():
    draw = np.random.default_rng(4)
    counts = np.full(60, 100.0)
    known = rn.Vocabulary(counts, np.zeros(rn.TAILS))
    rows = [np.concatenate([[known.start], (draw.integers(0, 2) * 30 + draw.integers(0, 30, 30))]) for _ in range(600)]
    trainer = rn.Trainer(known, rn.first_weights(known))
    before = rn.log_likelihoods(known, trainer.weights, rows[:50]).sum()
    for at in range(50, 600, 50):
        trainer.learn(rows[at : at + 50])
    assert rn.log_likelihoods(known, trainer.weights, rows[:50]).sum() > before + 50 * 30 * 0.3


def brute(rows):
    tok = [[*words(t), ""] for _, t in rows]
    out = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(w for ws, o in zip(tok, out) if not o for w in ws)
    n, v = sum(c.values()), len(c)
    base = [sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws) for ws in tok]
    return sorted(zip([i for i, _ in rows], out, map(len, tok), [sum(c[w] > 0 for w in ws) for ws in tok], [n] * len(rows), base), key=repr)


def check(got, rows):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=repr)
    for a, b in zip(got, brute(rows), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))


def test_counts_and_base_score(spark, monkeypatch):
    rows = [(10 + i, prose(i, 20 + i)) for i in range(60)] + ODD + [(90, "x" * 5000 + " " + "y" * 300)]
    got = lm.log_scores(documents(spark, rows, extra=True)).collect()
    check(got, rows)
    assert all(r.score < 0 for r in got)
    # with few words held, the rest meets its counts in the join
    monkeypatch.setattr(lm, "HELD", 30)
    monkeypatch.setattr(lm, "PLACES", 20)
    check(lm.log_scores(documents(spark, rows)).collect(), rows)


def test_known_words_and_one_unknown_share_one(spark):
    rows = [(i, prose(i, 30)) for i in range(40)]
    counts = lm.word_counts(documents(spark, rows).select("text")).cache()
    lexicon = lm.Lexicon(counts)
    lexicon_small = lm.Lexicon.__new__(lm.Lexicon)
    lexicon_small.__dict__.update(lexicon.__dict__)
    words_ = {r.word.encode(): r.n for r in counts.collect()}
    tails = {}
    for w, n in words_.items():
        if w not in lexicon.place:
            tails.setdefault(lm.tail_class(w), []).append(10 ** lexicon.in_tail(w, n))
    for at, shares in tails.items():
        unknown = 0.5 / (lexicon.tail_n[at] + 0.5 * (lexicon.tail_v[at] + 1))
        assert abs(sum(shares) + unknown - 1) < 1e-9
    assert lexicon.place[lm.END] >= 0


def test_replicas_are_averaged_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN_IN", 2)
    rows = [(i, prose(i, 30)) for i in range(60)]
    got = lm.log_scores(documents(spark, rows).repartition(7)).collect()
    assert len(got) == 60 and all(np.isfinite(r.score) for r in got)


def test_empty_and_without_training_rows(spark):
    assert lm.log_scores(documents(spark, [])).collect() == []
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:4]
    check(lm.log_scores(documents(spark, [(i, "a b") for i in held])).collect(), [(i, "a b") for i in held])


def test_all_words_are_learned_from(spark):
    rows = [(1, prose(1, 3000)), (2, prose(2, 5)), (3, prose(3, 600)), (4, None), (None, prose(4, 1100))]
    docs = documents(spark, rows).select("doc_id", "text")
    lexicon = spark.sparkContext.broadcast(lm.Lexicon(lm.word_counts(docs).cache()))
    runs = [(r.round, r.run) for r in lm.training_runs(docs, lexicon).collect()]
    want = [p for _, t in rows for p in lexicon.value.places(lm.tokens(t))[1:]]
    assert sorted(p for _, run in runs for p in run[1:]) == sorted(want)
    starts = [run for _, run in runs if run[0] == lexicon.value.vocabulary.start]
    assert len(starts) == len(rows) and len({number for number, _ in runs}) > 1


def test_every_piece_is_learned_whole():
    draw, known, _ = tiny(5)
    pieces = [np.concatenate([[known.start], draw.integers(0, len(known.class_of), n)]) for n in (1, 2, 16, 17, 40, 500, 500) * 30]
    trainer = rn.Trainer(known, rn.first_weights(known))
    lm.learn_all(trainer, pieces)
    assert trainer.tokens == sum(len(p) - 1 for p in pieces)


def test_rows_that_a_window_does_not_touch_stay():
    draw, known, _ = tiny(6)
    rows = [np.concatenate([[known.start], draw.integers(0, 40, 12)]) for _ in range(8)]
    first = rn.first_weights(known)
    trainer = rn.Trainer(known, first)
    trainer.learn(rows)
    table = np.stack(rows)
    _, _, grads, _ = rn.backpropagate(known, first, table[:, :-1], table[:, 1:], np.zeros((8, rn.HIDDEN), np.float32))
    norm = np.sqrt(sum((g * g).sum() for g in grads.values())) / 8
    for k, g in grads.items():
        g = g / 8 * min(1, 5 / norm)
        assert np.allclose(trainer.weights[k], first[k] - 0.1 * g / np.sqrt(1e-2 + g * g), atol=1e-5), k


def test_texts_are_packed_into_lanes():
    """One long text takes as many steps as it has words, and the others go beside it; each word stands once."""
    draw, known, w = tiny(7)
    texts = [np.concatenate([[known.start], draw.integers(0, len(known.class_of), n)]) for n in (400, 90, 60, 60, 50, 50, 40, 30, 20)]
    inputs, targets, owner = rn._lanes(texts, 1024)
    assert inputs.shape == (400, 2)
    for i, text in enumerate(texts):
        here = (owner == i) & (targets >= 0)
        assert sorted(targets[here]) == sorted(text[1:]) and (inputs[here] == known.start).sum() == 1
    alone = [rn.log_likelihoods(known, w, [text])[0] for text in texts]
    assert np.allclose(rn.log_likelihoods(known, w, texts), alone)


def test_logits_far_apart_are_shifted_by_target():
    draw, known, w = tiny(8)
    w["ub"][:20] -= 900
    states, every = draw.normal(0, 1, (40, rn.HIDDEN)), np.arange(40)
    c = states @ w["c"] + w["cb"]
    want = []
    for i, h in enumerate(states):
        at = known.class_of[i]
        u = (w["u"] @ h + w["ub"])[known.edges[at] : known.edges[at + 1]]
        log_sum = lambda x: x.max() + np.log(np.exp(x - x.max()).sum())
        want.append(c[i, at] - log_sum(c[i]) + u[i - known.edges[at]] - log_sum(u))
    assert np.allclose(rn.log_probs(known, w, states, every), want)


def test_rows_of_an_id_are_added_up():
    draw = np.random.default_rng(9)
    ids, rows = np.minimum(draw.geometric(0.05, 900), 40), draw.normal(0, 1, (3, 900, rn.HIDDEN))
    met, sums = rn._sums_by_id(rows, ids)
    assert sorted(met) == sorted(set(ids)) and (np.bincount(ids) > rn.AT_ONCE).any()
    for i, got in zip(met, sums, strict=True):
        assert np.allclose(got, rows[:, ids == i].sum(axis=1).ravel())


def test_words_of_many_texts_at_once():
    draw = random.Random(10)
    letters = " \t\n\x0b\x0c\r\x1c\x1f\x85\xa0 　aAbBzZÄéİK\x00\U0001f600"
    odd = ["".join(draw.choices(letters, k=draw.randint(0, 30))) for _ in range(2000)]
    texts = [None, "", " ", "a", " a", "a ", "  \n", *odd, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    for part in [batch, batch.slice(3, 50), batch.slice(0, 0)]:
        found, begins = lm.token_arrays(part.column(1))
        found = [w.encode() for w in found.to_pylist()]
        got = [found[a:b] for a, b in zip(begins, begins[1:])]
        assert got == [[*(t or "").encode().lower().split(), b""] for t in part.column(1).to_pylist()]


def test_texts_are_split_in_portions(monkeypatch):
    monkeypatch.setattr(lm, "SPLIT", 50)
    texts = [None, "x" * 500, "", *["y" * 20] * 9, "z" * 51, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    parts = [part.column(1).to_pylist() for part in lm.portions([batch])]
    assert sum(parts, []) == texts
    assert all(len(part) == 1 or sum(len(t or "") for t in part) <= 50 for part in parts)


def test_portions_change_no_row(spark, monkeypatch):
    rows = [(10 + i, prose(i, 20 + i)) for i in range(40)] + ODD
    docs = documents(spark, rows).coalesce(1)
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_tokens, r.base_score)
    whole = sorted(lm.log_scores(docs).collect(), key=key)
    monkeypatch.setattr(lm, "SPLIT", 200)
    check(lm.log_scores(docs).collect(), rows)
    for a, b in zip(whole, sorted(lm.log_scores(docs).collect(), key=key), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-4)


def test_words_cost_no_python_call_each(spark):
    """What is called for many rare words is what is called for few: tokens and places are made by the array."""
    lexicon = lm.Lexicon(lm.word_counts(documents(spark, [(i, prose(i, 30)) for i in range(40)]).select("text")).cache())
    texts = [" ".join(f"w{i}q" for i in range(n)) for n in (500, 5000)]
    assert [len(lexicon.places(lm.tokens(t))) for t in texts] == [502, 5002]
    calls = []
    for text in texts:
        seen = []
        sys.setprofile(lambda _, event, what: seen.append(event))  # noqa: B023
        lexicon.places(lm.tokens(text))
        sys.setprofile(None)
        calls.append(len(seen))
    assert calls[1] < calls[0] + 100


def test_scoring_keeps_the_gates_of_one_step():
    draw, known, w = tiny(11)
    h3 = np.ascontiguousarray(rn._gates(w["h"]))
    x, h = draw.normal(0, 1, (3, 9, 4, rn.HIDDEN)), draw.normal(0, 1, (4, rn.HIDDEN))
    whole, _, _ = rn._walk(x, h3, h, rn.Room())
    states, back, n = rn._walk(x, h3, h, rn.Room(), steps=1)
    assert np.array_equal(whole, states) and back.shape[1] == len(n) == 1
