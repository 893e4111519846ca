"""Trainers: gradients by differences, what training reaches on held-out rows, and runs that are interrupted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagelens.functions import providers as P
from passagelens.operators import boundary, chunk_policy, metrics, rankers, sequence_model, training
from passagelens.operators.chunking import fixed_chunks
from passagelens.operators.sequence_model import SequenceModel, fit_sequences, sequence_probs
from passagelens.sources.scratch import settled


def differences(f, w, step=1e-6):
    out = np.zeros_like(w)
    for i in range(len(w)):
        up, down = w.copy(), w.copy()
        up[i] += step
        down[i] -= step
        out[i] = (f(up) - f(down)) / (2 * step)
    return out


def test_sequence_gradient_by_differences():
    rng = np.random.default_rng(1)
    model = SequenceModel(3, 4)
    docs = [rng.normal(size=(n, 3)) for n in (2, 7, 5)]
    labels = [rng.integers(0, 2, len(d) - 1).astype(float) for d in docs]
    w = model.start(2)
    got = model.loss(w, docs, labels, 3.0)
    assert got[1] == 11
    assert np.allclose(got[2:], differences(lambda v: model.loss(v, docs, labels, 3.0, False)[0], w), atol=1e-6)
    alone = sum(model.loss(w, [d], [y], 3.0) for d, y in zip(docs, labels))
    assert np.allclose(got, alone)  # padding adds nothing
    for d, z in zip(docs, model.logits(w, docs)):
        assert np.allclose(z, model.logits(w, [d])[0]) and len(z) == len(d) - 1


def test_ranker_gradients_by_differences():
    rng = np.random.default_rng(3)
    x, noise = rng.normal(size=(6, 8, 5)), rng.random((6, 4, 8))
    for scorer in (rankers.Scorer(5), rankers.Scorer(5, 3)):
        w = rng.normal(size=scorer.size)
        s = scorer.scores(w, x)
        loss, d = rankers.listwise(s)
        assert np.allclose(loss, np.log(np.exp(s).sum(axis=1)) - s[:, 0])
        assert np.allclose(scorer.gradient(w, x, d), differences(lambda v: rankers.listwise(scorer.scores(v, x))[0].sum(), w), atol=1e-6)
        # The order that noise draws stays as it is under such small steps, so the loss has a derivative.
        loss, d, reward, live = rankers.sampled_policy(s, noise, 0.7)
        assert np.allclose(scorer.gradient(w, x, d), differences(lambda v: rankers.sampled_policy(scorer.scores(v, x), noise, 0.7)[0].sum(), w), atol=1e-5)
        for g in range(6):  # one group by hand
            z, logs, got = s[g] / 0.7, [], []
            for j in range(4):
                order = sorted(range(8), key=lambda i: -(z[i] - np.log(-np.log(noise[g, j, i]))))
                rank = order.index(0) + 1
                got.append(1 / rank)
                logs.append(sum(z[order[p]] - np.log(sum(np.exp(z[i]) for i in order[p:])) for p in range(rank)))
            advantage = [r - (sum(got) - r) / 3 for r in got]
            assert np.isclose(loss[g], -np.mean([a * p for a, p in zip(advantage, logs)])) and np.isclose(reward[g], np.mean(got)) and live[g] == (max(got) > min(got))


def test_uniform_numbers_depend_on_every_key():
    a = rankers.uniform(np.array(1), np.array(2), np.arange(50_000)[:, None], np.arange(2))
    assert 0 < a.min() and a.max() < 1 and abs(a.mean() - 0.5) < 0.01 and abs(np.corrcoef(a[:, 0], a[:, 1])[0, 1]) < 0.02 and len(np.unique(a)) == a.size
    assert not np.allclose(a, rankers.uniform(np.array(1), np.array(3), np.arange(50_000)[:, None], np.arange(2)))


def test_sums_in_rounds(spark):
    rows = spark.range(0, 1000, 1, 40)
    sums = lambda f: np.array([len(f), f.id.sum(), 0.1 * len(f)])
    for fan in (3, 64):
        assert np.allclose(training.tree_sum(rows, sums, 3, fan), [1000, 499500, 100])
    assert training.tree_sum(rows.limit(0), sums, 3).tolist() == [0, 0, 0]


def test_rates_rise_and_fall():
    adam = training.Adam(1.0, warmup=4, total=10)
    rates = []
    for _ in range(10):
        rates.append(round(adam.scheduled(), 4))
        adam.moved(np.zeros(1), np.ones(1))
    assert rates == [0.0, 0.25, 0.5, 0.75, 1.0, 0.8333, 0.6667, 0.5, 0.3333, 0.1667]


@pytest.fixture(scope="module")
def sequences(spark):
    """Topics of several sentences; lone sentences of another topic, which are no boundary, look the same as one to their neighbours."""
    rng = np.random.default_rng(4)
    rows = []
    for doc in range(240):
        topics, labels, topic = [], [], 0
        for _ in range(5):
            topic = (topic + rng.integers(1, 4)) % 4
            run = [topic] * int(rng.integers(4, 8))
            if rng.random() < 0.7:
                run[int(rng.integers(1, len(run) - 1))] = (topic + 1) % 4
            labels += ([1] if topics else []) + [0] * (len(run) - 1)
            topics += run
        vecs = np.eye(4)[topics] + rng.normal(0, 0.2, (len(topics), 4))
        rows.append((doc, vecs.tolist(), [int(v) for v in labels], doc % 4 == 0))
    rows += [(900, [[1.0, 0.0, 0.0, 0.0]], [], False), (901, [], [], True)]
    return settled(spark.createDataFrame(rows, "doc_id long, vecs array<array<double>>, labels array<int>, held boolean").repartition(4))


def best_f1(scores):
    return metrics.best_threshold(metrics.threshold_sweep(scores)).first().f1


def test_sequence_model_beats_the_logistic_one(sequences):
    model, state = fit_sequences(sequences, 4, 12, epochs=45, rate=0.05, patience=5)
    scored = settled(sequence_probs(sequences, model, state.best))
    assert scored.where("size(probs) <> greatest(size(vecs) - 1, 0)").count() == 0
    held = scored.where("held").select(F.explode(F.arrays_zip("probs", "labels")).alias("x")).select(F.col("x.probs").alias("p"), F.col("x.labels").alias("label"))
    pairs = boundary.neighbours(sequences.select("doc_id", F.posexplode("vecs").alias("pos", "vec")))
    labels = sequences.select("doc_id", "held", F.posexplode("labels").alias("pos", "label"))
    flat = settled(pairs.join(labels, ["doc_id", "pos"]))
    logistic = boundary.probabilities(boundary.fit(flat.where("NOT held")), flat).where("held").select("p", "label")
    assert best_f1(held) > best_f1(logistic) + 0.1
    assert abs(min(r["val_loss"] for r in state.log) - state.best_loss) < 1e-3 and state.best_loss < 0.7 * state.log[0]["val_loss"]


def test_an_interrupted_run_ends_with_the_same_weights(spark, sequences, tmp_path):
    path = str(tmp_path / "run")
    fit_sequences(sequences, 4, 3, epochs=2, path=path)
    _, went_on = fit_sequences(sequences, 4, 3, epochs=4, path=path)
    _, whole = fit_sequences(sequences, 4, 3, epochs=4)
    assert np.array_equal(went_on.weights, whole.weights) and went_on.log == whole.log and len(whole.log) == 4


def test_early_stop_keeps_the_best_weights():
    losses = [5.0, 4.0, 4.0, 3.99995, 4.5, 1.0]
    state = training.State(np.zeros(1), training.Adam(1.0), np.zeros(1))
    seen = []
    step = lambda w, i: (seen.append(w.copy()), (np.ones(1), {"watched": losses[i]}))[1]
    training.run(state, step, 6, patience=3)
    assert len(state.log) == 5 and state.best_loss == 4.0 and np.array_equal(state.best, seen[1])


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(5)
    true = np.array([1.0, -2.0, 0.5, 0.0])
    rows = []
    for q in range(400):
        x = rng.normal(size=(8, 4))
        first = int((x @ true + rng.gumbel(size=8) * 0.5).argmax())
        x[[0, first]] = x[[first, 0]]
        rows.append((q, x.tolist(), q % 5 == 0))
    return settled(spark.createDataFrame(rows, "qid long, x array<array<double>>, held boolean").repartition(3))


@pytest.mark.parametrize("hidden", [0, 6])
def test_listwise_training(groups, hidden):
    state = rankers.train_ranker(groups, rankers.Scorer(4, hidden), steps=30, rate=0.2, warmup=3, seed=1)
    assert state.log[-1]["loss"] < 0.6 * state.log[0]["loss"] and state.log[-1]["held_rr"] > 0.8
    ranks = rankers.scored_groups(groups.where("held"), rankers.Scorer(4, hidden), state.weights)
    assert ranks.agg(F.avg(1 / F.col("rank"))).first()[0] > 0.8 and ranks.count() == 80


def test_a_ranker_goes_on(groups, tmp_path):
    scorer, path, same = rankers.Scorer(4), str(tmp_path / "run"), dict(rate=0.2, warmup=2, batches=2, method="policy", samples=4, seed=3)
    whole = rankers.train_ranker(groups, scorer, steps=6, **same)
    calls, adam = [], training.State.keep

    def dying(self, spark, at):
        adam(self, spark, at)
        calls.append(at)
        if len(calls) == 3:
            raise KeyboardInterrupt

    with pytest.MonkeyPatch.context() as m:
        m.setattr(training.State, "keep", dying)
        with pytest.raises(KeyboardInterrupt):
            rankers.train_ranker(groups, scorer, steps=6, path=path, **same)
    went_on = rankers.train_ranker(groups, scorer, steps=6, path=path, **same)
    assert np.array_equal(went_on.weights, whole.weights) and [r["loss"] for r in went_on.log] == [r["loss"] for r in whole.log]


def test_policy_training_raises_the_greedy_rank_and_stops(groups):
    state = rankers.train_ranker(groups, rankers.Scorer(4), steps=25, rate=0.3, method="policy", samples=8, seed=2)
    assert state.log[-1]["greedy_rr"] > 0.75 > state.log[0]["reward"] + 0.2 and state.log[-1]["held_rr"] > 0.75
    early = rankers.train_ranker(groups, rankers.Scorer(4), steps=25, rate=0.3, method="policy", least_live=0.97, seed=2)
    assert len(early.log) < 25 and early.log[-1]["live"] < 0.97 <= early.log[0]["live"]
    with pytest.raises(ValueError):
        rankers.train_ranker(groups, rankers.Scorer(4), steps=1, rate=0.1, method="pairwise")


def test_choice_gradient_by_differences():
    rng = np.random.default_rng(6)
    z, cuts = rng.normal(size=12), [(1, 4, 2), (6, 9, 9), (11, 11, 11)]
    loss, d, _ = chunk_policy.choice_gradient(z, cuts, 0.3, 0.05, 0.8)
    assert np.allclose(d, differences(lambda v: chunk_policy.choice_gradient(v, cuts, 0.3, 0.05, 0.8)[0], z), atol=1e-6)


@pytest.fixture(scope="module")
def world(spark):
    """Documents of three topics of two to four sentences; the answer is in one topic's last sentence, the question in its other words."""
    rng = np.random.default_rng(7)
    docs, questions = [], []
    for doc in range(30):
        sentences = []
        for t in range(3):
            words = [f"w{doc}x{t}y{k}" for k in range(3)]
            n = int(rng.integers(2, 5))
            sentences += [" ".join(words) + f" s{k}" for k in range(n)]
            if t == 1:
                sentences[-1] += f" answer{doc}"
                questions.append((doc, doc, f"answer{doc}", " ".join(words)))
        docs.append((doc, sentences))
    vec = lambda c: P.hashed_vector(c, 32)
    frame = spark.createDataFrame(docs, "doc_id long, sentences array<string>")
    frame = settled(frame.withColumn("vecs", F.transform("sentences", vec)))
    asked = settled(spark.createDataFrame(questions, "qid long, doc_id long, answer string, text string").withColumn("vec", vec(F.col("text"))).drop("text"))
    texts = F.transform(fixed_chunks(F.col("sentences"), 3), lambda c: F.array_join(c, " "))
    chunks = frame.select("doc_id", F.posexplode(texts).alias("at", "text")).withColumn("vec", vec(F.col("text")))
    return frame, asked, settled(chunks.withColumn("chunk_id", F.col("doc_id") * 1000 + F.col("at"))), vec


def brute_rewards(asked, chunks, cut, vec, depth, spark):
    new = spark.createDataFrame([(d, i, t) for d, texts in cut.items() for i, t in enumerate(texts)], "doc_id long, at int, text string").withColumn("vec", vec(F.col("text"))).collect()
    base = [r for r in chunks.collect() if r.doc_id not in cut]
    out = {}
    for q in asked.collect():
        if q.doc_id in cut:
            scored = [(-round(float(np.dot(q.vec, r.vec)), 9), 0, r.chunk_id, False) for r in base]
            scored += [(-round(float(np.dot(q.vec, r.vec)), 9), 1, (r.doc_id, r.at), r.doc_id == q.doc_id and q.answer in r.text.lower()) for r in new]
            ranks = [k for k, x in enumerate(sorted(scored, key=lambda x: x[:2] + (str(x[2]).zfill(30),))[:depth], 1) if x[3]]
            out.setdefault(q.doc_id, []).append(1 / ranks[0] if ranks else 0.0)
    return {d: sum(v) / len(v) for d, v in out.items()}


@pytest.mark.parametrize("spare", [0, 20])
def test_rewards_over_frozen_lists_equal_a_full_search(spark, world, spare):
    """Without spare entries lists run short, and are searched again."""
    frame, asked, chunks, vec = world
    corpus = chunk_policy.freeze(chunks, asked, depth=5, spare=spare)
    cut = {r.doc_id: [" ".join(r.sentences[:4]), " ".join(r.sentences[4:])] for r in frame.where("doc_id % 3 = 0").collect()}
    got = chunk_policy.rewards(corpus, spark.createDataFrame(list(cut.items()), "doc_id long, chunks array<string>"), vec)
    got = {r.doc_id: r.reward for r in got.collect()}
    want = brute_rewards(asked, chunks, cut, vec, 5, spark)
    assert got.keys() == want.keys() and all(np.isclose(got[d], want[d]) for d in want)


def test_chunker_learns_from_rewards(world):
    frame, asked, chunks, vec = world
    corpus = chunk_policy.freeze(chunks, asked, depth=10, spare=10)
    model = SequenceModel(32, 4)
    start = model.start(8)
    state = chunk_policy.train_chunker(frame, corpus, vec, model, start, steps=2, rate=0.05, target=3)
    assert len(state.log) == 2 and not np.array_equal(state.weights, start)
    assert all(0 <= r["reward_greedy"] <= 1 and 0 < r["entropy"] < np.log(9) for r in state.log)
    assert any(r["advantage"] for r in state.log)
    again = chunk_policy.train_chunker(frame, corpus, vec, model, start, steps=2, rate=0.05, target=3)
    assert np.array_equal(again.weights, state.weights)
    texts = {r.doc_id: r.chunks for r in chunk_policy.policy_chunks(frame, model, state.weights, 3).collect()}
    assert all(" ".join(texts[r.doc_id]) == " ".join(r.sentences) for r in frame.collect())
