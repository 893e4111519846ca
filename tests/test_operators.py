"""The engine's operators against plain Python, and its edge cases."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from passagelens.functions import text as T
from passagelens.operators import chunking as C
from passagelens.operators import metrics as M
from passagelens.operators import retrieval as R
from passagelens.operators import tables as B
from passagelens.operators import verdicts as V
from passagelens.operators import windows as W
from passagelens.sources import readers as S
from passagelens.sources import writers as K


def plain_fixed(s, size, overlap):
    size, step = max(1, size), max(1, size) - min(max(0, overlap), max(1, size) - 1)
    out = [s[i : i + size] for i in range(0, len(s), step)]
    return out[:-1] if size - step > 0 and len(out) > 1 and len(out[-1]) <= size - step else out


def plain_threshold(p, n, t, least, most, overlap):
    overlap, start, out = min(max(0, overlap), most - 1), 0, []
    for i in range(n - 1):
        size = i - start + 1
        if (p[i] >= t and size >= least) or size >= most:
            out.append((start, i + 1))
            start = i + 1 - overlap
    if n > start:
        out.append((start, n))
    if overlap > 0 and len(out) > 1 and out[-1][1] - out[-1][0] <= overlap:
        out.pop()
    return out


def plain_target(p, n, target, least, most, overlap):
    target, overlap, start, out = min(max(target, least), most), min(max(0, overlap), least - 1), 0, []
    while start < n:
        if n - start <= most:
            out.append((start, n))
            break
        k = max(range(least, most + 1), key=lambda k: (p[start + k - 1], -abs(k - target), -k))
        out.append((start, start + k))
        start += k - overlap
    return out


@pytest.mark.parametrize("size,overlap", [(10, 1), (6, 5), (3, 9), (1, 0), (4, 2)])
def test_fixed_chunks(spark, size, overlap):
    rows = [(n, [f"s{i}" for i in range(n)]) for n in range(25)]
    df = spark.createDataFrame(rows, "n int, s array<string>")
    for r in df.select("n", C.fixed_chunks(F.col("s"), size, overlap).alias("c")).collect():
        assert r.c == plain_fixed(rows[r.n][1], size, overlap)


def test_policies(spark):
    rng = random.Random(3)
    rows = [(i, n := rng.randint(0, 40), [rng.choice([0.1, 0.5, 0.8, 0.9]) for _ in range(max(n - 1, 0))]) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, n int, p array<double>")
    for least, most, overlap in ((2, 6, 1), (1, 4, 3), (3, 9, 0)):
        got = df.select("i", C.threshold_spans(F.col("p"), F.col("n"), 0.8, least, most, overlap).alias("t"), C.target_spans(F.col("p"), F.col("n"), 5, least, most, overlap).alias("g")).collect()
        for r in got:
            _, n, p = rows[r.i]
            assert [tuple(x) for x in r.t] == plain_threshold(p, n, 0.8, least, most, overlap)
            assert [tuple(x) for x in r.g] == plain_target(p, n, 5, least, most, overlap)
    with pytest.raises(ValueError):
        C.chunks_from_probs("other", F.col("p"), F.col("n"))


def test_flags_to_chunks(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [True, False, True]), ([], [])], "s array<string>, f array<boolean>")
    assert [r.c for r in df.select(C.boundaries_to_chunks(F.col("s"), F.col("f")).alias("c")).collect()] == [[["a"], ["b", "c"]], []]


def test_sentences(spark):
    texts = ["Dr. Smith met J. S. Bach. They talked!  Then left.", "One only", "", "He said \"Stop.\" Then ran. Über alles."]
    got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.sentences(F.col("t")).alias("s")).collect()]
    assert got == [["Dr. Smith met J. S. Bach.", "They talked!", "Then left."], ["One only"], [], ['He said "Stop."', "Then ran.", "Über alles."]]


def test_answers(spark):
    rows = [("The cat sat.", "cat"), ("a  the", ""), ("", "x"), ("red red blue", "red blue blue"), ("<think>x\ny</think>\nParis\nmore", "paris")]
    df = spark.createDataFrame(rows, "p string, a string")
    got = df.select(T.contains_answer(F.col("p"), F.col("a")), T.token_f1(F.col("p"), F.col("a")), T.exact_match(T.prediction_from_output(F.col("p")), F.col("a"))).collect()
    third = pytest.approx(2 / 3)
    assert [tuple(r) for r in got] == [(True, third, False), (False, 0.0, True), (False, 0.0, False), (False, third, False), (True, pytest.approx(0.4), True)]


def test_bm25_pads_and_repeats(spark):
    chunks = spark.createDataFrame([(1, "red fox"), (2, "red red"), (3, "dog"), (4, None)], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "red red fox"), (2, "zebra"), (3, "")], "qid long, text string")
    got = {(r.qid, r.rank): r for r in R.bm25_top_k(chunks, queries, 3).collect()}
    assert [got[1, k].chunk_id for k in (1, 2, 3)] == [1, 2, 3] and got[1, 3].score == 0
    assert [got[2, k].chunk_id for k in (1, 2, 3)] == [1, 2, 3] and got[2, 1].score == 0
    assert len(got) == 9


def test_dense_blocks_agree(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.random() for _ in range(8)]) for i in range(60)]
    v = spark.createDataFrame(rows, "chunk_id long, vec array<double>")
    q = v.where("chunk_id % 7 = 0").withColumnRenamed("chunk_id", "qid")
    one = sorted(map(tuple, R.dense_top_k(v, q, 4).collect()))
    for name, value in (("QUERIES", 3), ("BLOCK", 2), ("ROWS", 7)):
        monkeypatch.setattr(R, name, value)
    many = sorted(map(tuple, R.dense_top_k(v.repartition(3), q, 4).collect()))
    assert one == many and len(one) == 36
    for qid, rank, chunk, _ in one:
        best = sorted(range(60), key=lambda i: (-round(sum(a * b for a, b in zip(rows[qid][1], rows[i][1])), 9), i))
        assert best[rank - 1] == chunk
    assert R.dense_top_k(v, q.limit(0), 4).count() == 0


def test_fusion_ties(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid long, chunk_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 10, 2), (1, 12, 3)], "qid long, chunk_id long, rank int")
    assert [r.chunk_id for r in R.rrf_fuse([a, b], 3).orderBy("rank").collect()] == [10, 11, 12]


def test_recall_counts_missing_questions(spark):
    questions = spark.createDataFrame([(1,), (2,)], "qid long")
    hits = spark.createDataFrame([(1, 1, False, True), (1, 2, True, True)], "qid long, rank int, in_gold boolean, holds_answer boolean")
    got = {r.k: (r.recall, r.recall_unconstrained) for r in M.recall_at_k(questions, hits, [1, 5]).collect()}
    assert got == {1: (0.0, 0.5), 5: (0.5, 0.5)}


def test_threshold_is_single_precision(spark):
    scores = spark.createDataFrame([(0.8, 1), (0.81, 1), (0.1, 0)], "p double, label int")
    row = M.threshold_sweep(scores).where("abs(threshold - 0.8) < 1e-9").first()
    assert (row.tp, row.fp, row.fn) == (1, 0, 1)


def test_interval_needs_two(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("b", 1.0)], "k string, d double")
    got = {r.k: r for r in M.mean_ci(df, "d", ["k"]).collect()}
    assert got["a"].low is None and got["b"].low == pytest.approx(0.5 - 1.96 * math.sqrt(0.5 / 2))


def test_windows(spark):
    rows = spark.createDataFrame(list(enumerate("aabacbdca")), "at long, doc string")
    assert sorted(r["at"] for r in W.first_documents(rows, "doc", "at", 2).collect()) == [0, 1, 2]
    got = sorted((r["at"], r.window) for r in W.consecutive_windows(rows, "doc", "at", [1, 1]).collect())
    assert got == [(0, 1), (1, 1), (2, 2), (3, 1)]
    numbers = {r.doc: r.doc_no for r in W.document_numbers(rows, "doc", "at").collect()}
    assert numbers == {"a": 1, "b": 2, "c": 3, "d": 4}
    assert W.document_numbers(rows.limit(0), "doc", "at").count() == 0


def test_mining_skips_second_hits(spark):
    pool = spark.createDataFrame([(1, r, 100 + r, r in (2, 4)) for r in range(1, 11)] + [(2, 1, 1, True)], "qid long, rank int, chunk_id long, hit boolean")
    (g,) = R.hard_negatives(pool).collect()
    assert (g.pos, g.negs) == (102, [101, 103, 105, 106, 107, 108, 109])


def test_nearest_and_reproduction(spark):
    left = spark.createDataFrame([(1, 5.0)], "ov int, size double")
    right = spark.createDataFrame([(1, 4.0, 2), (1, 6.0, 1), (2, 5.0, 0)], "ov int, size double, place int")
    assert B.nearest_match(left, right, ["ov"], "size", "place").first()["match"].place == 1
    new = spark.createDataFrame([("a", 0.5), ("b", 0.504), ("c", 0.6), ("d", 0.1)], "k string, v double")
    old = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.5)], "k string, v double")
    assert [r.status for r in B.reproduction(new, old, ["k"], ["v"]).orderBy("k").collect()] == ["OK exact", "OK within one question", "FAILED", "UNMATCHED"]


def test_verdict_order(spark):
    one = spark.createDataFrame([(0.001, 0.0005, 0.002)], "m double, lo double, hi double")
    m, lo, hi = F.col("m"), F.col("lo"), F.col("hi")
    row = one.select(V.comparison(m, lo, hi, 0.01, "B", "W").alias("a"), V.confirmation(m, lo, hi, F.lit(10), 0.01, 5).alias("b"), V.placement(-lo, hi, -lo, hi).alias("c"), V.gate(F.lit(None).cast("double")).alias("d")).first()
    assert tuple(row) == ("TIE", "BELOW-FLOOR", "EQUIVALENT", "n/a")


def test_checkpoints_and_incremental(spark, tmp_path):
    path = str(tmp_path / "ck")
    spark.createDataFrame([('{"meta": {"n": "1"}}',), ('{"rows": [{"k": 1}, {"k": 2}]}',), ('{"rows": [{"k"',)], "value string").coalesce(1).write.text(path)
    K.append_checkpoint(spark, spark.createDataFrame([(3,)], "k int"), path)
    assert sorted(r.k for r in S.checkpoint_rows(spark, path, "k int", {"n": "1"}).collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        S.checkpoint_rows(spark, path, "k int", {"n": "2"})
    table = str(tmp_path / "t")
    make = lambda d: d.withColumn("v", F.col("k") * 2)
    K.materialise_missing(spark.createDataFrame([(1,), (2,)], "k int"), ["k"], table, make)
    assert K.materialise_missing(spark.createDataFrame([(2,), (3,)], "k int"), ["k"], table, make).count() == 3


def test_stream_chunks(spark, tmp_path):
    from passagelens.streaming.incremental import chunk_stream

    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "This is the first long sentence. This is the second long sentence.")], "doc_id long, text string").write.parquet(source)
    stream = spark.readStream.schema("doc_id long, text string").parquet(source)
    chunk_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), size=1, overlap=0).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_entry():
    import __spark_entry__ as e

    names = e.queries()
    assert len(names) > 50 and set(e.oracle_sql()) <= set(names)


def test_boundary_model(spark):
    from passagelens.operators import boundary

    rng = random.Random(6)
    rows = []
    for doc in range(60):
        side = 1.0
        for pos in range(8):
            if pos and rng.random() < 0.3:
                side = -side
            rows.append((doc, pos, [side + rng.gauss(0, 0.1), rng.random()], side))
    df = spark.createDataFrame(rows, "doc_id int, pos int, vec array<double>, side double")
    nxt = F.lead("side").over(Window.partitionBy("doc_id").orderBy("pos"))
    labels = df.select("doc_id", "pos", (nxt != F.col("side")).cast("int").alias("label"))
    pairs = boundary.neighbours(df.drop("side")).join(labels, ["doc_id", "pos"])
    assert pairs.count() == 60 * 7
    out = boundary.probabilities(boundary.fit(pairs.where("doc_id < 40")), pairs.where("doc_id >= 40")).collect()
    assert sum((r.p > 0.5) == (r.label == 1) for r in out) / len(out) > 0.95


def test_stand_ins(spark):
    from passagelens.functions import providers as P

    df = spark.createDataFrame([(1, ["red fox runs", "red fox runs", "!!", ""]), (2, []), (3, ["one"])], "i int, s array<string>")
    got = {r.i: r.p for r in df.select("i", P.boundary_probs(F.col("s")).alias("p")).collect()}
    assert got == {1: [0.0, 1.0, 1.0], 2: [], 3: []}
    texts = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "")], "k int, text string")
    vecs = {r.k: r.vec for r in P.encoded(texts, "text", P.hashed_vector).collect()}
    assert vecs[1] == vecs[2] and sum(x * x for x in vecs[1]) == pytest.approx(1) and not any(vecs[3])


def test_sampling_follows_probabilities(spark):
    """Draws over many seeds come near the softmax of the window's logits; the same seed draws the same."""
    p = [0.5, 0.5, 0.9, 0.5, 0.5, 0.5, 0.5, 0.5]
    df = spark.range(4000).select("id", C.sampled_spans(F.array(*map(F.lit, p)), F.lit(9), 3, 2, 4, 0, F.col("id")).alias("x"))
    first = df.select(F.col("x")[0]["b"].alias("b"), F.col("id"))
    shares = {r.b: r["count"] / 4000 for r in first.groupBy("b").count().collect()}
    odds = {k: p[k - 1] / (1 - p[k - 1]) for k in (2, 3, 4)}
    assert all(abs(shares[k] - odds[k] / sum(odds.values())) < 0.03 for k in odds)
    assert sorted(map(tuple, first.limit(50).collect())) == sorted(map(tuple, first.limit(50).collect()))


def test_pages_that_hold_short_answers(spark, monkeypatch):
    monkeypatch.setattr(R, "ANSWERS", 3)
    pages = [(1, "the capital of france is paris, since long ago"), (2, "parisian life"), (3, "by the river seine in the town of paris"), (4, ""), (5, None), (6, "nothing of the kind is here at all today")]
    asked = ["paris", "of paris", "france is paris", "e river seine in t", "the capital of france is paris", "is here at all tod", "kind is here at all today", "of the kind is here at all to", "rome", "is life", "the town of rome", "paris", "", None]
    answers = spark.createDataFrame(list(enumerate(asked)), "qid long, answer string")
    got = [tuple(r) for r in R.containing_documents(spark.createDataFrame(pages, "doc_id long, page string"), answers).collect()]
    want = [(q, d) for q, a in enumerate(asked) for d, p in pages if a and p is not None and a in p]
    assert sorted(got) == sorted(want)
