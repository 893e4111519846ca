"""Text functions, readers, writers and study operators against golden cases and plain Python."""

import hashlib
import random
import threading

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from passagelens.functions import text as T
from passagelens.operators import chunking as C
from passagelens.operators import metrics as M
from passagelens.operators import retrieval as R
from passagelens.operators import tables as B
from passagelens.operators import verdicts as V
from passagelens.operators import windows as W
from passagelens.sources import readers as S
from passagelens.sources import scratch, versions
from passagelens.sources import writers as K

#: Golden cases of the sentence splitter, a text and its sentences.
SENTENCES = [
    ("", []),
    (" ", []),
    ("\n\r\n", []),
    ("Dr. Smith arrived at 3.14 p.m. He left later.", ["Dr. Smith arrived at 3.14 p.m.", "He left later."]),
    ("J. S. Bach composed music. Mr. Jones listened.", ["J. S. Bach composed music.", "Mr. Jones listened."]),
    ("The U.S. team won. They celebrated.", ["The U.S. team won.", "They celebrated."]),
    ('He said, "Go now." Then he left. (She stayed.) Is that so?', ['He said, "Go now."', "Then he left.", "(She stayed.)", "Is that so?"]),
    ("One... two? Three!\n\nFour. Five.", ["One... two?", "Three!", "Four.", "Five."]),
    ("First paragraph.\r\n\r\nSecond paragraph.", ["First paragraph.", "Second paragraph."]),
    ("No terminal punctuation", ["No terminal punctuation"]),
    ("Café — déjà vu. Another sentence.", ["Café — déjà vu.", "Another sentence."]),
    ("The price is $1.99. The total is $12.00.", ["The price is $1.99.", "The total is $12.00."]),
    ("Hello?! Really!!! Yes...", ["Hello?!", "Really!!!", "Yes..."]),
    ("\nAlpha beta.\n  Gamma delta.\n", ["\nAlpha beta.", "Gamma delta."]),
    ("你好。世界！ English text. More text.", ["你好。世界！ English text.", "More text."]),
]


def values(spark, column, *args):
    """column(args) for one row of strings."""
    row = spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args))))
    return row.select(column(*[F.col(f"c{i}") for i in range(len(args))]).alias("x")).first().x


def test_golden_sentences(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SENTENCES)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", T.sentences(F.col("t")).alias("s")).collect()}
    assert [got[i] for i in range(len(SENTENCES))] == [s for _, s in SENTENCES]


def test_marks_leave_blanks(spark):
    assert values(spark, T.clean_text, "A fact[1]about\n\n | a | table |\n  lines.") == "A fact about lines."
    assert values(spark, T.strip_refs_and_comments, "a<ref name=x>y\nz</ref>b<REF/>c<!-- d\n -->e") == "a b c e"


def test_slugs(spark):
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()[:8]
    assert values(spark, T.slug, "(Some) Title!") == "Some_Title_" + digest("(Some) Title!")
    assert values(spark, T.slug, "日本") == digest("日本") and len(values(spark, T.slug, "x" * 90)) == 69
    assert [values(spark, T.model_slug, t) for t in ("BAAI/bge-small.en--v1.5", "Ünï", "//")] == ["baai-bge-small-en-v1-5", "ünï", "model"]


@pytest.mark.parametrize(
    "text,answer,want",
    [
        ("a big & cat", "Big & cat", "a <mark>big &amp; cat</mark>"),
        ("the  blue\nsky (x)", "blue sky", "the  <mark>blue\nsky</mark> (x)"),
        ("it's \"so\" <b>", "IT'S", "<mark>it&#x27;s</mark> &quot;so&quot; &lt;b&gt;"),
        ("1+1 (a.c) abc", "(a.c)", "1+1 <mark>(a.c)</mark> abc"),
        ("plain & simple", "", "plain &amp; simple"),
    ],
)
def test_highlight(spark, text, answer, want):
    assert values(spark, T.highlighted, text, answer) == want


def test_answer_scoring_cases(spark):
    for text, want in (("An  Oak,  the (old) tree", "oak old tree"), ("the a an", ""), ("It's 3-4", "its 34"), ("Theatre", "theatre")):
        assert values(spark, T.normalize_answer, text) == want
    for text, want in (("<think>maybe 7\n\n8</think>\n\n nine \nten", "nine"), ("<think>all</think>", ""), (" one two ", "one two")):
        assert values(spark, T.prediction_from_output, text) == want
    cases = [("Built of oak; it stood", "the oak", True), ("an oaken door", "oak", False), ("12.5 metres", "12.5", True), ("112.5 metres", "12.5", False), ("something", "...", False), ("", "oak", False)]
    assert all(values(spark, T.contains_answer, p, a) == want for p, a, want in cases)
    assert values(spark, T.exact_match, "A tall Oak!", "tall oak") and not values(spark, T.exact_match, "oaks", "oak") and values(spark, T.token_f1, "oak", "") == 0
    assert values(spark, T.token_f1, "oak oak elm", "oak elm ash elm") == pytest.approx(4 / 7)


def test_prompts(spark):
    passages = F.array(*[F.struct(F.lit(t).alias("title"), F.lit(x).alias("text")) for t, x in (("Trees", "oaks grow very slowly"), ("Rivers", "water flows"), ("Hills", "steep"))])
    none = F.lit(None).cast("array<struct<title:string,text:string>>")
    ask = F.lit("how do oaks grow")
    seen = lambda a, g: T.answer_in_prompt(passages, F.lit(a), F.array(*map(F.lit, g)))
    row = spark.range(1).select(T.built_prompt(ask, passages, 2).alias("p"), T.prompt(ask, none).alias("closed"), T.built_prompt(ask, none, 2).alias("none"), seen("VERY  slowly", ["Hills", "Trees"]).alias("x"), seen("very slowly", ["Rivers"]).alias("y"), T.answer_in_prompt(none, F.lit("water"), F.array(F.lit("Rivers"))).alias("z")).first()
    with_, closed = row.p.text.split("\n\n"), row.closed.split("\n\n")
    assert with_[1:] == ["[1] Trees\noaks grow", "[2] Rivers\nwater flows", "[3] Hills\nsteep", "Question: how do oaks grow"] and "passages below" in with_[0] and row.p.n_cut == 1
    assert closed[1:] == ["Question: how do oaks grow"] and "passages" not in closed[0]
    assert row.none.n_cut == 0 and (row.x, row.y, row.z) == (True, False, None)
    assert [tuple(values(spark, lambda t: T.cut_passage(t, 2), t)) for t in ("", "one", "one two", "one two three")] == [("", False), ("one", False), ("one two", False), ("one two", True)]


def test_queries_are_checked(spark):
    most = 2000
    assert [values(spark, T.checked_query, t) for t in ("\n oak \t", "", None, "é" * most, "a" + " " * (most - 2) + "b")] == ["oak", "", "", "é" * most, "a" + " " * (most - 2) + "b"]
    for text in ("é" * (most + 1), "a " * most):
        with pytest.raises(PySparkException, match=str(most)):
            values(spark, T.checked_query, text)


def test_standard_errors(spark):
    got = spark.range(1).select(M.one_se(F.lit(0.2), F.lit(16)).alias("one"), M.two_se(F.lit(0.2), F.lit(16)).alias("two")).first()
    assert got.one == pytest.approx(0.1) and got.two == pytest.approx(0.2)


def test_numbers_in_files(spark):
    df = spark.createDataFrame([(0.12345,), (None,), (float("nan"),), (2.0,)], "v double")
    assert [r.x for r in df.select(T.fixed_number(F.col("v"), 4).alias("x")).collect()][3] == "2.0000"
    assert [r.x for r in df.select(T.fixed_number(F.col("v"), 3).alias("x")).collect()][1:] == ["", "", "2.000"]


# Readers and writers.
def lines(spark, path, *texts):
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("append").text(path)


def test_corpora_are_read_with_schemas(spark, tmp_path):
    path = str(tmp_path / "docs")
    lines(spark, path, '{"id": "d1", "title": null, "sentences": ["a", "b"]}', '{"id": "d2", "title": "T", "sentences": ["a"]}', "{broken", '{"id": "d3"}', '{"id": "d4", "title": "U", "sentences": ["a", "b", "c"]}')
    assert {r.id: r.title for r in S.read_docs(spark, path).collect()} == {"d1": "d1", "d4": "U"}
    path = str(tmp_path / "questions")
    lines(spark, path, '{"question": "q", "answer": "a", "doc_title": "T"}', '{"question": "r", "answer": "b", "doc_title": "T", "doc_titles": ["U", "V"]}', '{"question": "s", "answer": "c", "doc_title": "W", "doc_titles": []}', '{"question": "t"}')
    assert {r.question: r.gold for r in S.read_questions(spark, path).collect()} == {"q": ["T"], "r": ["U", "V"], "s": ["W"]}
    assert S.read_docs(spark, str(tmp_path / "none")).count() == 0 and S.read_questions(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "train.jsonl").write_text('{"id": "1", "sentences": ["a", "b"], "labels": [1]}\n')
    (tmp_path / "val.jsonl").write_text('{"id": "2", "sentences": ["a", "b"], "labels": [0]}\n')
    both = S.read_boundaries(spark, [str(tmp_path / f"{s}.jsonl") for s in ("train", "val")])
    assert sorted((r.split, r.id) for r in both.collect()) == [("train", "1"), ("val", "2")]
    pages = spark.range(1).select(S.entity_pages(F.array(*map(F.lit, ["A", "", "C"])), F.array(*map(F.lit, ["x", "y", ""]))).alias("p")).first().p
    assert [tuple(p) for p in pages] == [("A", "x")]


def test_torn_lines(spark, tmp_path):
    good, torn = str(tmp_path / "good"), str(tmp_path / "torn")
    lines(spark, good, '{"qid": 1}', '{"qid": 2}', '{"qid": 3, "te')
    lines(spark, good, '{"qid": 4}')
    lines(spark, torn, '{"qid": 1}', '{"qid', '{"qid": 3}')
    assert sorted(r.qid for r in S.read_rows(spark, good, "qid int").collect()) == [1, 2, 4]
    with pytest.raises(PySparkException, match="unreadable"):
        S.read_rows(spark, torn, "qid int").collect()


def test_results_and_indices(spark, tmp_path):
    rows = spark.createDataFrame([("bge", 6, None, 0, None, 0.5), ("bge", None, 10, None, 1, None), ("bm25", 6, None, 0, None, 0.1)], "arm string, fixed_size int, semantic_target_size int, fixed_overlap int, semantic_overlap int, recall double")
    K.write_csv(rows, str(tmp_path / "csv"))
    back = S.read_results(spark, str(tmp_path / "csv"), rows.schema)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, rows.collect()))
    assert sorted((r["size"], r["overlap"]) for r in S.grid_rows(back, "bge", 2).collect()) == [(6, 0), (10, 1)]
    with pytest.raises(ValueError):
        S.grid_rows(back, "bge", 30)
    K.write_jsonl(rows.select("arm"), str(tmp_path / "json"))
    K.write_jsonl(rows.select("arm"), str(tmp_path / "json"), append=True)
    assert spark.read.json(str(tmp_path / "json")).count() == 6
    index = str(tmp_path / "index")
    assert not S.index_exists(spark, index)
    K.save_index(spark.createDataFrame([(1, "a", [0.5]), (2, "b", [0.1])], "chunk_id long, doc_id string, vec array<double>"), index)
    assert S.index_exists(spark, index) and S.load_index(spark, index).count() == 2 and S.load_index(spark, index, ["b"]).first().chunk_id == 2


def test_contexts_and_replaced_tables(spark, tmp_path):
    path = str(tmp_path / "contexts")
    lines(spark, path, '{"meta": {"n": "2"}}', '{"arm": "a", "contexts": [[{"doc_id": "d", "text": "t"}], []]}', '{"arm": "b", "contexts": [[], []]}')
    meta, rows = S.read_contexts(spark, path, "struct<doc_id:string,text:string>", ["a", "b"], 2)
    assert meta == {"n": "2"} and {r.arm: len(r.contexts[0]) for r in rows.collect()} == {"a": 1, "b": 0}
    for arms, n in ((["a", "b"], 3), (["a", "c"], 2)):
        with pytest.raises(ValueError):
            S.read_contexts(spark, path, "struct<doc_id:string,text:string>", arms, n)
    table = str(tmp_path / "table")
    versions.commit(spark.range(3), table)
    versions.commit(versions.current(spark, table).where("id > 0"), table)  # made from what it replaces
    assert sorted(r.id for r in versions.current(spark, table).collect()) == [1, 2]
    K.write_results(spark.createDataFrame([("x", 0.123456, 6.5, None)], "name string, recall double, avg_size double, other double"), str(tmp_path / "res"), ["recall", "name", "avg_size", "other"], {"avg_size": 3})
    assert spark.read.text(str(tmp_path / "res")).collect()[1].value == '0.1235,x,6.500,""' or spark.read.csv(str(tmp_path / "res"), header=True).first().asDict() == {"recall": "0.1235", "name": "x", "avg_size": "6.500", "other": None}
    K.write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "json1"))
    assert spark.read.text(str(tmp_path / "json1")).first().value == '{"a":1,"b":null}'


def test_sampled_rankings(spark):
    """The first place over many draws follows the softmax; draws repeat."""
    df = spark.range(3000).select(M.sampled_ranking(F.array(*[F.lit(x) for x in (1.0, 0.0, 2.0)]), F.col("id")).alias("o"))
    first = [r.o[0] for r in df.collect()]
    weights = np.exp([1.0, 0.0, 2.0])
    assert all(abs(first.count(i) / 3000 - weights[i] / weights.sum()) < 0.03 for i in range(3)) and first == [r.o[0] for r in df.collect()]


def test_settled_tables_are_discarded(spark):
    since, before = scratch.mark(), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    table = scratch.settled(spark.range(10))
    assert table.count() == 10 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    others = []
    thread = threading.Thread(target=lambda: others.append(scratch.settled(spark.range(5))))
    thread.start()
    thread.join()
    scratch.discard(spark, since)
    assert scratch.mark() == since and not S.index_exists(spark, table.inputFiles()[0]) and others[0].count() == 5
    with pytest.raises(RuntimeError), scratch.cleared(spark):
        table = scratch.settled(spark.range(3))
        raise RuntimeError
    assert scratch.mark() == since and not S.index_exists(spark, table.inputFiles()[0])


# Study operators.
def test_least_squares_with_dummies(spark):
    rng = np.random.default_rng(3)
    kinds = rng.choice(["a", "b", "c"], 60)
    size, overlap = rng.integers(4, 16, 60), rng.integers(0, 2, 60)
    y = 0.5 + 0.02 * size - 0.01 * overlap + 0.1 * (kinds == "b") + rng.normal(0, 0.05, 60)
    df = spark.createDataFrame([(float(a), int(b), int(c), str(k)) for a, b, c, k in zip(y, size, overlap, kinds)], "y double, size int, overlap int, method string")
    got = B.least_squares(df, "y", {"size": F.col("size"), "overlap": F.col("overlap")} | B.dummies("method", ["b", "c"])).collect()
    x = np.column_stack([np.ones(60), size, overlap, kinds == "b", kinds == "c"]).astype(float)
    beta, rest, *_ = np.linalg.lstsq(x, y, rcond=None)
    se = np.sqrt(rest[0] / 55 * np.diag(np.linalg.inv(x.T @ x)))
    assert [r.term for r in got] == ["intercept", "size", "overlap", "method[b]", "method[c]"] and got[0].dof == 55
    assert np.allclose([r.coef for r in got], beta) and np.allclose([r.se for r in got], se) and np.allclose([r.t for r in got], beta / se)
    assert got[0].r2 == pytest.approx(1 - rest[0] / ((y - y.mean()) ** 2).sum()) and all(r.low < r.coef < r.high for r in got)
    for t, dof, p in ((2.0, 10, 0.0733880), (0.0, 5, 1.0), (2.5706, 5, 0.05), (12.7062, 1, 0.05), (1.96, 100000, 0.04999836)):
        assert B._two_sided(t, dof) == pytest.approx(p, rel=2e-4)


def test_verdicts_with_conditions(spark):
    def judged(rule, *args):
        return spark.range(1).select(rule(*[F.lit(a).cast("double") if not isinstance(a, bool) else F.lit(a) for a in args])).first()[0]

    assert [judged(V.against_baseline, d, s) for d, s in ((0.05, 0.1), (0.01, 0.1), (-0.1, 0.1), (0.05, 0.5), (0.05, None), (None, 0.1))] == ["OVERTURNS", "DIRECTIONAL", "NULL", "INVALID", "INCOMPLETE", "INCOMPLETE"]
    assert [judged(V.ceiling, m, h, s) for m, h, s in ((0.01, 0.02, 0), (0.01, 0.06, 0), (0.06, 0.1, -0.5), (0.06, 0.1, 0.2))] == ["CLOSED", "INCONCLUSIVE", "SIZE-CONFOUNDED", "HEADROOM"]
    assert [judged(V.dev_gate, m, live) for m, live in ((0.1, 0.01), (0.0, 0.5), (-0.1, 0.5))] == ["NO-GO", "GO", "NO-GO"]
    optimised = lambda *a: V.optimised(*a, floor=0.01, least_groups=10)
    assert [judged(optimised, m, lo, hi, ok, live, n) for m, lo, hi, ok, live, n in ((0.1, 0.05, 0.2, False, 1, 99), (0.1, 0.05, 0.2, True, 0.01, 99), (0.1, 0.05, 0.2, True, 1, 5), (0.1, 0.05, 0.2, True, 1, 99), (-0.1, -0.2, -0.05, True, 1, 99), (0.001, 0.0005, 0.002, True, 1, 99))] == ["INVALID", "FAILED-OPTIMISATION", "INCONCLUSIVE-BUDGET", "RL-BETTER", "CE-BETTER", "TIE"]


def test_calibration(spark):
    rng = random.Random(4)
    rows = [("val" if i % 2 else "test", (p := rng.random()), int(p > 0.6)) for i in range(400)]
    got = {(r.split, r.kind): r for r in M.calibrated(spark.createDataFrame(rows, "split string, p double, label int")).collect()}
    assert abs(got["val", "calibrated"].threshold - 0.6) < 0.02 and got["val", "calibrated"].f1 > got["val", "fixed"].f1 and got["test", "fixed"].threshold == 0.8
    flat = M.calibrated(spark.createDataFrame([(s, p, 0) for s, p, _ in rows], "split string, p double, label int")).collect()
    assert {r.threshold for r in flat if r.kind == "calibrated"} == {0.5} and {r.f1 for r in flat} == {0.0}


def test_windows_of_usable_rows(spark):
    rows = spark.createDataFrame([(0, "a", "x", ["s"]), (1, "b", " ", ["s", "t"]), (2, "b", "x", ["s", "t"]), (3, "c", "x", ["s", "t"]), (4, "b", "y", ["s", "t"]), (5, "d", "x", ["s", "t"])], "n long, title string, answer string, sentences array<string>")
    usable = W.usable_rows(rows, "answer", "sentences")
    assert sorted(r.n for r in W.first_documents(usable, "title", "n", 2).collect()) == [2, 3]
    assert sorted((r.n, r.window) for r in W.consecutive_windows(usable, "title", "n", [1, 1]).collect()) == [(2, 1), (3, 2), (4, 1)]
    assert [r.n for r in W.rows_after(rows, "n", 4).collect()] == [4, 5] and W.rows_after(rows, "n", 0).count() == 6
    skip = spark.createDataFrame([("c",)], "title string"), spark.createDataFrame([("y",)], "answer string")
    kept, stats = W.holdout(usable, "title", "answer", "n", 2, *skip)
    assert sorted(r.n for r in kept.collect()) == [2, 5] and tuple(stats.first()) == (4, 1, 1)
    split = [r.split for r in W.cut_split(spark.range(25), "id").collect()]
    assert (split.count("train"), split.count("val"), split.count("test")) == (20, 2, 3)


def test_grid_and_choices(spark):
    grid = C.config_grid([6, 8, 10, 12, 15], [0, 1], C.METHODS)
    assert len(grid) == 30 and grid[0] == (0, "fixed", 6, 0, 2, 10) and grid[5][1] == "bilstm" and grid[15][3] == 1
    assert C.selected_configs([("fixed", 6, 0), ("bilstm", 15, 1)], grid) == [("fixed", 6, 0), ("bilstm", "target", 15, 11, 19, 1)]
    with pytest.raises(ValueError):
        C.selected_configs([("fixed", 7, 0)], grid)
    row = spark.range(1).select(C.threshold_spans(F.array(*[F.lit(0.0)] * 9), F.lit(10), 0.5, 4, 2).alias("t"), C.target_spans(F.array(*[F.lit(0.5)] * 9), F.lit(10), 3, 2, 4).alias("g")).first()
    assert [tuple(x) for x in row.t] == [(0, 4), (4, 8), (8, 10)]  # at most what is least
    told = spark.range(1).select(C.choices(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in map(tuple, row.g)]), F.lit(10), 2, 4).alias("c")).first().c
    assert [tuple(x) for x in told] == [(a + 1, min(a + 3, 8), b - 1) for a, b in map(tuple, row.g) if b < 10]


def test_merged_lists_and_gold(spark):
    base = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.5), (2, 0, 0.9)], "qid long, pos long, score double")
    new = spark.createDataFrame([(1, 0, 0.9, False), (1, 1, 0.5, True), (2, 0, 0.1, False)], "qid long, pos long, score double, hit boolean")
    assert {r.qid: r.first_rank for r in R.merged_first_hit(base, new, 10).collect()} == {1: 4, 2: 0}
    assert {r.qid: r.first_rank for r in R.merged_first_hit(base, new, 3).collect()} == {1: 0, 2: 0}
    pages = spark.createDataFrame([(1, "paris is big"), (2, "in paris"), (3, "rome")], "doc_id long, page string")
    asked = spark.createDataFrame([(1, 0, "london town hall"), (1, 1, "paris"), (1, 2, "rome"), (2, 0, ""), (2, 1, "oslo")], "qid long, pos int, answer string")
    assert sorted((r.qid, r.answer, r.doc_id) for r in R.gold_pages(pages, asked).collect()) == [(1, "paris", 1), (1, "paris", 2)]
    own = F.array(*[F.struct(F.lit(t).alias("title"), F.lit(x).alias("text")) for t, x in (("A", "In  Paris."), ("B", "paris"), ("C", "Rome"))])
    chosen = lambda *c: spark.range(1).select(S.chosen_answer(own, F.array(*map(F.lit, c))).alias("x")).first().x
    assert tuple(chosen("Oslo", " ", "PARIS", "rome")) == ("PARIS", ["A", "B"]) and chosen("Oslo") is None


def test_work_items(spark):
    questions = spark.createDataFrame([(1, "Paris"), (2, "the"), (3, "Rome")], "qid long, answer string")
    contexts = spark.createDataFrame([(1, [("t", "x")]), (2, [("t", "x")]), (3, [])], "qid long, passages array<struct<title:string,text:string>>")
    assert sorted(r.qid for r in S.work_items(questions, None).collect()) == [1, 3]
    assert [r.qid for r in S.work_items(questions, contexts).collect()] == [1]


def test_parsed_articles(spark):
    long = lambda n: " ".join(f"This is sentence number {i} of some length." for i in range(n))
    pages = [(1, f"<p>{long(3)}</p><h2>Life</h2><p>{long(4)}</p><h2>See also</h2><p>{long(5)}</p><h2>Short</h2><p>No.</p><h2>End</h2>{long(2)}"), (2, f"<p>{long(7)}</p>")]
    got = T.parsed_articles(spark.createDataFrame(pages, "page_id int, html string"), "html").collect()
    assert [r.page_id for r in got] == [1] and got[0].labels == [0, 0, 1, 0, 0, 0, 1, 0] and len(got[0].sentences) == 9


def test_rounded_by_scaling(spark):
    given = [938.9437499999999, 1004.7212499999998, -938.9437499999999, 0.49999999999999994e-4, 1e300, float("inf"), float("nan"), None, 12.0]
    got = [r.x for r in spark.createDataFrame([(x,) for x in given], "x double").coalesce(1).select(B.rounded(F.col("x"), 4).alias("x")).collect()]
    # The second one's ten thousandfold is 10047212.499999998 as a double.
    assert got[:6] == [938.9438, 1004.7212, -938.9438, 0.0, 1e300, float("inf")] and got[6] != got[6] and got[7:] == [None, 12.0]


def test_samples_stay_in_their_row(spark):
    groups = spark.range(50).selectExpr("id AS qid", "array(0.5D, id / 50.0D, 0.1D) AS s")
    got = M.policy_gradient(groups, 4)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()  # neither samples nor rewards are shuffled
    assert all(r.live == (r.advantage > 0) and 1 / 3 <= r.reward <= 1 for r in got.collect()) and got.count() == 50
