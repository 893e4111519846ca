"""Stored indexes, block joins, sentence breaks, order statistics, score stores, wikitext and versions against plain Python."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_studies import SENTENCES

from passagelens.functions import providers, wikitext
from passagelens.functions.text import normalize_text, parsed_articles
from passagelens.operators import inverted, order_statistics, reader_runs, retrieval, score_store, sentence_breaks, tables
from passagelens.plans import sweep
from passagelens.sources import readers, versions
from passagelens.sources.scratch import settled


# A stored index
@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 40)))) for i in range(700)]
    rows += [(5000 + i, " ".join(["rare"] * i)) for i in range(1, 6)] + [(9000, None), (9001, "")]
    queries = [(q, " ".join(rng.choices(words, k=rng.randint(1, 6)))) for q in range(30)] + [(100, "rare w3"), (101, "unknown words"), (102, ""), (103, "w0 w0 w1"), (104, None), (105, "rare")]
    return settled(spark.createDataFrame(rows, "chunk_id long, text string")), settled(spark.createDataFrame(queries, "qid long, text string"))


def test_a_stored_index_ranks_as_a_full_search(spark, texts, tmp_path):
    chunks, queries = texts
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        inverted.index_top_k(spark, path, queries, 5)
    inverted.add_to_index(chunks.where("chunk_id % 3 <> 0"), path)
    inverted.add_to_index(chunks.where("chunk_id % 3 = 0"), path)
    for k, first in ((10, 2), (40, 1)):
        got = {(r.qid, r.rank): (r.chunk_id, r.score) for r in inverted.index_top_k(spark, path, queries, k, first=first).collect()}
        want = {(r.qid, r.rank): (r.chunk_id, r.score) for r in retrieval.bm25_top_k(chunks, queries, k).collect()}
        assert got == want and len(got) == 36 * k


def test_blocks_that_cannot_reach_the_best_are_not_read(spark, tmp_path, monkeypatch):
    """Chunks of one rare term hold the best; ranges that have the common one alone are left out."""
    monkeypatch.setattr(inverted, "RANGE", 16)
    rows = [(i, "common filler " + ("scarce " * 3 if i in (70, 71, 72) else "words " * (i % 5 + 1))) for i in range(640)]
    path = str(tmp_path / "index")
    inverted.add_to_index(spark.createDataFrame(rows, "chunk_id long, text string"), path)
    read = []
    plain = inverted.ranked
    monkeypatch.setattr(inverted, "settled", lambda df, by=None: (read.append(sorted(df.columns)), settled(df, by))[1])
    asked = spark.createDataFrame([(1, "common scarce")], "qid long, text string")
    got = [r.chunk_id for r in inverted.index_top_k(spark, path, asked, 3, first=1).orderBy("rank").collect()]
    assert got == [70, 71, 72] and plain is inverted.ranked
    bounds = inverted._read(spark, path, "blocks").where("range = 4").count()
    assert bounds >= 2 and ["qid", "range"] in read


# Queries and rows that meet by a shuffle
def test_many_queries_meet_rows_without_the_driver(spark, texts, monkeypatch):
    chunks, queries = texts
    want = {tuple(r) for r in retrieval.bm25_top_k(chunks, queries, 7).collect()}
    rng = np.random.default_rng(2)
    vectors = settled(spark.createDataFrame([(i, rng.normal(size=6).round(3).tolist()) for i in range(400)], "chunk_id long, vec array<double>"))
    asked = vectors.where("chunk_id % 3 = 0").withColumnRenamed("chunk_id", "qid")
    dense = {tuple(r) for r in retrieval.dense_top_k(vectors, asked, 5).collect()}
    monkeypatch.setattr(retrieval, "QUERIES", 10)
    monkeypatch.setattr(retrieval, "BLOCK", 4)
    assert {tuple(r) for r in retrieval.bm25_top_k(chunks, queries, 7).collect()} == want
    plan = retrieval.dense_top_k(vectors, asked, 5)
    assert {tuple(r) for r in plan.collect()} == dense and len(dense) == 134 * 5


def test_searches_run_in_small_batches(spark, texts):
    chunks, queries = texts
    assert "MapIn" not in retrieval.bm25_top_k(chunks, queries, 7)._jdf.queryExecution().toString()  # what runs later gets the session's large ones
    rows = chunks.repartition(1).select("chunk_id", retrieval.hashed_terms(F.col("text")).alias("terms"))
    wanted = rows.select(F.explode("terms").alias("term")).distinct().where("term % 3 = 0")
    got = {r.chunk_id: (r.dl, dict(zip(r.terms, r.counts))) for r in retrieval.counted_terms(rows, wanted, ["chunk_id"]).collect()}
    assert got == {r.chunk_id: (len(r.terms), Counter(t for t in r.terms if t % 3 == 0)) for r in rows.collect()}


def reads(spark, frame):
    """The rows of frame, and how many of them have been made."""
    made = spark.sparkContext.accumulator(0)

    def seen(frames):
        for one in frames:
            made.add(len(one))
            yield one

    return frame.mapInPandas(seen, frame.schema), made


def test_pages_are_made_once(spark):
    pages, made = reads(spark, spark.createDataFrame([(d, f"the red tower of king {d} in spain") for d in range(40)], "doc_id long, page string"))
    answers = spark.createDataFrame([(1, "red tower of king 7"), (2, "ower"), (3, "g 12"), (4, "none of these here"), (5, "9 in")], "qid long, answer string")
    got = {(r.qid, r.doc_id) for r in retrieval.containing_documents(pages, answers).collect()}
    assert got == {(1, 7), (3, 12)} | {(2, d) for d in range(40)} | {(5, d) for d in (9, 19, 29, 39)} and made.value == 40


def test_chunk_tables_read_documents_once(spark):
    docs, made = reads(spark, spark.createDataFrame([(d, ["One.", "Two.", "Three."]) for d in range(30)], "doc_id long, sentences array<string>"))
    assert [r.chunk_id for r in sweep.fixed_chunk_table(docs, 2, 0).orderBy("doc_id", "chunk_id").collect()] == list(range(60)) and made.value == 30


@pytest.mark.parametrize("dim", [16, 4, 10])
def test_hashed_vectors_equal_plain_python(spark, dim):
    rows = [(0, ["Oak elm, oak.", "Ash 12!"]), (1, ["...", ""]), (2, ["É x", "a b c d e f g h"])]
    frame = spark.createDataFrame(rows, "i int, s array<string>")
    got = frame.select("i", providers.hashed_vector(F.array_join("s", " "), dim).alias("v"), F.array_join(F.transform("s", lambda x: providers.hashed_digits(x)), "").alias("d"))
    for r in got.withColumn("of_digits", providers.vector_of_digits(F.col("d"), dim) if 16 % dim == 0 else F.col("v")).collect():
        counts = Counter(int(hashlib.md5(t.encode()).hexdigest()[:6], 16) % dim for t in re.findall("[a-z0-9]+", " ".join(rows[r.i][1]).lower()))
        norm = math.sqrt(sum(n * n for n in counts.values()))
        assert r.v == r.of_digits == [counts[k] / norm if norm else 0.0 for k in range(dim)]


def test_normalised_text_has_single_blanks(spark):
    text = "\t A  b\u00a0c\u2003 \x1cd \ne f\r\n"
    assert spark.range(1).select(normalize_text(F.lit(text))).first()[0] == " ".join(text.split()).lower()


# Answers by their rarest inner word
def test_answers_in_pages(spark):
    rng = random.Random(3)
    words = ["of", "the", "a", "king", "queen", "france", "spain", "war", "x", "b", "tower", "in", "red", "é"]
    pages = [(d, " ".join(rng.choices(words, [9, 9, 6] + [1] * 11, k=60))) for d in range(120)] + [(900, ""), (901, "of the"), (902, None)]
    answers = []
    for q in range(150):
        page = rng.choice(pages[:120])[1]
        at = rng.randrange(len(page) - 25)
        answers.append((q, page[at : at + rng.randint(3, 25)].strip()))
    answers += [(500, "of the a"), (501, "king of france"), (502, "ing of fra"), (503, ""), (504, "never of seen"), (505, "g"), (506, "a b c d e")]
    got = retrieval.containing_documents(spark.createDataFrame(pages, "doc_id long, page string"), spark.createDataFrame(answers, "qid long, answer string")).collect()
    want = {(q, d) for q, a in answers if a for d, p in pages if p is not None and a in p}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_three_word_answers_meet_few_pages(spark):
    """The one inner word may be the commonest of all: what stands beside it keeps candidates near the true pairs."""
    rng = random.Random(4)
    names = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(300)]
    pages = [(d, " of ".join(rng.choices(names, k=40))) for d in range(200)]
    answers = [(q, f"{a} of {b}") for q, (a, b) in enumerate(zip(rng.choices(names, k=400), rng.choices(names, k=400)))]
    frame, asked = spark.createDataFrame(pages, "doc_id long, page string"), spark.createDataFrame(answers, "qid long, answer string")
    keys = settled(retrieval.answer_keys(frame, asked.withColumn("w", F.split("answer", " "))))
    candidates = retrieval.candidate_pages(frame, keys).count()
    true = sum(a in p for _, a in answers for _, p in pages)
    assert true > 10 and candidates <= 10 * true


# Sentence ends
CORPUS = [
    "Dr. Smith met Mr. Jones. They talked about the U.S. team for hours. Dr. Adams was late.",
    "Mr. Brown saw Dr. Smith at 3 p.m. yesterday. Then he went home. The train left at 5 p.m. sharp.",
    "The U.S. team won again. Mr. Jones was happy. He left later. Then they went out.",
    "Prices in the U.S. market rose. The market fell later. She was then with Mrs. Brown until 9 p.m. on Monday.",
    "J. S. Bach composed music. People listened to J. S. Bach with joy. Music is fine. The team listened later.",
    "Mrs. Brown and Mr. Brown met at 4 p.m. in town. He said so. They left. The music was good. He arrived. The house was left.",
]


@pytest.fixture(scope="module")
def learnt(spark):
    rows = [(i, CORPUS[i % len(CORPUS)]) for i in range(60)] + [(90, None), (91, ""), (92, "... !")]
    frame = spark.createDataFrame(rows, "id long, text string")
    return rows, sentence_breaks.learn(frame)


def test_abbreviations_equal_brute_force(learnt):
    rows, model = learnt
    token = re.compile(r"[^\W_](?:[\w'’.&/\-]*[^\W_])?\.*|\.{2,}|\S")
    with_, without, total = Counter(), Counter(), 0
    for _, t in rows:
        for form in token.findall(t or ""):
            total += 1
            if re.match(r"[^\W_]", form):
                kind = form.rstrip(".").lower()
                kind = "##number##" if re.fullmatch(r"-?[\d.,]*\d", kind) else kind
                (with_ if re.search(r"[^\W_]\.$", form) else without)[kind] += 1
    p = sum(with_.values()) / total
    want = set()
    for kind, k in with_.items():
        n = k + without[kind]
        ratio = -2 * (k * math.log(p) + (n - k) * math.log(1 - p) - k * math.log(0.99) - (n - k) * math.log(0.01))
        inner = kind.count(".") + 1
        letters = len(kind) - inner + 1
        if re.search(r"[^\W\d_]", kind) and ratio * math.exp(-letters) * inner * letters ** -without[kind] >= 0.3:
            want.add(kind)
    got = {r.type for r in model.abbreviations.collect()}
    assert got == want and {"dr", "mr", "mrs", "u.s", "p.m"} <= got and not got & {"music", "jones", "left"}


def test_golden_sentences_without_a_list(spark, learnt):
    _, model = learnt
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SENTENCES)] + [(99, None)], "i int, text string")
    got = {r.i: r.sentences for r in sentence_breaks.break_sentences(frame, model).collect()}
    assert [got[i] for i in range(len(SENTENCES))] == [s for _, s in SENTENCES] and got[99] == []


def test_breaks_follow_what_the_corpus_shows(spark, learnt):
    _, model = learnt
    cases = [
        ("He met Dr. Smith. Then he left.", ["He met Dr. Smith.", "Then he left."]),
        ("It rose in the U.S. Then it fell.", ["It rose in the U.S.", "Then it fell."]),
        ("It rose in the U.S. market.", ["It rose in the U.S. market."]),
        ("She left at 5 p.m. They stayed.", ["She left at 5 p.m.", "They stayed."]),
        ("Wait ... no. Yes.", ["Wait ... no.", "Yes."]),
        ("An odd zzz. word follows.", ["An odd zzz.", "word follows."]),
        ("One line.\n\n  Another \"line.\"  (Third.) end", ["One line.", "Another \"line.\"", "(Third.)", "end"]),
    ]
    got = sentence_breaks.break_sentences(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, text string"), model).collect()
    assert {r.i: r.sentences for r in got} == {i: s for i, (_, s) in enumerate(cases)}
    nothing = sentence_breaks.learn(spark.createDataFrame([], "text string"))
    assert [r.sentences for r in sentence_breaks.break_sentences(spark.createDataFrame([("Oak elm. Ash fir.",)], "text string"), nothing).collect()] == [["Oak elm.", "Ash fir."]]


def test_learning_keeps_no_row_a_token_and_long_words_cost_their_length(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(sentence_breaks, "settled", lambda df, by=None, f=sentence_breaks.settled: kept.append(f(df, by)) or kept[-1])
    model = sentence_breaks.learn(spark.createDataFrame([(t,) for t in CORPUS * 50], "text string"))
    n_tokens = sum(len(t.split()) for t in CORPUS)
    assert all(kind != "array<string>" for table in kept for _, kind in table.dtypes) and max(t.count() for t in kept) < n_tokens
    long = "x" * 200_000
    began = time.time()
    got = sentence_breaks.break_sentences(spark.createDataFrame([(f"{long} oak. Elm fir (Dr.) Ash. \"He.\" she",)], "text string"), model).first().sentences
    assert got[:2] == [f"{long} oak.", "Elm fir (Dr.) Ash."] and time.time() - began < 30


# Order statistics
@pytest.mark.parametrize("few", [3, 10_000])
def test_percentiles_equal_numpy(spark, few):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=801), "b": np.repeat([1.0, 2.0, 2.0, 5.0], 100), "c": np.array([7.0]), "d": np.exp(rng.normal(0, 30, 200)), "e": np.full(300, 3.0), None: rng.integers(0, 4, 99).astype(float)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("f", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {r.g: r for r in order_statistics.percentiles(frame, ["g"], "v", shares, few).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert got[g].n == len(vs) and np.allclose(got[g].q, np.quantile(vs, shares), rtol=1e-12)
    medians = {r.g: r.upper_median for r in order_statistics.upper_medians(frame, ["g"], "v", few).collect()}
    assert medians == {g: sorted(vs)[len(vs) // 2] for g, vs in groups.items()}
    assert order_statistics.upper_medians(frame, [], "v", few).first().n == len(rows) - 2
    assert order_statistics.percentiles(frame.limit(0), ["g"], "v", shares, few).collect() == []


# Scores that are kept
def test_scoring_goes_on_after_a_failure(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, "q" * rng.randint(0, 9), "t" * rng.randint(0, 30)) for i in range(80)] + [(200, None, "t"), (201, None, "t"), (202, "q", None)]
    pairs, path, calls = spark.createDataFrame(rows, "i long, l string, r string"), str(tmp_path / "scores"), []

    def score(own):
        seen = own.collect()
        calls.append([len(r.l or "") + len(r.r or "") for r in seen])
        if len(calls) == 4:
            raise RuntimeError("the model died")
        return own.withColumn("score", F.length(F.coalesce("l", F.lit(""))) + F.length(F.coalesce("r", F.lit(""))) * 0.5)

    with pytest.raises(RuntimeError):
        score_store.score_pairs(pairs, "l", "r", score, path, most=200)
    done = score_store.stored_scores(spark, path).count()
    assert 0 < done < 70
    got = score_store.score_pairs(pairs, "l", "r", score, path, most=200).collect()
    assert {r.i: r.score for r in got} == {i: len(a or "") + len(b or "") * 0.5 for i, a, b in rows} and len(got) == len(rows)
    distinct = {(a or "", b or "") for _, a, b in rows}
    assert sum(len(c) for c in calls) - len(calls[3]) == len(distinct)  # no pair twice, but for the batch that failed
    assert all(min(a, default=0) >= max(b, default=0) for a, b in zip(calls[:3], calls[1:3])) and all(sum(x + 1 for x in c) < 200 + max(c) + 1 for c in calls)
    before = len(calls)
    score_store.score_pairs(pairs, "l", "r", score, path, most=200).count()
    assert len(calls) == before


# Wikitext
PAGE = """{{Infobox|name={{nested|{{deep}}}}
| caption = == No heading ==
}}'''Lead''' has a [[link|shown text]] and [[plain]] words.<ref>gone {{x}}</ref> It has [http://a.b/c outside names] too.
== History ==
Prose of the first section &amp; more of it [[File:a.png|thumb|left|a [[nested link]] here]].
{| class="wikitable"
|-
! Head !! Other
|-
| style="x" | cell one || cell [[two|2]]
|}
=== Details ===
Left out, as it stands below a deeper heading.
== References ==
* cited
==Second==
More {{unclosed prose [[open."""


def test_wikitext_parts():
    got = wikitext.parts(re.sub(r"(?is)<ref[^>]*>.*?</ref>", " ", PAGE))
    assert [(level, name) for level, name, _ in got] == [(0, ""), (2, "History"), (3, "Details"), (2, "References"), (2, "Second")]
    assert got[0][2].strip() == "Lead has a shown text and plain words.  It has outside names too."
    assert "thumb|left|a nested link here" in got[1][2] and "& more" in got[1][2]
    assert got[1][2].split("\n")[2:6] == ["Head", "Other", "cell one", "cell 2"]
    assert got[4][2].strip() == "More {{unclosed prose [[open."
    assert wikitext.parts("") == [(0, "", "")] and wikitext.parts("}} ]] |} ==") == [(0, "", "}} ]] |} ==")]
    assert wikitext.parts("{{" * 3000 + "}}" * 3000) == [(0, "", "")]


def test_parsed_wikitext(spark):
    sentence = "This sentence has its twenty letters number {}."
    body = lambda a, n: " ".join(sentence.format(i) for i in range(a, a + n))
    page = f"{body(0, 3)}\n== One ==\n{{{{x|{body(90, 3)}}}}}{body(10, 4)}\n=== Deep ===\n{body(20, 2)}\n== See also ==\n{body(30, 2)}\n== Two ==\n{body(40, 2)}"
    rows = spark.createDataFrame([(1, page), (2, "too short."), (3, None)], "page_id int, wikitext string")
    [got] = wikitext.parsed_wikitext(rows, "wikitext").collect()
    assert got.page_id == 1 and [int(re.search(r"\d+", s)[0]) for s in got.sentences] == [0, 1, 2, 10, 11, 12, 13, 40, 41] and got.labels == [0, 0, 1, 0, 0, 0, 1, 0]
    html = f"{body(0, 3)}<h2>One</h2>{body(10, 4)}<h2>See also</h2>{body(30, 2)}<h2>Two</h2>{body(40, 2)}"
    [same] = parsed_articles(spark.createDataFrame([(1, html)], "page_id int, html string"), "html").collect()
    assert (same.sentences, same.labels) == (got.sentences, got.labels)


# Versions
def test_versions(spark, tmp_path):
    path = str(tmp_path / "table")
    assert versions.current(spark, path) is None and versions.version(spark, path) == 0
    assert versions.commit(spark.range(3), path) == 1
    held = versions.current(spark, path)
    assert versions.commit(held.selectExpr("id + 10 AS id"), path) == 2  # made from the version before
    assert sorted(r.id for r in versions.current(spark, path).collect()) == [10, 11, 12] and sorted(r.id for r in held.collect()) == [0, 1, 2]
    with pytest.raises(Exception, match="no such luck"):
        versions.commit(spark.range(5).select(F.raise_error(F.lit("no such luck"))), path)
    assert versions.version(spark, path) == 2 and versions.current(spark, path).count() == 3
    assert versions.expire(spark, path) >= 2 and versions.current(spark, path).count() == 3


def test_only_changed_keys_are_computed_again(spark, tmp_path):
    path, asked = str(tmp_path / "table"), []

    def compute(rows):
        asked.append({r.k for r in rows.collect()})
        return rows.select("k", F.upper("v").alias("big"))

    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    assert versions.refreshed(rows((1, "a"), (2, "b"), (3, None)), path, ["k"], ["v"], compute) == (1, 3)
    assert versions.refreshed(rows((1, "a"), (2, "B"), (4, "d"), (3, "")), path, ["k"], ["v"], compute) == (2, 3)
    assert asked[-1] == {2, 3, 4}
    assert {(r.k, r.big) for r in versions.current(spark, path).collect()} == {(1, "A"), (2, "B"), (3, ""), (4, "D")}
    assert versions.refreshed(rows((1, "a")), path, ["k"], ["v"], compute) == (3, 0)
    assert [r.k for r in versions.current(spark, path).collect()] == [1]


# Readers that go on
def test_a_reader_run_goes_on(spark, tmp_path):
    path, asked = str(tmp_path / "run"), []
    items = spark.createDataFrame([(i, f"prompt {i}") for i in range(20)], "qid long, prompt string")

    def generate(rows):
        asked.append({r.qid for r in rows.collect()})
        if len(asked) == 3:
            raise RuntimeError("the runtime died")
        return rows.withColumn("raw", F.concat(F.lit("<think>x</think> "), "prompt", F.lit("\nmore")))

    with pytest.raises(RuntimeError):
        reader_runs.answer_items(items, generate, path, "g1", batches=4)
    done = reader_runs.saved_outputs(spark, path).count()
    assert 0 < done < 20
    assert reader_runs.answer_items(items, generate, path, "g1", batches=4) == 20 - done
    saved = reader_runs.saved_outputs(spark, path).collect()
    assert sorted(r.qid for r in saved) == list(range(20)) and all(r.prediction == f"prompt {r.qid}" for r in saved)
    assert reader_runs.answer_items(items, generate, path, "g1") == 0
    with pytest.raises(ValueError, match="other prompts"):
        reader_runs.answer_items(items.withColumn("prompt", F.concat("prompt", F.lit("!"))), generate, path, "g1")
    with pytest.raises(ValueError, match="g1"):
        reader_runs.answer_items(items, generate, path, "g2")


def test_nearest_matches_equal_brute_force(spark):
    rng = random.Random(9)
    left = [(i, rng.choice("abc"), rng.randint(0, 30) / 2) for i in range(80)] + [(90, "lonely", 1.0)]
    right = [(i, rng.choice("abd"), rng.randint(0, 30) / 2) for i in range(40)]
    got = tables.nearest_match(spark.createDataFrame(left, "l long, k string, size double"), spark.createDataFrame(right, "r long, k string, size double"), ["k"], "size", "r")
    want = {}
    for i, k, size in left:
        near = [(abs(size - s), r) for r, key, s in right if key == k]
        if near:
            want[i] = min(near)
    assert {r.l: (r.gap, r.match.r) for r in got.collect()} == want


def test_article_vectors_and_partial_contexts(spark, tmp_path):
    path = str(tmp_path / "vectors")
    spark.createDataFrame([(d, p, [float(p), 1.0]) for d in "abc" for p in (2, 0, 1)], "doc_id string, pos int, vec array<double>").write.parquet(path)
    assert {r.doc_id: [v[0] for v in r.vecs] for r in readers.article_vectors(spark, path, ["a", "c"]).collect()} == {"a": [0, 1, 2], "c": [0, 1, 2]}
    assert [r.doc_id for r in readers.article_vectors(spark, path, spark.createDataFrame([("b",), ("b",)], "doc_id string")).collect()] == ["b"]
    contexts, kind = tmp_path / "contexts", "struct<doc_id:string,text:string>"
    assert readers.read_partial(spark, str(contexts), kind, {"n": "1"}, ["a"], 1) is None
    contexts.mkdir()
    (contexts / "part.txt").write_text('{"meta": {"n": "1"}}\n{"arm": "a", "contexts": [[{"doc_id": "d", "text": "t"}]]}\n')
    assert readers.read_partial(spark, str(contexts), kind, {"n": "1"}, ["a"], 1).first().contexts[0][0].text == "t"
    for meta, arms, n in (({"n": "2"}, ["a"], 1), ({"n": "1"}, ["a", "b"], 1), ({"n": "1"}, ["a"], 2)):
        with pytest.raises(ValueError):
            readers.read_partial(spark, str(contexts), kind, meta, arms, n)


def test_many_corpora_in_one_search(spark, texts):
    chunks, queries = texts
    rows = chunks.select((F.col("chunk_id") % 3).cast("int").alias("corpus"), "chunk_id", retrieval.hashed_terms(F.col("text")).alias("terms"))
    counted = retrieval.counted_terms(rows, retrieval.asked_terms(queries).select("term").distinct(), ["corpus", "chunk_id"])
    got = retrieval.bm25_by_corpus(counted, queries, 6, [0, 1, 2, 3]).collect()
    for corpus in range(3):
        want = retrieval.bm25_top_k(chunks.where(F.col("chunk_id") % 3 == corpus), queries, 6).collect()
        assert {(r.qid, r.rank, r.chunk_id, r.score) for r in got if r.corpus == corpus} == {tuple(r) for r in want}
    assert not any(r.corpus == 3 for r in got)


def test_spans_are_searched_as_chunks(spark, monkeypatch):
    """Spans of sentences rank as a table of their chunks does, by the search that makes no row a chunk and by the one that does."""
    from passagelens.operators import span_search
    from passagelens.operators.chunking import config_grid
    from passagelens.plans import sweep

    draw = random.Random(5)
    docs = [(i, [" ".join(draw.choice("abcdefghij") for _ in range(draw.randint(0, 4))) for _ in range(draw.choice([0, 1, 3, 9, 14]))]) for i in range(40)] + [(40, None)]
    docs = spark.createDataFrame([(i, s, [draw.random() for _ in (s or [])[1:]]) for i, s in docs], "doc_id long, sentences array<string>, probs array<double>").repartition(5)
    asked = spark.createDataFrame([(7, "a b a"), (3, "c zz"), (5, "zz"), (4, "")], "qid long, text string")
    grid = config_grid([2, 3], [0, 1])
    monkeypatch.setattr(span_search, "CELLS", 8)  # few chunks at a time
    rows = lambda found: sorted(tuple(r) for r in found.collect())
    got = [rows(x) for x in sweep._ranked_spans(docs, asked, 6, grid, {})]
    monkeypatch.setattr(sweep, "_ranked_spans", None)
    expected = [rows(x) for x in sweep._ranked_rows(docs, asked, 6, grid, {})]
    assert got[0] == expected[0] and len(got[0]) == 6 * 4 * len(grid)
    assert [r[:2] for r in got[1]] == [r[:2] for r in expected[1]] and all(abs(x[2] - y[2]) < 1e-12 for x, y in zip(got[1], expected[1]))
    monkeypatch.setattr(span_search, "RANKINGS", 1)
    assert span_search.span_top_k(docs, asked, 6, 8) is None


def test_stored_ranges_are_scored_in_tables(spark, tmp_path, monkeypatch):
    """A range's postings meet all questions in one table; more questions than a task holds are joined, with the same ranks."""
    draw = random.Random(3)
    chunks = spark.createDataFrame([(i * 37, " ".join(draw.choice("abcdefgh") for _ in range(draw.randint(0, 9)))) for i in range(120)], "chunk_id long, text string")
    asked = spark.createDataFrame([("x", "a b a"), ("y", "c"), ("z", "h zz")], "qid string, text string")
    path = str(tmp_path / "index")
    inverted.add_to_index(chunks, path)
    rows = lambda: sorted(tuple(r) for r in inverted.index_top_k(spark, path, asked, 7, first=1).collect())
    got = rows()
    monkeypatch.setattr(inverted, "QUERIES", 2)
    monkeypatch.setattr(inverted, "_range_scorer", None)
    assert got == rows() and len(got) == 21
