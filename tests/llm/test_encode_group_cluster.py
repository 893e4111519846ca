"""Byte-level BPE, spelling variants and exact clustering against the library and brute force, and their edge cases."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagelens.llm import byte_bpe, spelling_variants, subvector_clusters

DOCS = "doc_id long, text string, ids string, key string, word string"


# 12
@pytest.fixture(scope="module")
def library():
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    with open(public.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_of_every_code_point(library):
    encoder = byte_bpe._encoder("byte_bpe_multi_50k.tiktoken", None)
    every = "".join(f"a{chr(c)} {chr(c)}{chr(c)}1" for c in range(0x11000) if not 0xD800 <= c < 0xE000)
    for at in range(0, len(every), 20_000):
        part = every[at : at + 20_000]
        assert np.frombuffer(encoder.encode([part])[0], "<u4").tolist() == library.encode_ordinary(part)
    assert encoder.decode(encoder.encode([every])[0]) == every.encode()


def test_merges_take_the_leftmost_of_least_rank(library):
    encoder, rng = byte_bpe._encoder("byte_bpe_multi_50k.tiktoken", None), random.Random(2)
    for size in [*range(1, 200), 5_000, 60_000]:
        piece = "".join(rng.choice("aeinst" if size % 2 else "ab日é") for _ in range(size))
        assert np.frombuffer(encoder.encode([piece])[0], "<u4").tolist() == library.encode_ordinary(piece)


def test_chunks_give_what_whole_texts_give(spark, library):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "'s", "'re", "don't", "a", "é", "1", "²", "!", "...", "\t", "<|endoftext|>", "日本", "x'v", "😀", "\r\n", "ther", "　", "\x85", "''s", "\x1c", "  \n  "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 500))) for _ in range(150)]
    texts += ["a" * 900, "ab " * 300 + "x" * 500 + " y" * 300, "x" * 200 + " z" * 200 + "w" * 300, " " * 700 + "x", "'" * 500 + "re" * 300, "", None, texts[0], "b " * 49 + "b", "b " * 50 + "b", "c" * 100, "c" * 101]
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(texts)] + [(None, texts[3], "x", "y", "z"), (3, texts[3], None, None, None), (500, texts[150], None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = byte_bpe.decode(byte_bpe.encode(docs, chunk=100, overlap=40)).collect()
    want = Counter((r[0], tuple(library.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in rows)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in got) == want
    assert byte_bpe.encode(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode(docs, chunk=100, overlap=8)


def test_a_very_long_text(spark, library):
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("etaoinshrdlu'") for _ in range(rng.randint(1, 12))) + rng.choice(["", ".", ",", "\n\n", " 19"]) for _ in range(150_000))
    [got] = byte_bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert np.frombuffer(got.ids, "<u4").tolist() == library.encode_ordinary(text)


# 13
def brute_variants(rows, damaged=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % damaged == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near, left = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            left[i, rest].add(w)
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    for group in left.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda o: (-n[o], o)) for w in n if near[w]}
    form = {w: o for w, o in best.items() if n[o] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(5)
    letters = "abcdeèéßÿ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "ababab", "bababa", "abcab" * 40]

    def edited(w):
        i, c = rng.randrange(len(w)), rng.choice(letters)
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w, w + c])

    words = [w for b in base for w in [b] * rng.choice([3, 8, 40]) + [edited(b) for _ in range(8)] * 3 + [edited(edited(b))] * 4]
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", "1", "-\n", "×"]).join(w.upper() if rng.random() < 0.1 else w for w in words[i::40])) for i in range(40)]
    return [*rows, rows[0], (None, rows[1][1]), (99, None), (98, ""), (97, "12 34 --")]


@pytest.mark.parametrize(("partners", "crowd"), [(8, 10_000), (1, 1)])
def test_variants_equal_brute_force(spark, misspelt, monkeypatch, partners, crowd):
    """With small limits every key that words share is split down to the edit itself."""
    monkeypatch.setattr(spelling_variants.near_pairs, "__defaults__", (partners, crowd))
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in misspelt], DOCS)
    got = spelling_variants.spelling_variants(docs).collect()
    assert len(got) == len({r.word for r in got})
    assert {tuple(r) for r in got} == brute_variants(misspelt)
    assert spelling_variants.spelling_variants(docs.limit(0)).count() == 0


def test_crowded_chunks_are_split(spark):
    """4,000 words of one front half: comparisons stay in proportion to the words."""
    words = [f"commonfront{chr(97 + i // 676 % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}zzyyxxww" for i in range(0, 17_576, 4)]
    frame = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = {(r.word, r.other) for r in spelling_variants.near_pairs(frame).collect()}
    known = set(words)
    want = {(w, o) for w in words for i in (11, 12, 13) for c in map(chr, range(97, 123)) if (o := w[:i] + c + w[i + 1 :]) != w and o in known}
    assert got == want


def test_runs_of_a_long_text(monkeypatch):
    monkeypatch.setattr(spelling_variants, "STRETCH", 7)
    text = "Ééabc déf" * 50 + "x" * 40 + " y1Z\n×÷" * 9
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    assert spelling_variants.run_counts(text) == Counter(re.findall("[A-Za-zÀ-ÿ]+", low))


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [(f"v{i}", "w5") for i in range(50)], "word string, form string")
    assert {tuple(r) for r in spelling_variants.roots(forms).collect()} == {(f"w{i}", "w37") for i in range(37)} | {(f"v{i}", "w37") for i in range(50)}


# 11
def brute_clusters(rows, k, rounds, dim, scale=1024):
    good = [(i, [int(np.floor(scale * float(np.float32(v)))) for v in x]) for i, x in rows if x is not None and len(x) == dim and all(v is not None and np.isfinite(v) for v in x)]
    digest = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest())
    centroids = [list(x) for _, x in sorted(good, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def nearest():
        far = [[sum((a - b) ** 2 for a, b in zip(x, c)) for c in centroids] for _, x in good]
        return [f.index(min(f)) for f in far], [min(f) for f in far]

    for _ in range(rounds):
        own, _ = nearest()
        for c in range(len(centroids)):
            mine = [x for (_, x), o in zip(good, own) if o == c]
            if mine:
                centroids[c] = [sum(v) // len(mine) for v in zip(*mine)]
    own, far = nearest()
    inertia = Counter()
    for o, f in zip(own, far):
        inertia[o] += f
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, o, f, inertia[o], sum(far), sha[o]) for (i, _), o, f in zip(good, own, far))


VECTORS = "vec_id long, embedding array<float>, cluster string, x string"


@pytest.mark.parametrize("page", [7, 16_384])
def test_clusters_equal_brute_force(spark, page):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(5, 8))
    some = [(i, [float(v) for v in centres[i % 5] + rng.normal(size=8) * 0.4]) for i in range(120)]
    coarse = [(200 + i, [float(v) for v in np.round(centres[i % 5])]) for i in range(60)]
    odd = [(1, some[3][1]), (300, None), (301, some[0][1][:7]), (302, [*some[0][1][:7], None]), (303, [*some[0][1][:7], float("nan")]), (304, [*some[0][1][:7], float("inf")]), (None, some[7][1]), (None, some[8][1]), (305, [0.0] * 8), (306, [-1000.0] * 8)]
    rows = [*some, *coarse, *odd, *[(400 + i, some[11][1]) for i in range(40)]]
    table = spark.createDataFrame([(i, x, "c", "x") for i, x in rows], VECTORS)
    got, _ = subvector_clusters.cluster(table, k=6, rounds=4, dim=8, page=page)
    assert Counter(map(tuple, got.collect())) == brute_clusters(rows, 6, 4, 8)


def test_few_vectors_ties_and_none(spark):
    rows = [(i, [float(i % 2)] * 4) for i in range(5)]
    table = spark.createDataFrame([(i, x, None, None) for i, x in rows], VECTORS)
    got, centroids = subvector_clusters.cluster(table, k=8, rounds=2, dim=4)
    assert Counter(map(tuple, got.collect())) == brute_clusters(rows, 8, 2, 4) and len(centroids) == 5
    assert subvector_clusters.cluster(table.limit(0), dim=4)[0].collect() == []
    assert subvector_clusters.cluster(table, dim=64)[0].collect() == []
    with pytest.raises(Exception, match="too large"):
        subvector_clusters.cluster(table.select("vec_id", F.transform("embedding", lambda v: v + 200_000).alias("embedding")), dim=4)


def test_dictionaries_lose_nothing():
    rng = np.random.default_rng(7)
    fine, coarse = rng.integers(-60, 60, (5000, 4)), rng.integers(0, 2, (5000, 8))
    x = np.concatenate([fine, coarse], axis=1).astype(np.int32)
    blocks = subvector_clusters.encoded_page(x)
    assert np.array_equal(np.concatenate([words[codes] for _, words, codes in blocks], axis=1), x)
    widths = [words.shape[1] for _, words, _ in blocks]
    assert widths[:3] == [1] * 3 and max(widths) >= 4  # fine values stay apart, coarse ones are joined
    assert all(len(np.unique(words, axis=0)) == len(words) for _, words, _ in blocks)
