"""Spelling variants, language-model scores and collocations against brute force, and on odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrelog.llm import collocations, pitmanyor, queries, spelling

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, word string, n long, chunk string, data string, bucket int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "w", 1, "c", "d", 0) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    texts = ["", None, " ", "one", "one two one two", "Ünïcödé ÜNÏCÖDÉ ünïcödé colour color colour", "a.b,c;d!e?f\rg\x0bh", "x" * 300_000, "the same words " * 40_000, "日本語 テスト 😀", "tab\tand\x1cfs\x85nel"]
    return frame(spark, [(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)] + [(3, "one", "en"), (3, "one", "en"), (None, "no name color", "fr")])


def small_texts(seed, words, size, length):
    r = random.Random(seed)
    return [" ".join(r.choice(words) + r.choice(["", "", "", "", ",", ".", "!"]) for _ in range(r.randrange(length))) for _ in range(size)]


# 11 spelling variants


def brute_words(rows, damage=97):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    out = {}
    for w in n:
        near = [v for v in n if abs(len(v) - len(w)) < 2 and one_apart(w, v)]
        best = min(near, key=lambda v: (-n[v], v)) if near else None
        form = best if best and n[best] >= 2 * n[w] else None
        out[w] = [form, w, n[w], len(near), n[form] if form else None]
    for w in out:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return out


def check_variants(docs, damage=97):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.word: [r.form, r.root, r.n, r.n_near, r.form_n] for r in spelling.variants(docs, damage).collect()}
    assert got == brute_variants(brute_words(rows, damage))
    return got


def test_spelling_equals_brute_force_on_the_table(docs):
    assert sum(x[0] is not None for x in check_variants(docs).values()) > 100


def test_spelling_equals_brute_force_on_words_of_few_letters(spark):
    """Words over two letters: repeated bigrams, shared beginnings and ends, edits at every place."""
    r = random.Random(3)
    words = ["".join(r.choice("ab") for _ in range(r.randrange(5, 10))) for _ in range(300)] + ["".join(r.choice("abcé") for _ in range(r.randrange(5, 8))) for _ in range(200)]
    texts = [" ".join([w] * r.randrange(1, 30)) for w in words]
    got = check_variants(frame(spark, [(i, t, None) for i, t in enumerate(texts)]), damage=3)
    assert max(x[3] for x in got.values()) > 5


def test_spelling_roots_follow_forms_to_the_last(spark):
    chain = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb", "aaabbbbb", "aabbbbbb"]
    docs = frame(spark, [(1, " ".join(" ".join([w] * 3 * 2**i) for i, w in enumerate(chain)), None)])
    got = {r.word: (r.form, r.root) for r in spelling.variants(docs, None).collect()}
    assert got == {w: (v, chain[-1]) for w, v in zip(chain, [*chain[1:], None])}


def test_spelling_keys_are_not_broadcast(spark, tmp_path):
    """Millions of keys come from a file of words below Spark's threshold: they would not fit the driver."""
    spark.createDataFrame([("house", 9), ("horse", 3)], "word string, n long").write.parquet(f"{tmp_path}/words")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        pairs = spelling.near_pairs(spark.read.parquet(f"{tmp_path}/words"))
        assert pairs.collect() == [("horse", 3, "house", 9)]
        assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_spelling_of_odd_rows_and_an_empty_table(odd):
    got = check_variants(odd)
    assert "ünïcödé" not in got or got["ünïcödé"][2] >= 3  # only A-Z are lower-cased
    assert spelling.variants(odd.limit(0)).collect() == []


# 12 language-model scores


def brute_base(rows, training):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + ["\n"] for k, (_, t) in enumerate(rows)}
    counts = Counter(w for k, (i, _) in enumerate(rows) if training(i) for w in words[k])
    total, distinct = sum(counts.values()), len(counts)
    return {k: (len(w), sum(counts[x] > 0 for x in w), total, sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)) for k, w in words.items()}


def check_scores(docs, chunk):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    learned = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1
    want = sorted((rows[k][0] is None, rows[k][0] or 0, not learned(rows[k][0]), *v[:3], round(v[3], 6)) for k, v in brute_base(rows, learned).items())
    found = pitmanyor.score(docs, queries.remainder(5) != 1, chunk=chunk).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, not r.training, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    return found


def test_language_model_base_and_perplexity(docs):
    found = check_scores(docs, 20_000)
    held = [r for r in found if not r.training]
    per_token = lambda column: sum(r[column] for r in held) / sum(r.n_tokens for r in held)
    assert per_token("score") > per_token("base_score") + 0.3  # log10: half the perplexity at least


def test_language_model_does_not_depend_on_chunks(docs):
    """The same draws, however the texts are cut into chunks."""
    some = docs.filter("doc_id < 40")
    a, b = ({r.doc_id: r.score for r in pitmanyor.score(some, queries.remainder(5) != 1, chunk=c).collect()} for c in (500, 1_000_000))
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-6 * abs(a[i]) for i in a)


def test_language_model_probabilities_sum_to_one(spark):
    """Of every next token after a context, the unknown word and the end included."""
    r = random.Random(5)
    words = ["ant", "bee", "cat", "dog", "eel"]
    train = [(i, " ".join(r.choices(words, [9, 5, 3, 2, 1], k=r.randrange(1, 9))), None) for i in range(200)]
    steps, ask = [*words, "zzz"], 1000
    # chains w v w v ... : the ratio of a longer to a shorter one is P(v|w) P(w|v), and ends cancel
    held = [(ask + 100 * i + 10 * j + n, " ".join(([w, v] * 9)[:n]), None) for i, w in enumerate(steps) for j, v in enumerate(steps) for n in range(1, 6)]
    held.append((9999, "", None))
    found = {r.doc_id: r.score for r in pitmanyor.score(frame(spark, [*train, *held]), F.col("doc_id") < ask).collect()}
    s = np.array([[[10 ** found[ask + 100 * i + 10 * j + n] for n in range(1, 6)] for j in range(6)] for i in range(6)])
    twice = s[:, :, 3] / s[:, :, 1]  # P(v|w) P(w|v), for v = w the square
    assert np.allclose(twice, twice.T, rtol=0.02)
    same = np.sqrt(np.diagonal(twice))
    # from w v: P(w|B) P(v|w) P(E|v), and w: P(w|B) P(E|w); P(v|w) up to a gauge g(w)/g(v), which twice fixes but for one solution
    start = s[:, 0, 0]
    step = s[:, :, 1] / start[None, :]  # P(w|B) P(v|w) / P(v|B)
    base = step * 1.0
    g = np.ones(6)
    for _ in range(2000):  # g = P(w|B): rows of base[w, v] g[v] / g[w] and the end start[w] / g[w] sum to one
        g = 0.5 * g + 0.5 * (base @ g + start)
    p = base * g[None, :] / g[:, None]
    assert np.allclose(p.sum(axis=1) + start / g, 1, atol=1e-6) and np.allclose(np.diagonal(p), same, rtol=0.02)
    assert abs(1 - g.sum() - 10 ** found[9999]) < 1e-6  # what is left is P(E|B)


def test_tables_are_drawn_from_their_conditional():
    """Against all seatings: customers one by one at old tables (n - discount) or a new one (weight)."""
    discount, n = 0.6, 7
    for weight in (0.05, 1.0, 9.0):
        ways = {(): 1.0}
        for _ in range(n):
            step = defaultdict(float)
            for sizes, p in ways.items():
                step[tuple(sorted((*sizes, 1)))] += p * weight
                for k, size in enumerate(sizes):
                    step[tuple(sorted(sizes[:k] + (size + 1,) + sizes[k + 1 :]))] += p * (size - discount)
            ways = step
        total, exact = sum(ways.values()), Counter()
        for sizes, p in ways.items():
            exact[len(sizes)] += p / total
        drawn = pitmanyor.tables(np.full(40_000, n), np.full(40_000, weight), discount, np.arange(40_000))
        share = Counter(drawn.astype(int).tolist())
        assert all(abs(share[t] / 40_000 - exact[t]) < 0.012 for t in range(1, n + 1))
        mean = pitmanyor.tables(np.array([n]), np.array([weight]), discount, None)[0]
        assert abs(mean - sum(t * p for t, p in exact.items())) < 1e-9


def test_tables_of_many_customers_follow_the_predictive_rule():
    r, n, weight, discount = np.random.default_rng(1), 3000, 2.0, 0.5
    t = np.ones(400)
    for i in range(1, n):
        t += r.random(400) < weight / (weight + i - discount * t)
    drawn = pitmanyor.tables(np.full(400, n), np.full(400, weight), discount, np.arange(400))
    assert abs(drawn.mean() - t.mean()) < 1.0 and 0.6 < drawn.std() / t.std() < 1.6
    assert pitmanyor.tables(np.array([10**9]), np.array([1e-6]), discount, np.array([1]))[0] >= 1


def test_language_model_of_odd_rows_and_empty_tables(spark, odd):
    check_scores(odd, 50_000)
    assert pitmanyor.score(odd.limit(0), F.lit(True)).collect() == []
    untaught = pitmanyor.score(odd, F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in untaught} == {(0, 0, 0.0, 0.0)}


# 13 collocations


def brute_collocations(rows, least=30, first=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        gone = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and 100 * a >= 80 * counts[p[i:j]]}
        rows = []
        for p, a in found.items():
            if p not in gone:
                cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
                s, k = min(cuts)
                rows.append((s, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        rows.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(rows[:first])]
    return sorted(out)


def check_collocations(docs, **more):
    chunk = more.pop("chunk", 2_000)
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(docs, chunk=chunk, **more).collect())
    assert got == brute_collocations([(r.lang, r.text) for r in docs.collect()], **more)
    return got


def test_collocations_equal_brute_force_on_the_table(docs):
    assert len(check_collocations(docs, chunk=50_000, least=10)) > 100


def test_collocations_of_few_words_are_cut_to_the_first(spark):
    """Overlaps, repeats and ties among a handful of words; the first few of each language."""
    texts = small_texts(7, ["red", "Red", "fox", "sly", "é"], 150, 40)
    docs = frame(spark, [(i, t, ["en", "fr", None][i % 3]) for i, t in enumerate(texts)])
    assert len(check_collocations(docs, least=5, first=20)) == 60


def test_collocations_of_odd_rows_and_an_empty_table(odd):
    found = check_collocations(odd, least=2)
    assert {x[0] for x in found} >= {"und"}
    assert collocations.collocations(odd.limit(0)).collect() == []
