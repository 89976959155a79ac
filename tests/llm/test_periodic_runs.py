"""Periodic runs against a search of all periods, and the query against plain Python on a whole small table."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_llm_operators import CLASH, documents, sha

from tessera.llm import periodic_runs, queries

WORD = "[^\x20\x09-\x0d]+"


def plain_runs(words, least=24, times=3):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_collapsed(words, runs):
    dropped = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def some_words(rng, most, kinds=(2, 3, 30)):
    out = []
    while len(out) < most:
        if rng.random() < 0.3:
            out += [rng.randrange(3) for _ in range(rng.randint(1, 10))]
        else:
            unit = [rng.randrange(rng.choice(kinds)) for _ in range(rng.choice([rng.randint(1, 12), rng.randint(1, 60)]))]
            if rng.random() < 0.3:
                unit = unit[: rng.randint(1, len(unit))] * rng.randint(2, 5) + unit
            out += (unit * 7)[: int(len(unit) * rng.uniform(1, 6))]
    return out


def test_runs_of_random_sequences():
    rng, total = random.Random(4), 0
    for _ in range(600):
        words = some_words(rng, rng.randint(0, 250))
        want = plain_runs(words)
        total += len(want)
        assert [tuple(r) for r in periodic_runs.runs_of(np.array(words, np.int64), max(1, len(words))).tolist()] == want
    assert total > 1000


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(0, 1), max_size=120), st.sampled_from([(24, 3), (9, 3), (12, 4), (3, 3), (40, 5)]))
def test_runs_of_binary_sequences(words, limits):
    got = periodic_runs.runs_of(np.array(words, np.int64), max(1, len(words)), *limits)
    assert [tuple(r) for r in got.tolist()] == plain_runs(words, *limits)


def test_fibonacci_and_powers():
    a, b = [0], [0, 1]
    while len(b) < 2000:
        a, b = b, b + a
    for words in (b[:1500], [7] * 1000, ([0] * 9 + [1]) * 30, ([0, 0, 1] * 8 + [2]) * 5, list(range(500)) * 3):
        got = periodic_runs.runs_of(np.array(words, np.int64), len(words))
        assert [tuple(r) for r in got.tolist()] == plain_runs(words)


def test_wavelet_tree():
    rng = np.random.default_rng(1)
    values = rng.permutation(300)
    tree = periodic_runs.Wavelet(values)
    lo = rng.integers(0, 300, 500)
    hi = np.minimum(300, lo + rng.integers(1, 200, 500))
    value = rng.integers(0, 700, 500)
    below = tree.below(lo, hi, value)
    for a, b, v, n in zip(lo, hi, value, below, strict=True):
        assert n == (values[a:b] < v).sum()
    k = rng.integers(0, hi - lo)
    for a, b, i, x in zip(lo, hi, k, tree.kth(lo, hi, k), strict=True):
        assert x == np.sort(values[a:b])[i]


ODD = [None, "", " \n ", "a", "a " * 24, "\x0b".join(["x"] * 23), "é b\t" * 12, "a b c " * 9 + "d", " ".join(map(str, range(400))) + " q r" * 40, "z " * 50_000, "a b　c " * 30, "\x1c a b \x85" * 20]


def test_odd_texts(spark):
    rng = random.Random(9)
    texts = ODD + [" ".join(f"w{i}" for i in some_words(rng, 200)) for _ in range(60)] + ODD[3:5]
    found = {r["doc_id"]: r for r in periodic_runs.find_runs(documents(spark, *texts)).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        words = re.findall(WORD, text or "")
        runs = [(0, 50_000, 1)] if i == 9 else plain_runs(words)
        assert [tuple(r) for r in found[i]["runs"]] == runs and found[i]["n_words"] == len(words)
        assert found[i]["collapsed"] == plain_collapsed(words, runs)


def test_odd_rows(spark):
    kinds = "doc_id string, text string, " + ", ".join(f"{c} string" for c in [*CLASH, "runs", "collapsed"])
    rest = ["x"] * (len(CLASH) + 2)
    rows = spark.createDataFrame([(None, "a " * 30, *rest), ("k", None, *rest), ("k", "b " * 30, *rest), ("k", "b " * 30, *rest)], kinds)
    got = sorted((str(r["doc_id"]), r["n_words"], len(r["runs"]), r["collapsed"]) for r in periodic_runs.find_runs(rows).collect())
    assert got == [("None", 30, 1, "a"), ("k", 0, 0, ""), ("k", 30, 1, "b"), ("k", 30, 1, "b")]
    assert periodic_runs.find_runs(rows.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.runs_of(np.zeros(50, np.int64), 50, 24, 2)


def test_periods_of_odd_documents(spark, tmp_path):
    """Documents without words, also those that are to get a periodic tail."""
    chosen = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:12]
    texts = dict(zip(chosen, ["", None, " \n", "one", "a b", "a b c d e f g h " * 40] * 2, strict=True)) | {401: "", 402: None, 403: "x " * 30}
    kinds = "doc_id long, text string, a int, p int, g int, words string"
    spark.createDataFrame([(k, t, 1, 1, 1, "x") for k, t in texts.items()] + [(None, "y " * 30, 1, 1, 1, "x")], kinds).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert set(rows) == {*texts, None}
    for i, t in texts.items():
        words = re.findall(WORD, t or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = words[:a] + [words[a + (j - a) % p] for j in range(a, n)]
        runs = plain_runs(words)
        assert rows[i]["n_runs"] == len(runs) and rows[i]["collapsed_sha256"] == sha(plain_collapsed(words, runs))
    assert (rows[None]["n_runs"], rows[None]["period"]) == (1, 1) and rows[401]["runs_sha256"] == sha("") and rows[401]["start"] is None


def test_query_on_a_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    found = {r["doc_id"]: r.asDict() for r in queries.op11_periodic_runs(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(found) == len(docs)
    planted = 0
    for d in docs:
        words = re.findall(WORD, d["text"] or "")
        h = zlib.crc32(str(d["doc_id"]).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if n > 3000:
            continue  # the plain search is quadratic; the tests above have long texts
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        want = {
            "n_runs": len(runs), "start": best and best[0], "length": best and best[1], "period": best and best[2], "exponent_milli": best and 1000 * best[1] // best[2],
            "runs_sha256": sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), "collapsed_sha256": sha(plain_collapsed(words, runs)),
        }
        planted += h % 10 == 0 and bool(runs)
        assert {k: v for k, v in found[d["doc_id"]].items() if k != "doc_id"} == want
    assert planted > 5 and hashlib.sha256(b"").hexdigest() == sha("")
