"""The ten operators against brute force, libraries and round trips, with nulls, empty and long texts, repeats and ties."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import _words, bpe, chat_format, components, decontaminate, jaccard_join, language_id, secrets, substring_dedup, transport_stream, url_filter

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD = "[^\x20\x09-\x0d]+"
#: Columns that nothing should read, named like those the operators use themselves.
CLASH = ["key", "n", "node", "row", "spans", "body", "token", "lang_pred", "redacted"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(spark, *texts, ids=None):
    rows = [(i, t, *["x"] * len(CLASH)) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {c} string" for c in CLASH)).repartition(3)


def got(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r))


ODD = [None, "", " ", "a", "<|endoftext|>", "x<|endoftext|>\n\n y  ", "é" * 50, "日本 語🎉", "a" * 9000, "\u0000\u00a0\u3000 z", "don't  'll\t1234 ..!!", "word " * 3000]


# 2 and 4


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_token_counts(spark, library):
    found = got(bpe.token_counts(documents(spark, *ODD), VOCABULARY, limit=5))
    for i, (_, n_bytes, n, over) in enumerate(found):
        want = len(library.encode(ODD[i] or "", add_special_tokens=False).ids)
        assert (n_bytes, n, over) == (len((ODD[i] or "").encode()), want, want > 5)


def test_encode_decode(spark, library):
    found = got(bpe.encode_decode(documents(spark, *ODD), VOCABULARY))
    for i, (_, n, ids, decoded) in enumerate(found):
        want = library.encode(ODD[i] or "", add_special_tokens=False).ids
        assert ids == want and n == len(want) and decoded == library.decode(want, skip_special_tokens=False)
    digest = got(bpe.encode_decode(documents(spark, *ODD), VOCABULARY, digest=True))
    assert [r[3] for r in digest] == [sha(r[3]) for r in found]
    assert [r[2] for r in digest] == [hashlib.sha256(np.array(r[2], "<u4").tobytes()).hexdigest() for r in found]
    carried = bpe.encode_decode(documents(spark, "a", None, ids=[1, None]), VOCABULARY, carry=True).select("row.*")
    assert carried.columns == ["doc_id", "text", *CLASH] and carried.count() == 2


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_words_encode_as_the_library_does(library, text):
    coder = bpe.load(VOCABULARY)
    want = library.encode(text, add_special_tokens=False).ids
    packed = bpe.encode_ids(coder, bpe._Memo(coder.encode_words), [text])[0]
    assert np.frombuffer(packed, "<u4").tolist() == want


def test_latin_texts_need_no_search_for_newer_characters(library):
    model = bpe.load(VOCABULARY)
    assert model.new_is_far and bpe.is_latin("née ÿ") and not bpe.is_latin("né\u0100")
    newer = chr(int(bpe.newer_characters()[2:10], 16))
    for text in (f"Größe {newer}a é", "Größe é à la", f"{newer}", "日本é"):
        packed = bpe.encode_ids(model, bpe._Memo(model.encode_words), [text])[0]
        assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_merging_forms_agree():
    coder = bpe.load(VOCABULARY)
    draw = random.Random(3)
    words = ["".join(draw.choices("abeinortx01", k=draw.randint(1, 60))).encode() for _ in range(300)] + [b"a" * 77, b"ababab" * 9]
    sym, n = coder.merge(*coder.symbols(words))
    cuts = np.append(0, np.cumsum(n))
    whole = [sym[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)]
    assert whole == [coder.merge_long(coder.symbols([w])[0]) for w in words]
    assert whole == [np.frombuffer(p, "<u4").tolist() for p in coder.encode_words(words)]


def test_pairs_are_told_exactly():
    coder = bpe.load(VOCABULARY)
    draw = random.Random(5)
    common = [i for i in range(256, 3000)]
    a, b = np.array(draw.choices(common, k=3000)), np.array(draw.choices(common, k=3000))
    want = [coder.merge_long(coder.symbols([coder.bytes_of[x] + coder.bytes_of[y]])[0]) == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert coder.compatible(a, b).tolist() == want


# 1


def test_hosts_and_rules(spark):
    rules = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
    cases = {
        "http://A.Example.NET/en/x?q": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "https://example.net/de/#top": ("example.net", "/de/", "net/", "block"),
        "https://example.net": ("example.net", "", None, "allow"),
        "https://example.net?x=/en/": ("example.net", "", None, "allow"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "http://m.example.com/de/a://b/": ("m.example.com", "/de/a://b/", "example.com/de/", "block"),
        "no scheme": ("", "", None, "allow"),
        "http://É.org/fr/": ("É.org", "/fr/", "org/fr/", "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = url_filter.filter_urls(pages, labels, rules).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in found] == list(cases.values())
    assert url_filter.filter_urls(pages.limit(0), labels, rules).count() == 0
    with pytest.raises(ValueError):
        url_filter.matching_rule(F.col("h"), F.col("p"), [("block", f"h{i}/") for i in range(501)])


def test_reputation_blocks_bad_hosts(spark):
    rows = [(i, f"http://{h}/p{i}") for i, h in enumerate(["bad.a.com"] * 60 + ["good.a.com"] * 60 + ["new.a.com"] * 2 + ["good.b.org"] * 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if "bad" in u else 1, None) for i, u in rows if "new" not in u] + [(None, 0, 1), (0, None, None)], "doc_id long, quality int, toxic int")
    found = {r["host"]: (r["verdict"], r["bad_mean"], r["bad_bound"]) for r in url_filter.filter_urls(pages, labels).collect()}
    assert {h: v for h, (v, *_) in found.items()} == {"bad.a.com": "block", "good.a.com": "allow", "new.a.com": "allow", "good.b.org": "allow"}
    assert found["good.a.com"][1] < found["new.a.com"][1] < found["bad.a.com"][1] and all(b <= m for _, m, b in found.values())


def test_domains(spark):
    cases = {
        "a.b.example.com": ("com", "example.com"), "com": ("com", "com"), "x.y.co.uk": ("co.uk", "y.co.uk"), "co.uk": ("co.uk", "co.uk"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"),
        "[::1]": ("[::1]", "[::1]"), "": ("", ""), "a.b.sch.uk": ("b.sch.uk", "a.b.sch.uk"), "1.2.3.com": ("com", "3.com"), "." * 3000 + "org": ("org", ".org"),
    }
    names = spark.createDataFrame([(h,) for h in cases], "name string")
    suffixes = spark.createDataFrame([("co.uk",), ("b.sch.uk",), ("co.uk",), (None,)], "suffix string")
    found = {r["name"]: (r["suffix"], r["domain"]) for r in url_filter.with_domains(names, suffixes).collect()}
    assert found == cases
    ports = spark.createDataFrame([("u@a.com:8080",), ("a.com:",), ("[::1]:80",)], "h string").select(url_filter.name_of(F.col("h")))
    assert [r[0] for r in ports.collect()] == ["a.com", "a.com", "[::1]"]


def test_odd_pages(spark):
    """Repeated pages and labels, null keys, columns with clashing names, a very long URL."""
    long = "http://a.com/" + "x" * 100_000
    rows = [(1, "http://a.com:80/1"), (1, "http://a.com:80/1"), (2, long), (None, "http://a.com/2"), (3, "http://b.com/")]
    pages = spark.createDataFrame([(*r, "z", 5, "y") for r in rows], "page_id long, url string, host string, n int, name string")
    labels = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (2, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    found = url_filter.filter_urls(pages, labels, [("block", "b.com/")]).collect()
    assert len(found) == 5 and {r["verdict"] for r in found if r["host"] == "b.com"} == {"block"}
    a = [r for r in found if r["host"] != "b.com"]
    assert len({r["bad_mean"] for r in a}) == 1 and {len(r["path"]) for r in a} == {2, 100_001}


# 3


def test_base_patterns():
    text = "API_KEY: 'abcdefgh' passwd=short token=token:abcdefgh1 AKIAABCDEFGHIJKL AKIA12 " + "0f" * 16 + "g" + "a" * 31
    spans = [(k, text[a:b]) for a, b, k in secrets.base_spans(text)]
    assert spans == [("assign", "API_KEY: 'abcdefgh"), ("access", "AKIAABCDEFGHIJKL"), ("hex", "0f" * 16)]
    assert secrets.base_spans("ſecret=abcdefgh") == [] and secrets.base_spans("to\u212aen=abcdefgh") == []


def slow_spans(text):
    out = []
    for k, p, least in (("assign", secrets.ASSIGN, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 16), ("hex", re.compile("[0-9a-f]+"), 32)):
        out += [(m.start(), secrets.KINDS.index(k), m.end()) for m in p.finditer(text) if (len(m[2]) if k == "assign" else len(m[0])) >= least]
    return [(a, e, secrets.KINDS[k]) for a, k, e in sorted(out)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["AKIA", "token", "=", ":", " ", "a1b2c3d4", "ABCD1234", "é", "'", '"', "0" * 20, "secret", "\n"]), max_size=25))
def test_base_spans_agree(parts):
    assert secrets.base_spans("".join(parts)) == slow_spans("".join(parts))


def test_models_tell_random_strings(spark):
    draw = random.Random(1)
    words = ["configuration", "recommendation", "understanding", "information", "international", "responsibility"]
    prose = [" ".join(draw.choices(words, k=40)) + f" token={draw.getrandbits(80):x}" for _ in range(60)]
    model = secrets.train(documents(spark, *prose, None))
    key = "zX9qLw0PvB7nT4kJ2mYc8RgD"
    texts = [f"see {key} here", "informationrecommendationunderstanding", None, "", f"token={key}"]
    found = got(secrets.scan(documents(spark, *texts), model))
    assert found[0][6] == f"random:4:{4 + len(key)}" and found[0][5] == sha("") and found[0][7] == "see [SECRET] here"
    assert found[1][6] == "" and found[2][1:5] == (0, 0, 0, 0)
    assert found[4][6] == f"assign:0:{6 + len(key)}"
    assert secrets.scan(documents(spark, "a").limit(0), model).count() == 0


def test_nested_spans_train_nothing_ordinary():
    text = "token=" + "0f" * 16 + "Zq9XkP2m ordinary words here"
    spans = secrets.base_spans(text)
    assert [s[2] for s in spans] == ["assign", "hex"] and secrets.apart(spans) == [(0, 46)]
    assert secrets.redacted(text, spans) == "[SECRET] ordinary words here"


def slow_model(random_strings, ordinary_strings):
    """Log-likelihood ratios of character pairs by plain counting, backed by single characters."""
    size = len(secrets.ALPHABET) + 1

    def log(strings):
        pairs, single, before = Counter(), Counter(), Counter()
        for s in strings:
            for x, y in zip(["start", *s], s, strict=False):
                pairs[x, y] += 1
                single[y] += 1
                before[x] += 1
        total = sum(single.values()) + 0.5 * size
        return lambda x, y: np.log((pairs[x, y] + 8.0 * (single[y] + 0.5) / total) / (before[x] + 8.0))

    one, two = log(random_strings), log(ordinary_strings)
    return lambda s: sum(one(x, y) - two(x, y) for x, y in zip(["start", *s], s, strict=False)) / len(s)


def test_scan_against_plain_models(spark):
    draw = random.Random(9)
    words = ["configuration", "recommendation", "understanding", "snake_case_name", "international", "path/to/some/file"]
    make = lambda: " ".join(draw.choices(words, k=12) + ["".join(draw.choices(secrets.ALPHABET, k=draw.randint(18, 40)))] + draw.choices(["token=a1b2c3d4e5f60718293a", "f0" * 17, "secret: " + "ab" * 20], k=1))
    texts = [make() for _ in range(40)] + [None, "", "x" * 200_000, make() * 200]
    docs = documents(spark, *texts, texts[0], ids=[*range(len(texts)), 0])
    model = secrets.train(docs, sample=10**9)
    random_strings, ordinary = secrets.drawn_strings(), []
    for t in [*texts, texts[0]]:
        spans = secrets.apart(secrets.base_spans(t or ""))
        random_strings += [r for a, b in spans for r in secrets.ORDINARY.findall(t[a:b]) if len(r) >= 16]
        ends = [0, *(x for span in spans for x in span), len(t or "")]
        ordinary += [r for a, b in zip(ends[::2], ends[1::2], strict=True) for r in secrets.ORDINARY.findall((t or "")[a:b])]
    score = slow_model(random_strings, ordinary)
    for r in secrets.scan(docs, model).collect():
        t = texts[r["doc_id"]] or ""
        base = slow_spans(t)
        want = [(a, k, b) for a, b, k in base] + [(m.start(), "random", m.end()) for m in secrets.RUN.finditer(t) if not any(a < m.end() and m.start() < b for a, b, _ in base) and score(m[0]) > 1.0]
        want = sorted(want, key=lambda x: (x[0], secrets.KINDS.index(x[1])))
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for a, k, b in want)
    assert secrets.train(docs.limit(0)).score("abc") != 0


# 5


def brute_components(texts, size, part, whole):
    sets = {}
    for k, t in texts:
        words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())
    comp = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and comp[a] != comp[b]:
                    common = len(sets[a] & sets[b])
                    if common and whole * common >= part * (len(sets[a]) + len(sets[b]) - common):
                        low, high = sorted((comp[a], comp[b]))
                        comp = {k: low if v == high else v for k, v in comp.items()}
                        changed = True
    return sorted((k, len(s), comp[k]) for k, s in sets.items())


def near_copies(seed=2, groups=6, copies=14, length=60):
    draw = random.Random(seed)
    texts = []
    passage = " ".join(draw.choices("uvwxyz", k=30))
    for g in range(groups):
        base = [f"w{draw.randint(0, 40)}" for _ in range(length)]
        for c in range(copies):
            words = list(base)
            for _ in range(c % 5):
                words[draw.randrange(length)] = f"edit{g}x{c}"
            texts.append(" ".join(words).upper() if c == 3 else " ".join(words))
        texts.append(passage + " " + " ".join(f"own{g}n{i}" for i in range(20)))
    return texts + [texts[0], "one two", "one two", "One  TWO", "three", None, "", "  "]


@pytest.mark.parametrize("size, threshold", [(4, (85, 100)), (5, (80, 100)), (3, (50, 100))])
def test_jaccard_components(spark, size, threshold):
    texts = list(enumerate(near_copies()))
    want = brute_components(texts, size, *threshold)
    assert got(jaccard_join.near_duplicates(documents(spark, *(t for _, t in texts)), size, threshold)) == want
    assert sum(c != k for k, _, c in want) > 20


def test_jaccard_links_are_all_there(spark):
    texts = list(enumerate(near_copies(groups=3)))
    members, links = jaccard_join.join_documents(documents(spark, *(t for _, t in texts)), 4, (85, 100), all_links=True)
    node = {r["doc"]: r["node"] for r in members.collect()}
    sets = {k: {tuple(w[i : i + 4]) for i in range(len(w) - 3)} for k, t in texts if len(w := re.findall(WORD, (t or "").lower())) >= 4}
    want = {tuple(sorted((node[a], node[b]))) for a in sets for b in sets if node[a] != node[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert {tuple(sorted((r["a"], r["b"]))) for r in links.collect()} == want and want


def test_results_do_not_depend_on_filters(spark, monkeypatch):
    texts, passages = list(enumerate(near_copies(groups=3))), repeated_passages()
    monkeypatch.setattr("tessera.llm._filter.MOST_BITS", 8)
    assert got(jaccard_join.near_duplicates(documents(spark, *(t for _, t in texts)))) == brute_components(texts, 5, 80, 100)
    assert got(substring_dedup.remove_repeats(documents(spark, *(t for _, t in passages)), keep_text=False)) == brute_removal(passages, 50)


@pytest.mark.parametrize("most", [1, 12])
def test_heavy_classes_and_components(spark, monkeypatch, most):
    """Large classes and components, by either join or by both, get the same names."""
    texts = list(enumerate(near_copies(groups=3) + ["a b c d e f"] * 60))
    monkeypatch.setattr("tessera.llm.components.MOST_HEAVY", most)
    assert got(jaccard_join.near_duplicates(documents(spark, *(t for _, t in texts)))) == brute_components(texts, 5, 80, 100)


def test_jaccard_odd_rows(spark):
    docs = documents(spark, "a b c d e", "a b c d e", "a b c d e", None, ids=[7, 7, None, None])
    assert got(jaccard_join.near_duplicates(docs)) == [(None, 0, None), (None, 1, None), (7, 1, 7), (7, 1, 7)]
    assert jaccard_join.near_duplicates(docs.limit(0)).count() == 0


def test_families_are_joined_by_one_pair(spark):
    """Two families of near copies whose leaders aren't linked, but one pair of other members is: they are one component.

    That is why members of different components in a list are compared with each other, not with leaders alone.
    """
    words = [f"w{i}" for i in range(400)]
    left = [words[:100] + [f"a{k}"] for k in range(6)]
    right = [words[16:116] + [f"b{k}"] for k in range(6)]
    bridge = [words[8:108] + ["c"]]
    texts = [" ".join(w) for w in left + right]
    one = {r[2] for r in got(jaccard_join.near_duplicates(documents(spark, *texts), size=1, threshold=(80, 100)))}
    both = {r[2] for r in got(jaccard_join.near_duplicates(documents(spark, *texts, " ".join(bridge[0])), size=1, threshold=(80, 100)))}
    assert one == {0, 6} and both == {0}


def test_pairs_come_from_few_of_the_lists_they_meet_in(spark):
    """Of 60 tokens that near copies share, each pair of different components is found, and is about one row of the join."""
    rng = np.random.default_rng(4)
    tokens = {f"n{k:02}": {int(t) for t in range(60) if rng.random() < 0.9} | {1000 + k} for k in range(40)} | {"far": {59, 70, 71}, "none": {80}}
    comp = lambda node: node if node in ("n00", "n07", "far", "none") else "main"
    rows = [(t, node, 100, 0, 0, 0, 0, comp(node), "main") for node, held in tokens.items() for t in held]
    every = spark.createDataFrame(rows, "token long, node string, n int, p0 long, p1 long, p2 long, p3 long, comp string, main string")
    found = [tuple(r) for r in jaccard_join._meeting(every, (80, 100)).collect()]
    want = {(a, b) for a in tokens for b in tokens if a < b and comp(a) != comp(b) and tokens[a] & tokens[b]}
    assert set(found) == want and len(found) < 1.1 * len(want)


def test_common_shingles_are_one_entry_a_chunk():
    """However many documents of a chunk have a shingle, its bucket gets it once, and counts stay exact."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    common = np.uint64(0x123456789ABCDEF0)
    for n in (1, 10, 300):
        chunks, sets = [], []
        for number in range(4):
            own = [np.unique(np.append(rng.integers(0, 2**63, 6).astype(np.uint64) % np.uint64(40) << np.uint64(32), common)) for _ in range(n)]
            chunks.append(jaccard_join._chunk(number << 32, 3, pa.array(range(n)), own))
            sets += own
        rows = pa.Table.from_batches(chunks)
        count = {}
        for s in sets:
            for x in s.tolist():
                count[x >> 32] = count.get(x >> 32, 0) + 1
        back = []
        for bucket in sorted(set(rows["bucket"].to_pylist())):
            held = rows.filter(pa.compute.equal(rows["bucket"], bucket))
            if bucket >= 0:
                every = [np.frombuffer(x, np.uint32) for c in ("low", "shared") for x in held[c].to_pylist()]
                assert sum((x == (int(common) & 0xFFFFFFFF)).sum() for x in every) <= 4
                assert sum(map(len, every)) <= 4 * 41
            else:
                assert held.num_rows == 1
            back.append(jaccard_join._count((pa.scalar(bucket),), held))
        back = pa.concat_tables(back)
        for r in back.filter(pa.compute.is_null(back["head"])).to_pylist():
            for ids, totals in ((r["low"], r["n"]), (r["shared"], r["m"])):
                assert all(t > 1 for t in np.frombuffer(totals, np.uint32))
        for number in range(4):
            held = back.filter(pa.compute.equal(back["chunk"], number << 32))
            out = jaccard_join._prefixes((85, 100))(None, held)
            assert out.num_rows == n and out["n"].to_pylist() == list(map(len, sets[number * n : number * n + n]))


def test_prefixes_share_enough():
    draw = np.random.default_rng(1)

    def prefix(s):
        n = 1 + (s % np.uint64(7)).astype(np.int64) ** 2  # any counts that all documents see alike
        order = np.lexsort((s, n))
        shared = order[n[order] > 1]
        taken, matches = jaccard_join.choose_prefix(n[shared], len(s), len(s), (85, 100))
        # Rare shingles come first, of which the pair may share some here.
        return np.append(s[order[: len(s) - len(shared)]], s[shared[:taken]]), matches

    for _ in range(200):
        base = np.unique(draw.integers(0, 2**63, 80).astype(np.uint64))
        other = np.unique(np.append(base[draw.random(len(base)) > 0.08], draw.integers(0, 2**63, 3).astype(np.uint64)))
        common = len(np.intersect1d(base, other))
        if 100 * common < 85 * (len(base) + len(other) - common):
            continue
        (x, lx), (y, ly) = map(prefix, (base, other))
        assert len(np.intersect1d(x, y)) >= min(lx, ly)


def test_bitmaps_bound_differences():
    draw = np.random.default_rng(2)
    for n, m in ((5, 400), (300, 280), (1000, 1100)):
        a, b = (np.unique(draw.integers(0, 2**40, k).astype(np.uint64)) for k in (n, m))
        x, y = jaccard_join._parity(a), jaccard_join._parity(b)
        size = min(len(x), len(y))
        differ = np.bitwise_count(jaccard_join._folded(x, size) ^ jaccard_join._folded(y, size)).sum()
        assert differ <= len(np.setxor1d(a, b))


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (300, 300)]
    found = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == dict.fromkeys(range(41), 0) | {100: 100, 200: 100, 150: 100, 300: 300}


# 6


def test_decontamination(spark):
    item = "One two THREE four five six seven eight nine ten eleven"
    benchmark = [(10, item), (9, "tiny item"), (2, "short-item, here!"), (3, None), (4, "..."), (10, item), (5, "solo")]
    texts = [item, "x " + " ".join(item.split()[:10]) + " y", " ".join(item.split()[:9]), "tiny  ITEM tiny item", None, "", "short item here " * 3, "été solo solo", "a " * 3000 + item]
    table = spark.createDataFrame(benchmark, "item_id long, text string")

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    want = []
    for k, t in enumerate(texts):
        w, hit, items = words(t), set(), set()
        for name, said in benchmark:
            p = words(said)
            size = min(10, len(p))
            for i in range(len(p) - size + 1 if size else 0):
                for j in range(len(w) - size + 1):
                    if w[j : j + size] == p[i : i + size]:
                        hit |= set(range(j, j + size))
                        items.add(str(name))
        want.append((k, len(w), len(hit), len(items), sorted(items), sha(",".join(sorted(items))), bool(hit)))
    for most in (1 << 20, 60):
        assert got(decontaminate.find_contamination(documents(spark, *texts), table, pass_bytes=most)) == want
        carried = decontaminate.find_contamination(documents(spark, *texts), table, pass_bytes=most, carry=True)
        assert got(carried.drop("row")) == want and got(carried.select("row.doc_id", "row.text")) == list(enumerate(texts))
    assert all(not r[-1] for r in got(decontaminate.find_contamination(documents(spark, *texts), table.limit(0))))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=6), max_size=5))
def test_wu_manber_finds_all(words, patterns):
    words = [w.encode() for w in words]
    for a in decontaminate.searchers([x for i, p in enumerate(patterns) for x in decontaminate.pieces(str(i), " ".join(p), 4, 5)]):
        found = {(i, n) for i, items in a.search(words) for n in items}
        want = set()
        for n, p in enumerate(patterns):
            p = [w.encode() for w in p]
            size = min(4, len(p))
            if size == a.length:
                windows = [p[i : i + size] for i in range(len(p) - size + 1)]
                want |= {(i, str(n)) for i in range(len(words) - size + 1) if words[i : i + size] in windows}
        assert found == want


# 7


def test_chats_round_trip(spark):
    mark = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", mark), (1, 1, "assistant", "a\\b<s>[x]"), (1, 70, "assistant", None), (2, None, None, "odd"), (2, 5, "a]<b", ""), (3, 1, "user", "same"), (3, 1, "user", "same")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(chat_format.to_events(conv))
    back = {r["conv_id"]: r for r in out.withColumn("turns", chat_format.parse(F.col("formatted"))).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [("user", mark), ("assistant", "a\\b<s>[x]"), ("assistant", "")]
    assert [tuple(t) for t in back[2]["turns"]] == [("", "odd"), ("a]<b", "")]
    assert [tuple(t) for t in back[3]["turns"]] == [("user", "same")] * 2
    shown = back[1]["formatted"]
    assert shown.count("[INST]") == 3 and shown.count("</s>") == 3
    assert [shown[s["start"] : s["end"]] for s in back[1]["loss_spans"]] == ["a\\\\b<\\s>[\\x]", ""]
    assert chat_format.format_chats(chat_format.to_events(conv.limit(0))).count() == 0


def slow_fold(events):
    """The log applied one event at a time."""
    messages, role, born = {}, {}, {}
    for _, turn, part, seq, event, who, text in sorted(events, key=lambda e: (e[3] is not None, e[3] or 0, e[4], e[6] or "")):
        m, text = (turn, part), text or ""
        if event == "open":
            messages[m], role[m], born[m] = text, who or "", seq
        elif event == "delta":
            messages[m] = messages.get(m, "") + text
        elif event == "edit":
            messages[m] = text
        elif event == "regenerate":
            messages[m] = text
            for other in [o for o in messages if o[0] > turn and o in born and (born[o] is None or born[o] < seq)]:
                del messages[other], born[other]
        elif event == "delete":
            messages.pop(m, None)
    return sorted((turn, role.get((turn, part), ""), text) for (turn, part), text in messages.items())


EVENTS = "conv_id long, turn long, part int, seq int, event string, role string, text string"


def folded(spark, rows):
    found = chat_format.fold_events(spark.createDataFrame(rows, EVENTS).repartition(3)).collect()
    return sorted((r["turn"], r["role"], r["text"]) for r in found)


def test_events_fold(spark):
    log = [
        (0, "open", 0, "assistant", None), (0, "delta", 1, None, "dra"), (0, "delta", 2, None, "ft"), (1, "open", 3, "user", "first"), (1, "edit", 4, None, "second"), (1, "delta", 5, None, "!"),
        (2, "open", 6, "user", "x"), (2, "delete", 7, None, None), (200, "open", 8, "user", "why?"), (3, "delta", 9, None, "stray"),
    ]
    rows = [(1, turn, 0, seq, event, role, text) for turn, event, seq, role, text in log]
    assert folded(spark, rows) == slow_fold(rows) == [(0, "assistant", "draft"), (1, "user", "second!"), (3, "", "stray"), (200, "user", "why?")]
    # A regeneration takes away the later turns opened before it, near and far, not those opened after it.
    rows += [(1, 0, 0, 10, "regenerate", None, None), (1, 0, 0, 11, "delta", None, "fin"), (1, 0, 0, 12, "delta", None, "al"), (1, 5, 0, 13, "open", "user", "new")]
    assert folded(spark, rows) == slow_fold(rows) == [(0, "assistant", "final"), (3, "", "stray"), (5, "user", "new")]


def test_events_out_of_order_or_without_seq(spark):
    rows = [(None, 0, 0, None, "delta", None, "b"), (None, 0, 0, 1, "delta", None, "c"), (None, 0, 0, None, "delta", None, "a"), (None, 0, 0, 1, "delta", None, "d")]
    assert folded(spark, rows) == slow_fold(rows) == [(0, "", "abcd")]
    rows += [(None, 0, 0, None, "open", "user", "text ")]  # the last without seq, so only what has one comes after it
    assert folded(spark, rows) == slow_fold(rows) == [(0, "user", "text cd")]
    chats = chat_format.format_chats(spark.createDataFrame(rows, EVENTS)).collect()
    assert [(r["conv_id"], r["formatted"]) for r in chats] == [(None, "<s>[INST] user [/INST]text cd</s>")]


def test_long_conversation_folds_as_one(spark):
    draw = random.Random(8)
    rows = []
    for seq in range(1500):
        turn = draw.randint(0, 400)
        event = draw.choice(["open", "open", "delta", "delta", "delta", "edit", "delete", "regenerate"] if seq < 1200 else ["open", "delta"])
        rows.append((7, turn, draw.randint(0, 1), seq, event, "user", f"{seq} "))
    # What a message held before it was taken away doesn't come back with later deltas: such messages are left out here.
    opened = {(t, p) for _, t, p, s, e, *_ in rows if e == "open" and s >= 1200}
    rows = [r for r in rows if (r[1], r[2]) in opened or r[4] == "regenerate"]
    late = {(t, p): max(s for _, a, b, s, e, *_ in rows if (a, b) == (t, p) and e == "open") for t, p in opened}
    want = [m for m in slow_fold(rows) if any(m[0] == t for t, _ in late)]
    assert [m for m in folded(spark, rows) if m[0] in {t for t, _ in late}] == want and len(want) > 50


def test_logs_have_all_events(spark):
    conv = spark.createDataFrame([(1, 0, "user", "ask"), (1, 1, "assistant", "answer"), (1, 2, "user", "more")], "conv_id long, turn long, role string, text string")
    log = chat_format.to_events(conv)
    assert {r["event"] for r in log.select("event").collect()} == {"open", "delta", "edit", "regenerate", "delete"}
    assert got(chat_format.fold_events(log).select("turn", "role", "text"), "turn") == [(0, "user", "ask"), (1, "assistant", "answer"), (2, "user", "more")]


# 8


def test_language_is_learned(spark):
    draw = random.Random(4)
    sounds = {"aa": "the and ing tion er", "bb": "der ung sch ein ich", "cc": "ción dad mente los que"}
    rows = [(i, " ".join(draw.choices(sounds[lang].split(), k=draw.randint(10, 120))), lang) for i, lang in enumerate(draw.choices(list(sounds), k=400))]
    docs = spark.createDataFrame(rows + [(1000, None, "aa"), (1001, "12 !", "bb"), (1002, "", None), (None, "the and ing", None)], "doc_id long, text string, lang string").repartition(3)
    network = language_id.fit(docs, per_label=100)
    assert network.labels == ["aa", "bb", "cc"]
    found = {r["doc_id"]: r for r in language_id.predict(docs, network).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i]["held_out"] for i, _ in held) and sum(found[i]["lang_pred"] == lang for i, lang in held) / len(held) > 0.97
    assert [found[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and found[None]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in found.values())
    none = language_id.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(docs, none).collect()} == {"und"}


@pytest.mark.parametrize("n", [0, 1, 3, 4, 127, 128, 129, 253, 254, 5000])
def test_windows_cover_texts(n):
    data = np.arange(1, n + 1, dtype=np.int64).astype(np.uint8)
    held = language_id.windows(data)
    step = language_id.LENGTH - 3
    assert held.shape[1] == language_id.LENGTH and (len(held) - 1) * step + language_id.LENGTH >= n
    grams = Counter(bytes(data[i : i + 4]) for i in range(n - 3))
    assert set(grams) <= {bytes(w[i : i + 4]) for w in held for i in range(language_id.LENGTH - 3)}


def test_labelled_text_without_letters_is_unknown():
    assert not language_id.has_letter("²½_12") and language_id.has_letter("1ж")


def test_network_against_plain_convolution():
    """The pair tables against embedding, filters, pooling and softmax one place at a time."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (5, language_id.LENGTH)).astype(np.uint8)
    network = language_id.train(rng.integers(97, 110, (300, language_id.LENGTH)).astype(np.uint8), rng.integers(0, 3, 300), ["a", "b", "c"], epochs=1)
    found = network.probabilities(x, network.tables())
    for w, p in zip(x, found, strict=True):
        hidden = []
        for width, f, b in zip(language_id.WIDTHS, network.filters, network.bias, strict=True):
            span = language_id.LENGTH - 1 if width == 2 else language_id.LENGTH - 3
            sums = [[sum(network.embed[w[at + j]] @ f[j][:, c] for j in range(width)) for at in range(span)] for c in range(f.shape[2])]
            hidden += [max(0.0, max(s) + b[c]) for c, s in enumerate(sums)]
        z = np.exp(np.array(hidden) @ network.out + network.out_bias)
        assert np.allclose(z / z.sum(), p, atol=1e-5)


def test_language_odd_rows(spark):
    """Repeated rows, clashing columns, a very long text; equal rows train once."""
    rows = [(i, f"the and ing {i}" if i % 2 else f"der ung sch {i}", "aa" if i % 2 else "bb") for i in range(60)] + [(7, "the and ing 7", "aa")] * 300 + [(500, "der ung sch " * 60_000, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, lang_pred string, score int").repartition(3)
    found = language_id.predict(docs, language_id.fit(docs, per_label=20)).collect()
    assert len(found) == len(rows) and len({tuple(r) for r in found if r["doc_id"] == 7}) == 1
    assert next(r for r in found if r["doc_id"] == 500)["lang_pred"] == "bb"
    with pytest.raises(ValueError):
        language_id.fit(spark.range(1001).selectExpr("id + 1000000 as doc_id", "'a' as text", "id as lang").filter("crc32(cast(doc_id as string)) % 5 <> 0").union(spark.range(2000, 4000).selectExpr("id", "'a'", "id")))


# 9


def test_media_round_trip(spark):
    texts = [None, "", "a", "b" * 576, "c" * 577, "é" * 5000, "b" * 576]
    found = {r["doc_id"]: r for r in transport_stream.media_column(documents(spark, *texts)).collect()}
    for k, t in enumerate(texts):
        r, data = found[k], (t or "").encode()
        want = data + b"\xff" * (-len(data) % 576 if data else 576)
        s = transport_stream.demux(bytes(r["media"]))
        assert s.payload == want and s.continuity_errors == 0 and r["payload_sha256"] == hashlib.sha256(want).hexdigest()
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), len(want), zlib.crc32(want[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(r["media"]).hexdigest())
        assert r["stamps"] == [i * 25920 for i in range(-(-len(want) // 2304))] and len(r["access_points"]) == -(-len(r["stamps"]) // 4)
    assert found[3]["feature"] == found[6]["feature"]


def test_streams_are_checked():
    whole = transport_stream.mux(bytes(range(256)) * 36)
    packets = [whole[i : i + 188] for i in range(0, len(whole), 188)]
    assert transport_stream.demux(b"".join(packets[:5] + packets[4:5] + packets[5:])).payload == bytes(range(256)) * 36
    lost = transport_stream.demux(b"".join(packets[:5] + packets[6:]))
    assert lost.continuity_errors == 1 and len(lost.payload) < 9216
    assert transport_stream.demux(whole).programs == {1: {0x100: 6}}
    for broken in (b"", whole[:-1], b"\x00" + whole[1:], b"".join(packets[2:])):
        with pytest.raises(ValueError):
            transport_stream.demux(broken)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40))
def test_any_number_of_frames(n):
    data = random.Random(n).randbytes(576 * n)
    assert transport_stream.demux(transport_stream.mux(data)).payload == data


# 10


def brute_removal(texts, window):
    words = [(k, re.findall(WORD, t or "")) for k, t in texts]
    first = {}
    for k, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, k), k)
    out = []
    for k, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < k:
                gone |= set(range(i, i + window))
        out.append((k, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out)


def repeated_passages(seed=6):
    draw = random.Random(seed)
    new = lambda n: [f"{draw.choice('abcdef')}{draw.randint(0, 500)}" for _ in range(n)]
    passages = [new(n) for n in (49, 50, 51, 80, 140)]
    texts = []
    for _ in range(60):
        words = new(draw.randint(0, 60))
        for p in draw.sample(passages, draw.randint(0, 3)):
            cut = draw.randint(0, 10) if draw.random() < 0.4 else 0
            words += p[cut : len(p) - (draw.randint(0, 10) if draw.random() < 0.4 else 0)] + new(draw.randint(0, 30))
        texts.append("  ".join(words) + draw.choice(["", "\n", "\u00a0x"]))
    texts += texts[:5] + ["z " * 300, "z " * 120, " ".join(new(70)) * 1, None, "", "   "]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("window, gram", [(50, 20), (30, 10), (12, 12), (5, 1)])
def test_repeats_are_removed(spark, window, gram):
    texts = repeated_passages()
    found = got(substring_dedup.remove_repeats(documents(spark, *(t for _, t in texts)), window, gram, keep_text=False))
    want = brute_removal(texts, window)
    assert found == want and sum(r[2] for r in want) > 500


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abc"), max_size=40), st.integers(1, 5))
def test_seeds_are_extended(words, others, window):
    words, others = ([w.encode() for w in x] for x in (words, others))
    shared = {tuple(others[i : i + window]) for i in range(len(others) - window + 1)}
    starts = [i for i in range(len(words) - window + 1) if tuple(words[i : i + window]) in shared]
    covered = lambda spans: {k for a, b in spans for k in range(a, b)}
    seeds = [(i, i + window) for i in starts]
    assert covered(substring_dedup._extended(words, others, seeds, window)) == covered(seeds)
    # A seed that no window of the other text bears out, as after a collision of hashes, is left alone.
    every = [(i, i + window) for i in range(len(words) - window + 1)]
    assert covered(substring_dedup._extended(words, others, every, window)) == covered(seeds)


def test_repeats_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = documents(spark, text, text, text + " more", text, ids=[4, 4, None, 9])
    assert [(r[0], r[2]) for r in got(substring_dedup.remove_repeats(docs))] == [(None, 0), (4, 0), (4, 0), (9, 60)]
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


# Hashes


def thue_morse(n, a, b):
    return [a if bin(i).count("1") % 2 else b for i in range(n)]


def test_patterns_do_not_collide():
    """Words and sequences that cancel out in polynomial hashes modulo 2^64."""
    x, y = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    h, at = _words.word_hashes(np.frombuffer(f"{x} {y} {x}".encode(), np.uint8), np.array([0, 3074]), fold=True)
    assert h[0] == h[2] != h[1] and at.tolist() == [0, 3]
    words = np.array(thue_morse(1024, 5, 9) + thue_morse(1024, 9, 5), np.uint64)
    whole = _words.spans(words, 1024)
    assert whole[0] != whole[1024]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aAéZ\x0b", max_size=40), min_size=1, max_size=20), st.integers(1, 60))
def test_hashes_follow_words(parts, length):
    text = " ".join(parts)
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))
    data = text.encode()
    h, _ = _words.word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]), fold=True)
    assert len(h) == len(words) and all((a == b) == (v == w) for a, v in zip(h, words) for b, w in zip(h, words))
    s = _words.spans(h, length)
    want = [tuple(words[i : i + length]) for i in range(len(words) - length + 1)]
    assert len(s) == len(want) and all((a == b) == (v == w) for a, v in zip(s, want) for b, w in zip(s, want))


def test_adversarial_words_stay_apart(spark):
    """Disjoint sets of words and windows that a weak hash takes for equal."""
    x, y = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    one, two = " ".join([x] * 50), " ".join([y] * 50)
    docs = documents(spark, f"{x} p q r", f"{y} p q r", one, two)
    assert [r[2] for r in got(jaccard_join.near_duplicates(docs, 4, (85, 100)))] == [0, 1, 2, 3]
    assert [r[2] for r in got(substring_dedup.remove_repeats(docs))] == [0, 0, 0, 0]


# Odd rows of all operators


def test_odd_rows_of_token_operators(spark, library):
    """Null keys, repeated rows, clashing columns, empty tables, one very long word."""
    long = "".join(random.Random(2).choices("abcdefgh0123456789", k=30_000))
    docs = documents(spark, "one two", "one two", "one two", None, long, ids=[None, 3, 3, 4, 5])
    want = {t: len(library.encode(t, add_special_tokens=False).ids) for t in ("one two", "", long)}
    for found in (bpe.token_counts(docs, VOCABULARY), bpe.encode_decode(docs, VOCABULARY, digest=True)):
        rows = got(found.select("doc_id", "n_tokens"))
        assert sorted(rows, key=str) == sorted([(None, want["one two"]), (3, want["one two"]), (3, want["one two"]), (4, 0), (5, want[long])], key=str)
    assert bpe.token_counts(docs.limit(0), VOCABULARY).count() == bpe.encode_decode(docs.limit(0), VOCABULARY).count() == 0


def test_odd_rows_of_joins(spark):
    """Very long texts, keys that are no numbers, repeated rows."""
    draw = random.Random(3)
    long = " ".join(f"w{draw.randint(0, 10**6)}" for _ in range(60_000))
    near = long.replace(long[1000:1040], "changed", 1)
    rows = [("b", long), ("a", near), ("c", "x y z"), ("c", "x y z"), (None, long), ("d", None)]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id string, text string, n int, node string").repartition(2)
    found = jaccard_join.near_duplicates(docs, 4, (85, 100)).collect()
    assert sorted((r["doc_id"] or "", r["component_id"]) for r in found) == [("", None), ("a", "a"), ("b", "a"), ("c", "c"), ("c", "c"), ("d", "d")]
    longs = [(1, long), (2, "start " + long), (3, near)]
    removed = got(substring_dedup.remove_repeats(documents(spark, *(t for _, t in longs), ids=[1, 2, 3]), keep_text=False))
    assert removed == brute_removal(longs, 50) and removed[1][2] == 60_000


def test_odd_rows_of_decontamination_and_media(spark):
    item = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    docs = documents(spark, "x a b c d e f g h i j", "x a b c d e f g h i j", "x a b c d e f g h i j", None, ids=[None, 2, 2, 3])
    found = got(decontaminate.find_contamination(docs, item).select("doc_id", "n_hit"))
    assert sorted(found, key=str) == sorted([(None, 10), (2, 10), (2, 10), (3, 0)], key=str)
    assert decontaminate.find_contamination(docs.limit(0), item).count() == 0
    media = got(transport_stream.media_column(docs).select("doc_id", "n_bytes"))
    assert sorted(media, key=str) == sorted([(None, 21), (2, 21), (2, 21), (3, 0)], key=str)
    assert transport_stream.media_column(docs.limit(0)).count() == 0


def test_chats_ignore_other_columns(spark):
    rows = [(1, 0, "user", "hello", "x", "y", 3), (1, 1, "assistant", "hi", "x", "y", 3), (1, 1, "assistant", "hi", "x", "y", 3), (None, 0, "user", "z", "x", "y", 3)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string, chat string, piece int")
    out = {r["conv_id"]: r["formatted"] for r in chat_format.format_chats(chat_format.to_events(conv)).collect()}
    said = lambda role, text: f"<s>[INST] {role} [/INST]{text}</s>"
    assert out == {1: said("user", "hello") + said("assistant", "hi") * 2, None: said("user", "z")}
