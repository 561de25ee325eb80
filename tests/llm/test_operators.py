"""Each operator against a plain version, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import ann, archives, ctw, suffix_runs
from tessera.llm.ann import hadamard, rotate, search
from tessera.llm.ann import _nearest_in_tiles as nearest_in_tiles
from tessera.llm.common import components, scratch
from tessera.llm.embedding_dedup import near_duplicates
from tessera.llm.jaccard_join import intersections, join, least_matches
from tessera.llm.link_graph import judge
from tessera.llm.lm_scoring import score, squeeze, unsqueeze
from tessera.llm.packing import karmarkar_karp, pack, windows
from tessera.llm.piece_fst import Model, encode
from tessera.llm.quality import best_cut, gumbel, keep_good, n_grams, resample
from tessera.llm.queries import URL_RULES, tokenizer_file
from tessera.llm.suffix_dedup import remove_repeats
from tests.llm import brute

#: Names that operators use inside, as further columns of the input.
CLASH = ("rep", "sig", "block", "kind", "shard", "keys", "data", "bucket", "n", "size", "component", "cluster", "node", "k1", "u", "v", "labelled", "target", "vec", "id", "label_key", "found", "blocks", "side", "tile_a", "score", "kept", "n_links")


def clashing(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH) if c not in df.columns])


def prose(rng, n):
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, and odd ones."""
    rng = random.Random(seed)
    out = [prose(rng, rng.randint(5, 120)) for _ in range(n)]
    out += [out[3]] * 3
    for k in range(6):
        w = out[5 + k].split()
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    shared = prose(rng, 90)
    out += [prose(rng, 20) + " " + shared + " " + prose(rng, 20) for _ in range(3)]
    return [*out, "", "   \n", None, "one two", "One  TWO", "é" * 30, "ab " * 300, prose(rng, 20_000)]


def doc_rows(texts):
    return [(i + 1, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


ODD = [(None, "no id here at all"), (7, None), (8, ""), (9, "twice the same row"), (9, "twice the same row"), (10, "x " * 50_000)]


# --- plumbing ------------------------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(1, 300), rng.randint(1, 300)) for _ in range(180)] + [(500, 500 + i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(40)]
    low = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in low.items() if k in got}
    assert {k for k in low if k not in got} <= {a for a, b in edges if a == b}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_scratch_follows_the_session(spark):
    assert scratch(spark).startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))


# --- 1 -------------------------------------------------------------------------------------------------------------


def test_scores_are_those_of_the_plain_tree(spark):
    rows = doc_rows(corpus(2, 25)[:-1])
    tree = brute.ContextTree([(t or "").encode().lower() for i, t in rows if not brute.held_out(i)], ctw.DEPTH)
    base = brute.unigram(rows)
    got = score(clashing(frame(spark, rows)), shards=16).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        n, known, train, unigram = base[r.doc_id, texts[r.doc_id]]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (brute.held_out(r.doc_id), n, known, train)
        assert r.base_score == pytest.approx(unigram, rel=1e-9)
        assert r.score == pytest.approx(tree.log10((texts[r.doc_id] or "").encode().lower()), rel=1e-5)


def test_seven_bytes_of_context_count():
    keys, _ = ctw.keys_of([b"Xcccccc1", b"Ycccccc2"] * 20)
    asked, _ = ctw.keys_of([b"Xcccccc1", b"Xcccccc2"])
    key, count = np.unique(np.concatenate([keys, asked]), return_counts=True)
    count -= np.isin(key, asked)  # asked for once, not learnt from
    p = ctw.Tree(key, count, least=0).log10()[np.searchsorted(key, asked)]
    # the byte after seven of context, where the first tells which it is
    assert p[7] > np.log10(0.8) and p[16] < np.log10(0.2)


def test_scores_of_odd_rows(spark):
    got = score(frame(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r.score < 0 for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert next(r for r in got if r.doc_id == 7).n_tokens == 1
    only_held_out = [(i, "a b") for i in range(60) if brute.held_out(i)]
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in score(frame(spark, only_held_out)).collect())
    assert score(frame(spark, [])).count() == 0


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
@settings(deadline=None, max_examples=50)
def test_squeeze(values):
    v = np.array(values, np.uint64)
    assert (unsqueeze(squeeze(v)) == v).all()
    assert (unsqueeze(squeeze(np.sort(v), True), True) == np.sort(v)).all()


@given(st.lists(st.binary(max_size=20), max_size=6))
@settings(deadline=None, max_examples=100)
def test_keys(texts):
    key, begin = ctw.keys_of(texts)
    want = []
    for t in texts:
        d = b"\xff" * ctw.DEPTH + t + b"\xff"
        want += [int.from_bytes(d[k - ctw.DEPTH : k][::-1] + d[k : k + 1], "big") for k in range(ctw.DEPTH, len(d))]
    assert key.tolist() == want and np.diff(begin).tolist() == [len(t) + 1 for t in texts]


# --- 2 -------------------------------------------------------------------------------------------------------------


def removed(df, length=400):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in remove_repeats(df, length=length).collect())


def test_repeats_are_removed(spark):
    rows = doc_rows(corpus(3))
    assert removed(clashing(frame(spark, rows))) == sorted(brute.without_repeats(rows, 400))


@pytest.mark.parametrize("seed", range(4))
def test_short_repeats_in_poor_alphabets(spark, seed):
    rng = random.Random(seed)
    part = lambda n: "".join(rng.choice("ab") for _ in range(n))
    blocks = [part(rng.randint(20, 60)) for _ in range(5)]
    rows = doc_rows(["".join(rng.choice([*blocks, part(rng.randint(1, 30)), "é"]) for _ in range(rng.randint(0, 9))) for _ in range(40)] + ["a" * 200, "ab" * 100, "abc" * 9])
    assert removed(frame(spark, rows), 40) == sorted(brute.without_repeats(rows, 40))


def test_repeats_of_odd_rows(spark):
    rows = [*ODD, (11, "long enough " * 50), (11, "long enough " * 50)]
    got = remove_repeats(clashing(frame(spark, rows)).withColumn("lang", F.lit("en")), carry=["lang", "kept"], as_text=True).collect()
    assert len(got) == len(rows) and {r.carried_0 for r in got} == {"en"} and {r.carried_1 for r in got} == {CLASH.index("kept")}
    assert all(r.kept == "" for r in got if r.doc_id in (7, 8, 10, 11))
    assert remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("piece", "hot"), [(1, 50_000), (2, 3), (5, 1), (3, 12)])
def test_repeats_across_pieces_of_a_run(spark, piece, hot):
    rng = random.Random(piece)
    passages = [prose(rng, 60)[:100] for _ in range(6)]
    texts = [prose(rng, 2) + " " + rng.choice(passages)[rng.randint(0, 30) :] + " " + prose(rng, 2) for _ in range(120)]
    rows = doc_rows(texts)
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), length=40, run_piece=piece, hot=hot).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got) == sorted(brute.without_repeats(rows, 40))


def judged(few, items, times, method, size):
    shared = [0, *(suffix_runs.common(a[0], b[0]) for a, b in zip(items, items[1:], strict=False))]
    old, suffix_runs.FEW = suffix_runs.FEW, few
    try:
        return getattr(suffix_runs.Group(items, shared, times), method)(size)
    finally:
        suffix_runs.FEW = old


def spans(strings, times):
    """Of each item the outermost ends of its strings, by (bytes before the anchor, bytes after), that occur twice."""
    count = Counter()
    for own, n in zip(strings, times, strict=True):
        count.update({(o, s): n for o, s in own.items()})
    held = [[o for o, s in own.items() if count[o, s] > 1] for own in strings]
    return [(-max(o[0] for o in x), max(o[1] for o in x)) if x else None for x in held]


@given(st.lists(st.tuples(st.text("ab", max_size=4), st.text("ab ", max_size=14), st.integers(1, 2)), min_size=1, max_size=12, unique_by=lambda x: x[:2]), st.sampled_from([0, 6]), st.integers(5, 9))
@settings(deadline=None, max_examples=600)
def test_groups_know_their_repeated_strings_by_shared_lengths(found, few, length):
    found = [(left[-(length - 4) :], "seed" + suffix, n) for left, suffix, n in sorted(found, key=lambda x: x[1])]
    found = [x for n, x in enumerate(found) if len(x[0]) + len(x[1]) >= length and x[:2] not in [y[:2] for y in found[:n]]]
    if found:
        items, times = [(suffix.encode(), left.encode()) for left, suffix, _ in found], [n for *_, n in found]
        strings = [{(o, length - o): left[len(left) - o :] + suffix[: length - o] for o in range(max(0, length - len(suffix)), len(left) + 1)} for left, suffix, _ in found]
        assert judged(few, items, times, "strings", length) == spans(strings, times)


WORDS = st.lists(st.sampled_from(["a ", "a  ", "bc ", "bcd "]), max_size=6)


@given(st.lists(st.tuples(WORDS, WORDS, st.integers(1, 2)), min_size=1, max_size=12), st.sampled_from([0, 6]))
@settings(deadline=None, max_examples=600)
def test_groups_know_their_repeated_words_by_shared_lengths(found, few):
    kept, n_words = {}, 9
    for left, right, n in found:
        words = ["two ", "seed ", *right]
        if len(left) + len(words) >= n_words:
            kept["".join(words).rstrip().encode(), "".join(left).encode()] = (left, words, n)
    if kept:
        items = sorted(kept)
        strings, times = [], [kept[i][2] for i in items]
        for i in items:
            left, words, _ = kept[i]
            own = {}
            for o in range(max(0, n_words - len(words)), min(len(left), n_words - 1) + 1):
                a, b = "".join(left[len(left) - o :]), "".join(words[: n_words - o]).rstrip()
                own[len(a), len(b)] = a + b
            strings.append(own)
        assert judged(few, items, times, "words", n_words) == spans(strings, times)


def without_word_runs(rows, length, words):
    """(doc_id, kept) without the strings of ``length`` bytes or ``words`` whole words that occur twice or more."""
    found, count = [], Counter()
    for i, t in rows:
        data = (t or "").encode()
        spots = [m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", data)]
        spans = [(0, k, k + length) for k in range(len(data) - length + 1)] + [(1, a, b) for (a, _), (_, b) in zip(spots, spots[words - 1 :], strict=False)]
        count.update((kind, data[a:b]) for kind, a, b in spans)
        found.append((i, data, spans))
    out = []
    for i, data, spans in found:
        gone = {x for kind, a, b in spans if count[kind, data[a:b]] > 1 for x in range(a, b)}
        out.append((i, bytes(x for n, x in enumerate(data) if n not in gone)))
    return sorted(out)


@pytest.mark.parametrize(("seed", "hot"), [(0, 50_000), (1, 50_000), (2, 4), (3, 1)])
def test_runs_of_words_are_removed(spark, seed, hot):
    rng = random.Random(seed)
    blocks = [" ".join(rng.choice(["a", "bc", "def"]) for _ in range(rng.randint(8, 30))) for _ in range(4)]
    part = lambda: rng.choice([*blocks, *blocks, "é", "xx  yy\n", "", prose(rng, rng.randint(1, 9))])
    rows = doc_rows(["".join(part() + rng.choice([" ", " ", " ", "", "\t"]) for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["b"] * 30 + ["a " * 40, "long" * 60, "long" * 61, None])
    got = remove_repeats(frame(spark, rows), length=120, words=17, hot=hot).collect()
    assert sorted((r.doc_id, bytes(r.kept)) for r in got) == without_word_runs(rows, 120, 17)
    assert all(r.n_repeated == r.n_removed for r in got)
    counted = {r.doc_id: r for r in remove_repeats(frame(spark, rows), length=120, words=17, remove_words=False).collect()}
    assert all(counted[r.doc_id].n_repeated == r.n_removed for r in got)
    assert sorted((r.doc_id, bytes(r.kept)) for r in counted.values()) == without_word_runs(rows, 120, 10**6)
    assert without_word_runs(rows, 120, 17) != without_word_runs(rows, 120, 10**6)


@given(st.lists(st.lists(st.binary(max_size=12), max_size=12), max_size=7))
@settings(deadline=None, max_examples=200)
def test_merging_never_compares_a_known_prefix_wrongly(lists):
    runs = [sorted(x) for x in lists]
    packed = [suffix_runs.encode_run([(s, b"", n, 1) for n, s in enumerate(r)]) for r in runs if r]
    got = list(suffix_runs.merge_runs([suffix_runs.decode_run(p) for p in packed]))
    assert [g[2][0] for g in got] == sorted(s for r in runs for s in r)
    for a, b in zip(got, got[1:], strict=False):
        assert b[0] == suffix_runs.common(a[2][0], b[2][0])


@given(st.lists(st.text("ab", max_size=90).map(str.encode), max_size=5))
@settings(deadline=None, max_examples=200)
def test_every_string_has_one_anchor_by_its_bytes(texts):
    a = suffix_runs.Anchors(texts, 40)
    offset, seen = {}, []
    for at, first, last, text in zip(a.at.tolist(), a.first.tolist(), a.last.tolist(), a.text.tolist(), strict=True):
        for s in range(first, last + 1):
            begin = s - int(a.begin[text])
            w = texts[text][begin : begin + 40]
            assert len(w) == 40 and 0 <= at - s <= 40 - suffix_runs.SEED
            assert offset.setdefault(w, at - s) == at - s
            seen.append((text, begin))
    assert sorted(seen) == [(n, k) for n, t in enumerate(texts) for k in range(len(t) - 39)]


# --- 3 -------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def test_rules(spark):
    urls = {
        "http://a.example.NET/en/x": ("a.example.net", "/en/x", "example.net/en/", "allow"), "https://example.net/fr/": ("example.net", "/fr/", "net/", "block"), "x://net?q": ("net", "", None, None),
        "http://b.example.com/de/1#t": ("b.example.com", "/de/1", "example.com/de/", "block"), "http://myexample.com/de/": ("myexample.com", "/de/", None, None), "http://é.org/fr/a?b/c": ("é.org", "/fr/a", "org/fr/", "allow"),
        "no scheme": ("", "", None, None), "": ("", "", None, None), None: ("", "", None, None), "a://b://c/d": ("b:", "//c/d", None, None), "http://": ("", "", None, None),
    }
    rows = [(i, u, "") for i, u in enumerate(urls)]
    got = {r.page_id: r for r in judge(clashing(spark.createDataFrame(rows, PAGES)), URL_RULES).collect()}
    for (i, u, _), want in zip(rows, urls.values(), strict=True):
        assert (got[i].host, got[i].path, got[i].rule) == want[:3], u
        assert want[3] in (None, got[i].verdict) and got[i].verdict in ("allow", "block")


def test_distrust_goes_against_links(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    rows = [(1, "http://bad.net/1", ""), (2, "http://farm.info/", link("bad.net", "worse.net")), (3, "http://worse.net/x", ""), (4, "http://good.org/fr/1", link("friend.info")), (5, "http://friend.info/", ""), (6, "http://lone.info/", "<a href='/x'>"), (7, "http://far.info/", "<A HREF=//farm.info/a>")]
    got = {r.page_id: r for r in judge(spark.createDataFrame(rows, PAGES), URL_RULES).collect()}
    assert [got[i].verdict for i in (2, 5, 6, 7)] == ["block", "allow", "allow", "block"]
    # farm is the only host that links to the two blocked ones, far the only one that links to farm
    assert got[5].trust == pytest.approx(0.85) and got[2].distrust == pytest.approx(2 * 0.85) and got[7].distrust == pytest.approx(2 * 0.85**2)


def linked(*hosts):
    return "".join(f'<a href="http://{h}/">x</a>' for h in hosts)


def test_distrust_of_long_chains(spark):
    hosts = [[f"c{k}n{n}.info" for n in range(8)] + [f"bad{k}.net"] for k in range(4)]
    links = [("start.info", linked(*(c[0] for c in hosts)))] + [(a, linked(b)) for c in hosts for a, b in zip(c, c[1:], strict=False)] + [(c[-1], "") for c in hosts]
    got = {r.host: r for r in judge(spark.createDataFrame([(i, f"http://{h}/", t) for i, (h, t) in enumerate(links)], PAGES), URL_RULES).collect()}
    # nine links from the start to each of the four blocked hosts
    assert got["start.info"].distrust == pytest.approx(4 * 0.85**9, abs=1e-6) and got["start.info"].verdict == "block"


def personalised_pagerank(links, seeds, damping=0.85):
    """By a dense solver: seeds as a distribution, and hosts without links hand what they hold back to the seeds."""
    start = seeds / seeds.sum()
    size = links.sum(axis=1, keepdims=True)
    step = np.where(size > 0, links / np.where(size > 0, size, 1), start[None, :])
    return np.linalg.solve(np.eye(len(start)) - damping * step.T, (1 - damping) * start)


def test_scores_are_those_of_a_dense_solver(spark):
    rng = np.random.default_rng(12)
    ends = ["net", "org", "info"]
    names = [f"h{i}.{ends[i % 3]}" for i in range(200)]
    links = np.where(rng.random((200, 200)) < 0.012, rng.integers(1, 4, (200, 200)), 0)
    np.fill_diagonal(links, 0)
    links[rng.random(200) < 0.2] = 0
    rows = [(i, f"http://{n}/fr/{i}", "".join(f'<a href="http://{names[j]}/x">' * links[i, j] for j in np.flatnonzero(links[i]))) for i, n in enumerate(names)]
    got = {r.page_id: r for r in judge(spark.createDataFrame(rows, PAGES), URL_RULES).collect()}
    trusted, blocked = (np.array([float(n.endswith(e)) for n in names]) for e in ("org", "net"))
    for column, graph, seeds in (("trust", links, trusted), ("distrust", links.T, blocked)):
        found = np.array([got[i][column] for i in range(200)])
        assert found / found.sum() == pytest.approx(personalised_pagerank(graph, seeds), abs=2e-7)


def test_scores_on_a_cycle(spark):
    rows = [(1, "http://a.info/", linked("b.info", "bad.net")), (2, "http://b.info/", linked("a.info")), (3, "http://bad.net/", "")]
    got = {r.host: r for r in judge(spark.createDataFrame(rows, PAGES), URL_RULES).collect()}
    # a = 0.85 + 0.85 b and b = 0.85 a
    a = 0.85 / (1 - 0.85**2)
    assert got["a.info"].distrust == pytest.approx(a, abs=1e-6) and got["b.info"].distrust == pytest.approx(0.85 * a, abs=1e-6)


def test_distrust_of_many_linkers(spark):
    rows = [(0, "http://bad.net/", "")] + [(i, f"http://only{i}.info/", linked("bad.net")) for i in range(1, 10)]
    rows += [(10, "http://mixed.info/", linked("bad.net", "fine.info", "well.info")), (11, "http://fine.info/", ""), (12, "http://well.info/", "")]
    got = {r.host: r for r in judge(spark.createDataFrame(rows, PAGES), URL_RULES).collect()}
    # each of the ten has a tenth of what goes back from the blocked host; mixed alone links to two others
    assert all(got[h].distrust == pytest.approx(0.085, abs=1e-6) for h in ("only1.info", "only9.info", "mixed.info"))
    assert all(got[f"only{i}.info"].verdict == "block" for i in range(1, 10))
    assert got["mixed.info"].verdict == got["fine.info"].verdict == "allow"


def test_filter_of_odd_pages(spark):
    rows = [(None, None, None), (1, "http://a.net/", None), (1, "http://a.net/", None), (2, "http://b.info/", "<a href='http://b.info/x'>" * 5000)]
    assert judge(spark.createDataFrame(rows, PAGES), URL_RULES).count() == 4
    assert judge(spark.createDataFrame([], PAGES), URL_RULES).count() == 0


# --- 4 and 6 -------------------------------------------------------------------------------------------------------

VECS = "vec_id long, embedding array<float>, label int"


def test_rotations_keep_lengths():
    x = np.random.default_rng(1).standard_normal((5, 16))
    assert hadamard(hadamard(x)) == pytest.approx(x)
    assert np.linalg.norm(rotate(x[:, :11], 3, 1), axis=1) == pytest.approx(np.linalg.norm(x[:, :11], axis=1))


def test_search_recall_and_order(spark):
    x = np.random.default_rng(2).standard_normal((1500, 32)).astype("float32")
    x[10] = x[20] = x[30]
    df = spark.createDataFrame([(i, x[i].tolist(), 0) for i in range(len(x))], VECS)
    got = search(clashing(df), df.filter("vec_id % 50 = 0 or vec_id = 30")).collect()
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = total = 0
    for q in {r.query_id for r in got}:
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5] and [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        s = y @ y[q]
        assert all(r.score == pytest.approx(s[r.vec_id], abs=1e-12) for r in own)
        s[q] = -2
        hits += len({r.vec_id for r in own} & set(np.argsort(-s, kind="stable")[:5].tolist()))
        total += 5
    assert hits / total >= 0.9
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 30), key=lambda r: r.rank)][:2] == [10, 20]


def test_search_among_few_and_odd(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [-1.0, 0.0], None), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 2.0, 3.0], 1), (0, [1.0, 0.0], 1), (None, [1.0, 1.0], 1), (8, [float("inf"), 1.0], 1)]
    df = spark.createDataFrame(rows, VECS)
    got = sorted((r.query_id, r.rank, r.vec_id) for r in search(df, df).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2), (2, 1, 1), (2, 2, 0)]
    assert search(df.limit(0), df).count() == 0 and search(df, df.limit(0)).count() == 0


def test_search_among_components_of_any_size(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((40, 8))
    size = [1e-200, 1e-310, 1e300, 1.0, 1e-160]
    rows = [(i, (x[i % 20] * size[i % 5 if i < 20 else (i + 1) % 5]).tolist(), 0) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = search(df, df.filter("vec_id < 20")).collect()
    assert len(got) == 100 and {(r.query_id, r.vec_id) for r in got if r.rank == 1} == {(i, i + 20) for i in range(20)}
    assert all(abs(r.score - 1) < 1e-9 for r in got if r.rank == 1)


def test_search_among_many_equal_vectors(spark, monkeypatch):
    rows = [(i, [1.0, 2.0, 3.0, 4.0], 0) for i in range(3000)] + [(5000 + i, [1.0, 2.0, 3.0, float(i)], 0) for i in range(5, 9)]
    df = spark.createDataFrame(rows, VECS)
    seen = []
    monkeypatch.setattr(ann, "_nearest_in_tiles", lambda dealt, k: seen.append(nearest_in_tiles(dealt, k)) or seen[-1])
    got = search(df, df.filter("vec_id % 50 = 0")).collect()
    assert len(got) == 60 * 5
    by = {q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] for q in {r.query_id for r in got}}
    assert by[0] == [1, 2, 3, 4, 5] and all(v == [0, 1, 2, 3, 4] for q, v in by.items() if q >= 50)
    assert seen[0].count() <= 60 * 6


def test_vector_groups(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((6, 16))
    x = np.concatenate([c + rng.standard_normal((n, 16)) * 0.05 for c, n in zip(centre, (40, 3, 1, 1, 2, 300), strict=True)]).astype("float32")
    x = np.concatenate([x, x[:5], x[50:90]])
    labels = [None if i % 23 == 0 else i % 2 for i in range(len(x))]
    df = spark.createDataFrame([(i, x[i].tolist(), labels[i]) for i in range(len(x))], VECS)
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    same = np.array([[a is not None and a == b for b in labels] for a in labels])
    link = (y @ y.T >= 0.98) & same
    np.fill_diagonal(link, False)
    low = np.arange(len(x))
    for _ in range(len(x)):
        low = np.minimum(low, np.where(link, low[None, :], len(x)).min(axis=1))
    for tile in (1024, 16):
        got = {r.vec_id: r for r in near_duplicates(clashing(df), tile=tile).collect()}
        assert [got[i].n_links for i in range(len(x))] == link.sum(axis=1).tolist()
        assert [got[i].component_id for i in range(len(x))] == low.tolist()
        assert all(got[i].kept == (low[i] == i) for i in range(len(x)))


def test_vector_groups_of_odd_rows(spark):
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [float("nan"), 1.0], 1), (4, [1.0, 1.0], None), (5, [1.0, 1.0], 1), (6, [2.0, 2.0], 1), (5, [1.0, 1.0], 1), (None, [1.0, 1.0], 1), (7, [1.0, 1.0, 1.0], 1), (8, [None, 1.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, VECS)).collect()}
    assert got == {5: (1, 5, True), 6: (1, 5, False), None: (0, None, True)} | {i: (0, i, True) for i in (1, 2, 3, 4, 7, 8)}
    assert near_duplicates(spark.createDataFrame(rows, VECS)).count() == len(rows)
    assert near_duplicates(spark.createDataFrame([], VECS)).count() == 0


# --- 5 -------------------------------------------------------------------------------------------------------------


def test_jaccard_groups(spark):
    rows = doc_rows(corpus(5, 80)[:-1])
    rng = random.Random(6)
    base = prose(rng, 60).split()
    for _ in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        rows.append((len(rows) + 1, " ".join(w)))
    for tile in (1024, 8):
        got = {r.doc_id: (r.set_id, r.class_id, r.n_links) for r in join(clashing(frame(spark, rows)), tile=tile).collect()}
        assert got == brute.jaccard_groups(rows)


def test_jaccard_of_odd_rows(spark):
    got = join(clashing(frame(spark, ODD))).collect()
    by = lambda i: [(r.set_id, r.class_id, r.n_links) for r in got if r.doc_id == i]
    assert len(got) == len(ODD) and by(9) == [(9, 9, 1)] * 2 and by(7) == [(7, 7, 0)] and by(None) == [(None, None, 0)]
    assert join(frame(spark, [])).count() == 0


def test_bayesian_bounds():
    steps = [16, 64, 120]
    least = least_matches(0.8, 1e-5, steps)
    assert least == sorted(least) and all(0 < s < 0.8 * m for s, m in zip(least, steps, strict=True))
    assert least_matches(0.8, 0.5, [100])[0] in (80, 81)


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(20)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    got = intersections(sets)
    np.fill_diagonal(got, 0)
    np.fill_diagonal(want := np.array(want), 0)
    assert (got == want).all()


# --- 7 -------------------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    long = "<p>" + "é" * 80 + "</p>"
    html = [long, None, "", "short", "short", long, "x" * 99, "x" * 99, "y" * 100, "y" * 100, "WARC/1.1\r\n\r\n\r\n" * 20, "z" * 3_000_000, long]
    rows = [(i + 1, None if i == 3 else f"http://h.example/{i} a\nb?é", h) for i, h in enumerate(html)]
    df = spark.createDataFrame(rows, PAGES).repartition(4)
    got = {r.page_id: r for r in archives.round_trip(clashing(df), scratch(spark)).collect()}
    first = {}
    for i, _, h in rows:
        data = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        origin = first.setdefault(data, i) if len(data) >= 100 else i
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if origin == i else ("revisit", origin))


def test_archives_of_odd_pages(spark):
    same = "same page " * 20
    rows = [(None, None, None), (5, "http://a/", same), (5, "http://a/", same), (None, "http://b/", same)]
    got = archives.round_trip(spark.createDataFrame(rows, PAGES), scratch(spark)).collect()
    assert sorted(r.record_type for r in got) == ["response", "response", "revisit", "revisit"] and {r.refers_to for r in got} == {None, 5}
    assert archives.round_trip(spark.createDataFrame([], PAGES), scratch(spark)).count() == 0


def zipped(*parts):
    return b"".join(m + b"\0" for p in parts for m in archives.members(p))


def test_arc_versions_and_errors():
    v1 = b"filedesc://x.arc 0.0.0.0 20010203040506 text/plain 8\n1 0 X\n\n\n"
    ok = list(archives.arc_records(zipped(v1, b"http://u/ 1.2.3.4 2001020304 text/html 30\nHTTP/1.0 200 OK\r\nA: b\r\n\r\nhello"[:0] + b"http://u/ 1.2.3.4 20010203 text/html 24\nHTTP/1.0 200 OK\r\n\r\nhello\n"), "x"))
    assert [(r["version"], r["payload"], archives.iso(r["date"])) for r in ok] == [(1, b"hello", "2001-02-03T00:00:00Z")]
    v2 = v1.replace(b"text/plain 8", b"text/plain 200 - - 0 x.arc 8").replace(b"\n1 0 X", b"\n2 0 X")
    ok = list(archives.arc_records(zipped(v2, b"http://u/ 1.2.3.4 20010203040506 text/plain 200 c - 9 x.arc 4\nbody\n"), "x"))
    assert [(r["version"], r["http"], r["payload"]) for r in ok] == [(2, b"", b"body")]
    for bad in (b"nothing\n", v1.replace(b"1 0 X", b"9 0 X"), v1 + b"http://u/ too few 3\nabc\n", v1 + b"http://u/ 1.2.3.4 20010203040506 text/html 99\nabc\n"):
        with pytest.raises(ValueError):
            list(archives.arc_records(zipped(bad), "x"))


def test_members_hold_any_bytes():
    import gzip

    data = bytes(range(256)) * 70_000
    parts = [m + b"\0" for m in archives.members(data)]
    assert len(parts) == 2 and gzip.decompress(b"".join(parts)) == data == b"".join(archives.unzip(b"".join(parts)))


# --- 8 -------------------------------------------------------------------------------------------------------------


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    odd = ["It's they're 12 a,b.. x. , Σας ΣΑΣ. e\u0301t\u00e9 İI <|endoftext|> a.\x1cb", "\u00a0nbsp\u2003em", "é,. 3.14,"]
    rows = doc_rows([*corpus(7), *odd]) + ODD
    tokenizer = Tokenizer.from_file(path)
    want = sorted([(-1 if i is None else i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows])
    got = pack(clashing(frame(spark, rows)), path).collect()
    for r in got:
        options = [ids for i, ids in want if i == (-1 if r.doc_id is None else r.doc_id)]
        assert any(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for ids in options)
    assert sum(r.length for r in got) == sum(len(ids) for _, ids in want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
    assert pack(frame(spark, []), path).count() == 0


@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(1, 8))
@settings(deadline=None, max_examples=200)
def test_differencing(sizes, k):
    sets = karmarkar_karp(sizes, k)
    assert sorted(i for s in sets for i in s) == list(range(len(sizes))) and len(sets) <= k
    sums = [sum(sizes[i] for i in s) for s in sets] + [0] * (k - len(sets))
    assert max(sums) - min(sums) <= max(sizes)
    filled = windows(sizes, 50)
    assert sorted(i for s in filled for i in s) == list(range(len(sizes))) and all(sum(sizes[i] for i in s) <= 50 for s in filled)


def test_little_padding():
    rng = random.Random(1)
    sizes = [min(4095, int(rng.expovariate(1 / 700)) + 1) for _ in range(550)]
    assert sum(sizes) / (4096 * len(windows(sizes, 4096))) > 0.97


# --- 9 -------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def piece_model():
    return Model(tokenizer_file("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))


@given(st.one_of(st.text(max_size=60), st.text(" \n\tabtheing.,▁é漢🙂0", max_size=80)))
@settings(deadline=None, max_examples=500)
def test_pieces_are_the_library_s(piece_model, library, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = np.frombuffer(piece_model.encode(text), "<u4")
    assert ids.tolist() == library.encode(text)
    assert piece_model.decode(ids).decode() == text.replace("▁", " ")


def test_pieces_operator(spark, library):
    rows = doc_rows(corpus(8)) + ODD
    got = encode(clashing(frame(spark, rows)), tokenizer_file("piece_bpe_32k.model"), with_ids=True).collect()
    assert len(got) == len(rows) and all(r.round_trip and r.n_ids == len(r.ids) for r in got)
    assert sorted(map(str, (r.ids for r in got))) == sorted(str(library.encode(t or "")) for _, t in rows)
    assert encode(frame(spark, []), tokenizer_file("piece_bpe_32k.model")).count() == 0


def hand_made(pieces, merging):
    m = Model.__new__(Model)
    m.compile(["<unk>", *pieces], [2] + [1] * len(pieces), [0.0, *pieces.values()], merging)
    return m


def spelt(m, symbols):
    return [m.names[n] if n >= 0 else chr(-2 - n) for n in m.shortest(symbols)]


def test_path_of_least_weight():
    m = hand_made({"a": -3.0, "b": -3.0, "ab": -5.0, "abc": -9.5, "c": -1.0, "bc": -4.5}, False)
    assert spelt(m, "abc") == ["ab", "c"] and spelt(m, "bc") == ["b", "c"] and spelt(m, "axb") == ["a", "x", "b"]
    assert m.shortest("") == []


@given(st.dictionaries(st.text("abc", min_size=1, max_size=4), st.floats(-9, -0.5), max_size=14), st.text("abcd", max_size=9))
@settings(deadline=None, max_examples=200)
def test_path_weight_is_the_least_of_all_cuts(pieces, text):
    m = hand_made(pieces, False)
    weight = lambda p: -pieces[p] if p in pieces else m.heaviest if len(p) == 1 else float("inf")
    best = [0.0] + [min(best_of(text, weight, n)) for n in range(1, len(text) + 1)]
    path = spelt(m, text)
    assert "".join(path) == text and sum(map(weight, path)) == pytest.approx(best[-1], rel=1e-6)


def best_of(text, weight, n):
    """Weights of all ways to cut the first n characters."""
    for cuts in range(1 << (n - 1)):
        edges = [0, *(k for k in range(1, n) if cuts >> (k - 1) & 1), n]
        yield sum(weight(text[i:j]) for i, j in zip(edges, edges[1:], strict=False))


@given(st.lists(st.text("ab", min_size=2, max_size=5), unique=True, max_size=8), st.text("abc", max_size=10))
@settings(deadline=None, max_examples=200)
def test_only_path_of_a_merge_model_is_the_merge_result(merges, text):
    """Pieces as a trainer makes them: each joins two earlier ones, so it has a worse score."""
    known = ["a", "b"]
    for m in sorted(merges, key=len):
        if any(m[:k] in known and m[k:] in known for k in range(1, len(m))):
            known.append(m)
    m = hand_made({p: -float(n) for n, p in enumerate(known)}, True)
    assert spelt(m, text) == m.merged(text)


def test_long_words_are_not_remembered(piece_model, library):
    word = "abcdefgh" * 2000
    assert np.frombuffer(piece_model.encode(word), "<u4").tolist() == library.encode(word)
    assert word not in piece_model.words and max(map(len, piece_model.words), default=0) <= 64


# --- 10 ------------------------------------------------------------------------------------------------------------

LABELS = "doc_id long, quality int, toxic int"


def mixed_quality(n=400):
    rng = random.Random(9)
    good = [prose(rng, rng.randint(15, 80)) for _ in range(n)]
    bad = [(" ".join(w.upper() + "!!" for w in prose(rng, 30).split()), " | ".join(prose(rng, 40).split()), " ".join([prose(rng, 1)] * 60), "$$$ ### " * 20)[i % 4] for i in range(n // 4)]
    return [(i, t) for i, t in enumerate(good)] + [(n + i, t) for i, t in enumerate(bad)], n


def test_quality_on_held_out_documents(spark):
    rows, n = mixed_quality()
    labels = spark.createDataFrame([(i, int(i < n), 0) for i, _ in rows if i % 2], LABELS)
    got = {r.doc_id: r for r in resample(clashing(frame(spark, rows)), clashing(labels)).collect()}
    unseen = [i for i, _ in rows if i % 2 == 0]
    assert np.mean([got[i].kept for i in unseen if i < n]) > 0.99
    assert np.mean([got[i].kept for i in unseen if i >= n]) < 0.02
    kept = {r.doc_id for r in keep_good(clashing(frame(spark, rows)), labels).collect()}
    assert kept == {i for i, r in got.items() if r.kept}


def plain_grams(text):
    """Tokens and n-grams in plain terms."""
    w = brute.words(text)
    w = ["again" if n and w[n - 1] == x else x for n, x in enumerate(w)]
    raw = (text or "").encode()
    return [*w, *zip(w, w[1:], strict=False), *(("bytes", raw[n : n + 3]) for n in range(len(raw) - 2))]


def hashed_grams(text):
    return np.concatenate([b for b, _ in n_grams([(text or "").encode()])]).tolist()


def test_n_grams_are_the_plain_ones():
    known = {}
    for t in [*corpus(4, 40), "a a a a", "b b c c b", " x  x\ny"]:
        for gram, bucket in zip(plain_grams(t), hashed_grams(t), strict=True):
            assert known.setdefault(gram, bucket) == bucket
    assert len(set(known.values())) > 0.9 * len(known)


@pytest.mark.parametrize("sample", [None, 0, 7, 60, 1000])
def test_quality_is_the_plain_resampling(spark, sample):
    rows, n = mixed_quality(60)
    rows = [*rows, (200, None), (201, ""), (202, "a a a b"), (203, "x")]
    marks = {i: int(i < n) for i, _ in rows if i % 3 and i < 75}
    labels = spark.createDataFrame([(i, q, 0) for i, q in marks.items()], LABELS)
    got = {r.doc_id: r for r in resample(frame(spark, rows), labels, sample=sample).collect()}
    want = brute.resampled(rows, marks, sample, hashed_grams)
    assert got.keys() == want.keys()
    for i, (ratio, size, kept) in want.items():
        assert (got[i].n_grams, got[i].kept) == (size, kept) and got[i].log_ratio == pytest.approx(ratio, abs=1e-6), i


def test_gumbel_keys_draw_in_proportion_to_the_weights(spark):
    draws = -np.log([0.6, 0.3, 0.1])[None, :] * -1 + np.stack([gumbel(np.arange(3), seed) for seed in range(3000)])
    assert np.bincount(draws.argmax(axis=1)) / 3000 == pytest.approx([0.6, 0.3, 0.1], abs=0.04)


@given(st.lists(st.tuples(st.integers(-9, 9), st.booleans()), max_size=20))
@settings(deadline=None, max_examples=200)
def test_best_cut_makes_the_fewest_errors(rows):
    cut = best_cut([(float(x), g) for x, g in rows])
    errors = lambda c: sum((x > c) != g for x, g in rows)
    if len({g for _, g in rows}) == 2:
        assert errors(cut) <= min(errors(x) for x, _ in rows) + 20 * (len({x for x, _ in rows}) < len(rows))
    else:
        assert cut == float("-inf")


def test_quality_of_odd_rows(spark):
    rows, n = mixed_quality(100)
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (1, None, None), (None, 1, 0), (110, 0, 0)], LABELS)
    got = resample(frame(spark, rows + ODD), labels).collect()
    assert len(got) == len(rows) + len(ODD) and {(r.log_ratio, r.kept) for r in got if r.n_grams == 0} == {(0.0, False)}
    assert all(r.kept for r in resample(frame(spark, rows), labels.limit(0)).collect())
    assert resample(frame(spark, []), labels).count() == 0 and keep_good(frame(spark, []), labels).count() == 0


@given(st.lists(st.text("ab c", max_size=30).map(str.encode), min_size=1, max_size=6))
@settings(deadline=None, max_examples=150)
def test_n_grams_do_not_depend_on_the_batch(texts):
    together = n_grams(texts)
    for i, t in enumerate(texts):
        alone = [b.tolist() for b, _ in n_grams([t])]
        here = [b[f[i] : f[i + 1]].tolist() for b, f in together]
        assert [x for x in here if x] == [x for x in alone if x]
