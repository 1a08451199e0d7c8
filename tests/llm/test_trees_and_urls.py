"""Prefix trie, Merkle manifest and url filter against plain Python, on awkward and skewed tables."""

import hashlib
import math
import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import fixtures as fx  # noqa: E402
from panelcast.llm import merkle_manifest, splitter_trie, url_markov  # noqa: E402

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


# -- prefix trie

def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k in members:
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def talk(seed, convs=300, same=0):
    """Conversations over few distinct turns; the first ``same`` ones are copies of each other."""
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        rr = random.Random(7) if c < same else r
        for t in range(rr.randint(1, 6)):
            rows.append((c, t, rr.choice(["user", "assistant"]), rr.choice(["hello", "ça va", "", "bye " * 3])))
    r.shuffle(rows)
    return rows


def awkward_talk():
    return [(0, None, "user", "null first"), (0, 1, None, "a"), (0, 2, "user", None), (1, 0, "user", "x"), (1, 0, "user", "x"),
            (1, 0, "user", "x"), (2, 5, "b", "tie"), (2, 5, "a", "tie"), (None, 0, "user", "no conversation"), (7, 0, "user", "y" * 100000),
            (-3, 0, "user", "x"), (-5, 0, "user", "x"), (13, 0, "user", "x"), (13, 1, "user", "x"), (104, 0, None, None)]


@pytest.mark.parametrize("rows", [awkward_talk(), talk(1), talk(2, same=120), talk(3, convs=40) + [(500, t, "user", str(t % 7)) for t in range(120)]])
def test_trie_equals_plain_python(spark, rows):
    got = splitter_trie.conversation_nodes(spark.createDataFrame(rows, TURNS))
    assert got.columns == splitter_trie.OUT
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_trie(rows)


@pytest.mark.parametrize("shards, skeleton", [(1, 1000), (3, 1000), (40, 1000), (40, 8)])
def test_trie_is_the_same_for_any_number_of_shards(spark, shards, skeleton):
    rows = talk(4, same=100)
    paths = splitter_trie.rebuilt_paths(spark.createDataFrame(rows, TURNS))
    got = splitter_trie.prefix_trie(paths, len(rows), skeleton, shards)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_trie(rows)


def test_copies_are_cut_into_shards(spark, monkeypatch):
    """A path that all conversations share is spread over shards; its digest is streamed from packed blocks."""
    monkeypatch.setattr(splitter_trie, "BLOCK_IDS", 16)
    rows = [(c, t, "user", "same") for c in range(0, 3000) for t in range(10)]
    paths = splitter_trie.rebuilt_paths(spark.createDataFrame(rows, TURNS))
    spread = paths.repartitionByRange(8, "path", "conv_id").groupBy(spark_partition()).count().collect()
    assert len(spread) == 8 and max(r["count"] for r in spread) < 1500
    got = splitter_trie.prefix_trie(paths, len(rows), shards=8).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_trie(rows)


def spark_partition():
    from pyspark.sql import functions as F
    return F.spark_partition_id()


def test_trie_of_no_conversations_and_further_columns(spark):
    none = spark.createDataFrame([], TURNS)
    assert splitter_trie.conversation_nodes(none).collect() == []
    unowned = spark.createDataFrame([(None, 0, "user", "x")], TURNS)
    assert splitter_trie.conversation_nodes(unowned).collect() == []
    more = fx.clashing(spark.createDataFrame(awkward_talk(), TURNS)).selectExpr("*", "1 AS path", "2 AS shard_", "3 AS units", "4 AS unit")
    got = splitter_trie.conversation_nodes(more)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_trie(awkward_talk())


# -- Merkle manifest

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([sha(*at[k:k + 2]) for k in range(0, len(at), 2)])
    return levels


def plain_manifest(rows):
    trees = defaultdict(list)
    for i, text, lang, source, n in rows:
        hit = i is not None and zlib.crc32(str(i).encode()) % 7 == 0
        bad = n + 1 if hit and n is not None else n
        trees[lang].append(((i is not None, i or 0), plain_leaf(i, source, lang, n, text), plain_leaf(i, source, lang, bad, text), i))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {x: plain_tree([r[1] for r in sorted(trees[x])]) for x in order}
    top = plain_tree([levels[x][-1][0] for x in order])
    out = []
    for t, lang in enumerate(order):
        for k, (_, leaf, given, i) in enumerate(sorted(trees[lang])):
            others, h = [], given
            for ls, at in ((levels[lang], k), (top, t)):
                for level in ls[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else ""
                    others.append(other)
                    h = sha(other, h) if at & 1 else sha(h, other)
                    at >>= 1
            out.append((i, leaf, levels[lang][-1][0], top[-1][0], sha(*others), h, h == top[-1][0]))
    return sorted(map(str, out))


def papers(n, langs, seed=0):
    r = random.Random(seed)
    return [(r.choice([None, i, i, i, i, 3]), fx.prose(i, r.randint(1, 5)), r.choice(langs), r.choice([None, "s", "é"]), r.choice([None, 9, 99, i]))
            for i in range(n)]


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (2, ["en"]), (5, [None]), (300, ["en", "fr", None]), (700, ["en"]), (257, ["en"]),
                                      (200, [f"l{i}" for i in range(60)] + ["é", None, "Z"])])
def test_manifest_equals_plain_python(spark, n, langs):
    rows = papers(n, langs)
    got = merkle_manifest.verify_documents(spark.createDataFrame(rows, fx.DOCS))
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_manifest(rows)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_is_the_same_however_few_levels_are_stored(spark, levels):
    rows = papers(150, ["en", "fr", None], 5)
    got = merkle_manifest.manifest(spark.createDataFrame(rows, fx.DOCS), levels).mapInArrow(
        merkle_manifest._verified, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_manifest(rows)


def test_manifest_of_awkward_repeated_and_no_rows(spark):
    docs = fx.awkward(spark)
    docs = docs.unionByName(docs).unionByName(docs.filter("doc_id = 7"))
    rows = [tuple(r) for r in docs.collect()]
    want = plain_manifest(rows)
    assert sorted(str(tuple(r)) for r in merkle_manifest.verify_documents(docs).collect()) == want
    more = fx.clashing(docs).selectExpr("*", "1 AS tree", "2 AS leaf", "3 AS id", "4 AS place", "5 AS tampered")
    assert sorted(str(tuple(r)) for r in merkle_manifest.verify_documents(more).collect()) == want
    none = merkle_manifest.verify_documents(fx.none_of(spark))
    assert none.count() == 0 and none.columns[0] == "doc_id"


# -- url filter

def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    cut = min([rest.index(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:cut]


def plain_rule(url):
    host, path = plain_parts(url)
    fits = [(len(h + p), h + p, act) for act, h, p in url_markov.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = ["http://a.example.net/en/1", "http://example.net/en", "https://EXAMPLE.Net/fr/", "http://notexample.com/de/x", "http://example.com/de/x",
        "http://x.example.com/en/1?u=/de/", "http://example.com?x=/de/", "http://a.org/fr/", "http://aorg/fr/", "org://org/fr/#y", "nothing", "",
        None, "http://", "://net/", "http://net", "http://net/", "a://b://net/", "http://É.ORG/fr/é\nnew line", "http://x.net:80/en/",
        "http://" + "long" * 50000 + ".org/de/", "HTTP://NET/en/?q#f", "http://example.org/es/1", "http://example.com/fr/1"]


def test_host_path_and_rule_of_every_url(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(0, URLS[0]), (None, URLS[1])], "page_id long, url string")
    for frame in (pages, fx.clashing(pages).selectExpr("*", "1 AS host", "2 AS path", "3 AS verdict", "4 AS rule")):
        got = url_markov.judge_pages(frame).collect()
        assert len(got) == len(URLS) + 2
        for r in got:
            url = URLS[1 if r.page_id is None else r.page_id]
            assert (r.host, r.path) == plain_parts(url)
            assert r.verdict in ("allow", "block")
            rule, act = plain_rule(url)
            assert r.rule == rule and (act is None or r.verdict == act)
            assert (r.score is None) == (rule is not None)
        kept = url_markov.keep_allowed(frame)
        assert kept.columns == frame.columns and kept.count() == sum(r.verdict == "allow" for r in got)


def plain_difference(taught, url):
    """Two dictionaries of counts, one symbol after the other."""
    seen = [defaultdict(Counter), defaultdict(Counter)]
    for text, bad in taught:
        s = [257, *text.encode(), 256]
        for i in range(1, len(s)):
            for k in range(0, url_markov.ORDER + 1):
                if i - k >= 0:
                    seen[bad][tuple(s[i - k:i])][s[i]] += 1
    total = Counter()
    for c in seen:
        for ctx, x in c.items():
            total[ctx] = max(total[ctx], sum(x.values()))
    s, out = [257, *url.encode(), 256], 0.0
    for i in range(1, len(s)):
        ps = []
        for c in seen:
            p = 1 / 257
            for k in range(0, min(i, url_markov.ORDER) + 1):
                ctx = tuple(s[i - k:i])
                n, t = sum(c[ctx].values()) if ctx in c else 0, len(c[ctx]) if ctx in c else 0
                if not n or total[ctx] < url_markov.LEAST:
                    break
                p = (c[ctx][s[i]] + t * p) / (n + t)
            ps.append(p)
        out += math.log(ps[0]) - math.log(ps[1])
    return out / (len(s) - 1)


def test_difference_equals_plain_counting(spark):
    r = random.Random(2)
    taught = [("http://" + "".join(r.choice("abc.é") for _ in range(r.randint(0, 12))) + end, bad)
              for bad, end in ((0, ".org/fr/"), (1, ".net/x")) for _ in range(60)]
    model = url_markov.fit_model(spark.createDataFrame(taught, "url string, rejected int").selectExpr("url", "rejected = 1 AS rejected"))
    asked = ["", "http://abc.org/fr/", "http://cab.net/x", "zzz", "é" * 50, taught[0][0]]
    got = model.scores(pa.array(asked))
    assert np.allclose(got, [plain_difference(taught, u) for u in asked])
    assert got[1] > 0 > got[2]


def test_models_stay_below_their_size_and_keep_the_commonest_contexts(spark):
    taught = [(f"http://h{i}.org/fr/{i * i}", i % 2 == 0) for i in range(400)]
    frame = spark.createDataFrame(taught, "url string, rejected boolean")
    small, whole = url_markov.fit_model(frame, entries=500), url_markov.fit_model(frame)
    assert len(small.pairs) <= 500 < len(whole.pairs)
    assert set(small.contexts) <= set(whole.contexts) and np.uint64(0) in small.contexts


def test_contexts_beyond_the_arrays_are_met_in_the_table(spark, monkeypatch):
    """Scores, curve and verdicts are those of the whole models, however few pairs are broadcast."""
    r = random.Random(9)
    taught = [(f"http://{''.join(r.choice('abcé') for _ in range(r.randint(0, 9)))}{end}{i % 40}", bad)
              for bad, end in ((0, ".org/fr/"), (1, ".net/x")) for i in range(80)]
    frame = spark.createDataFrame(taught, "url string, rejected int").selectExpr("url", "rejected = 1 AS rejected")
    asked = ["", "http://abc.org/fr/1", "http://cab.net/x", "zzz", "é" * 50, taught[0][0], None, taught[0][0]]
    urls = spark.createDataFrame([(u,) for u in asked], "text string")
    for entries in (0, 30, 300):
        model = url_markov.fit_model(frame, entries=entries)
        assert model.rest is not None and len(model.pairs) <= entries
        got = {x.text: x.score for x in url_markov.with_score(urls, model, "text").collect()}
        assert got.pop(None) is None
        assert all(math.isclose(s, plain_difference(taught, u), rel_tol=1e-9, abs_tol=1e-12) for u, s in got.items())
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(taught)] + [(1000 + i, u) for i, u in enumerate(asked)], "page_id long, url string")
    whole = {x.page_id: x for x in url_markov.judge_pages(pages).collect()}
    fit = url_markov.fit_model
    monkeypatch.setattr(url_markov, "fit_model", lambda ruled: fit(ruled, entries=100))
    few = {x.page_id: x for x in url_markov.judge_pages(pages).collect()}
    assert len(few) == pages.count()
    for i, x in whole.items():
        assert x[:5] == few[i][:5] and (x.score is None) == (few[i].score is None)
        assert x.score is None or (math.isclose(x.score, few[i].score, rel_tol=1e-9, abs_tol=1e-12) and math.isclose(x.p_accept, few[i].p_accept, rel_tol=1e-6))


def test_held_out_urls_are_told_apart(spark):
    """Urls of made-up accepted and rejected hosts, a part ruled and the others left to the method."""
    r = random.Random(5)
    word = lambda letters: "".join(r.choice(letters) for _ in range(8))
    rows = []
    for i in range(1600):
        bad = i % 2 == 1
        host = word("xzqk" if bad else "aeiolmn") + (".spam" if bad else ".good") * (i < 800) + ".test"
        rows.append((i, f"https://{host}/{r.randint(1, 99)}"))
    rules = (("block", "spam.test", "/"), ("allow", "good.test", "/"))
    out = url_markov.judged(spark.createDataFrame(rows, "page_id long, url string"), rules)
    got = {x.row.page_id: x for x in out.collect()}
    right = sum((got[i].verdict == "block") == (i % 2 == 1) for i in range(800, 1600))
    assert all(got[i].rule is None for i in range(800, 1600)) and right >= 760
    assert all(got[i].rule for i in range(800))


def test_without_ruled_urls_all_are_allowed_and_no_rows_give_none(spark):
    pages = spark.createDataFrame([(1, "http://a.test/x"), (2, None)], "page_id long, url string")
    assert [r.verdict for r in url_markov.judge_pages(pages).collect()] == ["allow", "allow"]
    assert url_markov.judge_pages(pages.limit(0)).collect() == []
    one = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://a.net/y"), (3, "zzz")], "page_id long, url string")
    assert {r.page_id for r in url_markov.judge_pages(one).collect() if r.verdict == "block"} >= {1, 2}


def test_curve_separates_at_the_crossing():
    x = np.linspace(-1, 1, 201)
    up, down = np.exp(-((x - 0.6) ** 2) * 20) * 100, np.exp(-((x - 0.2) ** 2) * 20) * 900
    slope, offset = url_markov.fit_curve(x, up, down)
    assert slope > 0 and abs(-offset / slope - 0.4) < 0.05
    assert url_markov.fit_curve(x, up, down * 0) == (1.0, 0.0)
