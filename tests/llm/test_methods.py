"""Operators against brute force, exact round trips or held-out accuracy on small data."""

import hashlib
import itertools
import math
import os
import random
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import fixtures as fx  # noqa: E402
from panelcast.llm import (chunk_dedup, cuts, langid, lookup_sharding, mixing_lm, order_minhash, pu_quality,  # noqa: E402
                           spaced_seed, stable_ann, suffix_dedup, swap_packing)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- spaced seeds

def test_masks_find_every_three_substitutions_in_fifteen_words():
    for spoiled in itertools.combinations(range(15), 3):
        assert any(all(q + o not in spoiled for o in m) for q in range(15 - spaced_seed.SPAN + 1) for m in spaced_seed.MASKS)


def test_substituted_passages_are_found_and_clean_texts_left(spark):
    item = fx.prose(9, 40)
    r = random.Random(3)
    rows, want = [], set()
    for i in range(30):
        words = item.split()
        for at in r.sample(range(40), i % 7):
            words[at] = "other"
        rows.append((i, fx.prose(100 + i, 50) + ". " + " ".join(words).upper() + ", " + fx.prose(200 + i, 20)))
        want.add(i)
    rows += [(100 + i, fx.prose(300 + i, 120)) for i in range(30)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id for x in spaced_seed.contaminated_pairs(d, bench).collect()}
    assert got <= want and len(want - got) <= 1 and {i for i in want if i % 7 <= 3} <= got


# -- order MinHash

def edit_distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_alignment_decides_like_the_full_table():
    r = random.Random(5)
    pairs, want = [], []
    for _ in range(300):
        a = [r.randrange(6) for _ in range(r.randrange(0, 60))]
        b = list(a)
        for _ in range(r.randrange(0, 16)):
            at = r.randrange(len(b) + 1)
            op = r.randrange(3)
            if op == 0:
                b.insert(at, r.randrange(6))
            elif b and at < len(b):
                if op == 1:
                    b.pop(at)
                else:
                    b[at] = r.randrange(6)
        pairs.append((np.array(a, np.uint64) * np.uint64(8), np.array(b, np.uint64) * np.uint64(8)))
        want.append(not max(len(a), len(b)) or edit_distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9))
    assert order_minhash.aligned(pairs).tolist() == want


def test_order_matters_to_the_sketch():
    words = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = order_minhash.sketch(order_minhash.labelled_kmers(words))
    swapped = order_minhash.sketch(order_minhash.labelled_kmers(np.concatenate([words[100:], words[:100]])))
    same = order_minhash.sketch(order_minhash.labelled_kmers(words.copy()))
    assert (whole == same).all() and (whole == swapped).mean() < 0.5
    long = np.tile(words, 400)  # in parts, with occurrences
    labels = order_minhash.labelled_kmers(long)
    assert len(np.unique(labels)) == len(labels) and len(order_minhash.sketch(labels)) == order_minhash.SKETCHES


def test_classes_are_the_components_of_near_pairs(spark):
    r = random.Random(8)
    rows, words = [], {}
    for g in range(25):
        base = fx.prose(1000 + g, 60 + g).split()
        for c in range(g % 5 + 1):
            own = list(base)
            for _ in range(c):
                own[r.randrange(len(own))] = f"w{r.random()}"
            rows.append((len(rows), " ".join(own)))
            words[rows[-1][0]] = own
    got = {x.doc_id: x.class_id for x in order_minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    parent = {i: i for i in words}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(words, 2):
        a, b = words[i], words[j]
        if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and edit_distance(a, b) <= 0.2 * max(len(a), len(b)):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    assert got == {i: find(i) for i in words}


def test_a_large_near_group_is_one_class_with_few_links(spark):
    base = fx.prose(5, 80).split()
    rows = [(i, " ".join(w if j != (i % 80) else f"edit{i}" for j, w in enumerate(base))) for i in range(400)]
    got = order_minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}


def test_near_pairs_on_a_shared_template_are_linked(spark):
    """Runs of template sketches are led by strangers; the pairs behind them must be found all the same."""
    r = random.Random(12)
    template, rows = fx.prose(6, 150).split(), []
    for pair in range(60):
        own = [f"p{pair}w{i}" for i in range(50)]
        for copy in range(2):
            edited = [f"e{r.random()}" if copy and i % 3 == 0 else w for i, w in enumerate(own)]  # 17 of 200 words
            rows.append((len(rows), " ".join(template + edited)))
    r.shuffle(rows)
    got = {x.doc_id: x.class_id for x in order_minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(120)}


def test_all_near_texts_of_a_long_run_meet():
    """Cells of blocks find every link between different labels once, also where two texts share several runs."""
    import pyarrow as pa
    r = random.Random(13)
    words = [[r.randrange(40) for _ in range(r.randrange(30, 60))] for _ in range(60)]
    words += [w[:-3] + [99, 98, 97] for w in words] + [[7] * 300 + w for w in words[:3]] + [[7] * 290 + [5] * 5 + words[0]]
    text = [" ".join(f"w{x}" for x in w).encode() for w in words]
    hashes = [order_minhash.word_hashes(t) for t in text]
    bins = [order_minhash.histogram(h).tobytes() for h in hashes]
    n = len(words)
    block = [r.randrange(2) for _ in range(n)]
    keys = [[5, *([-3] if i % 2 else []), *([9] if i % 3 else [])] for i in range(n)]

    def cell(key, rows, one):
        rows = [i for i in rows if key in keys[i]]
        t = pa.table({"node": pa.array(rows, pa.int64()), "label": pa.array([i // 2 for i in rows], pa.int64()),
                      "words": pa.array([len(words[i]) for i in rows], pa.int64()), "bins": pa.array([bins[i] for i in rows], pa.binary()),
                      "text": pa.array([text[i] for i in rows], pa.binary()), "keys": pa.array([keys[i] for i in rows], pa.list_(pa.int64())),
                      "key": [key] * len(rows), "one": [one] * len(rows), "side": pa.array([0 if one else block[i] for i in rows], pa.int32())})
        return list(zip(*[c.to_pylist() for c in order_minhash._cell(t).columns]))

    found = []
    for key in (5, -3, 9):
        found += cell(key, [i for i in range(n) if not block[i]], True) + cell(key, [i for i in range(n) if block[i]], True)
        found += cell(key, list(range(n)), False)
    pairs = [p for p in itertools.combinations(range(n), 2) if p[0] // 2 != p[1] // 2]
    near = {p for p, ok in zip(pairs, order_minhash.aligned([(hashes[a], hashes[b]) for a, b in pairs])) if ok}
    assert len(found) == len(set(found)) and set(found) == near and len(near) > 50


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    got = {r.node: r.label for r in order_minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100}


# -- language

def test_language_accuracy_on_the_held_out_fold(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify_documents(d).filter("held_out").join(d.select("doc_id", "lang"), "doc_id").collect()
    right = [r.lang == r.lang_pred for r in got]
    assert len(right) > 100 and np.mean(right) > 0.95
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


# -- nearest neighbours

def test_chi_square_law():
    assert abs(stable_ann.chi_square_cdf(15.507, 8) - 0.95) < 1e-4


def test_recall_and_scores_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((12, 24))
    x = (centre[rng.integers(0, 12, 2500)] + 0.6 * rng.standard_normal((2500, 24)))
    x[7] = x[57]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in stable_ann.nearest_fiftieths(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r["rank"]))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q in range(0, 2500, 50):
        cos = unit @ unit[q]
        cos[q] = -2
        best = sorted(range(2500), key=lambda i: (-cos[i], i))[:5]
        assert [r for _, _, r in got[q]] == [1, 2, 3, 4, 5]
        assert all(abs(s - cos[i]) < 1e-12 for i, s, _ in got[q])
        hit += len(set(best) & {i for i, _, _ in got[q]})
    assert hit / (50 * 5) >= 0.9


def test_repeated_rows_take_no_places(spark):
    """Copies of the nearest rows, and other vectors under their ids, leave the other neighbours in."""
    rng = np.random.default_rng(5)
    q = rng.standard_normal(16)
    at = lambda far: (q + far * rng.standard_normal(16)).tolist()
    rows = [(0, q.tolist())] + [(i, at(0.02 * i)) for i in range(1, 31)]
    rows += [rows[1]] * 7 + [rows[2]] * 5                   # repeated rows
    rows += [(3, at(0.001 * j)) for j in range(1, 9)]       # one id, many near vectors
    rows += [(50, at(0.3))] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in stable_ann.nearest_fiftieths(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    vec = {}
    for i, v in rows:
        vec.setdefault(i, []).append(np.array(v) / np.linalg.norm(v))
    for query in (0, 50):
        best = {i: max(float(v @ vec[query][0]) for v in vs) for i, vs in vec.items() if i != query}
        want = sorted(best, key=lambda i: (-best[i], i))[:5]
        assert [i for i, _ in got[query]] == want
        assert all(abs(s - best[i]) < 1e-12 for i, s in got[query])


# -- language model

def test_base_scores_against_counting(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    split = lambda t: (t or "").encode().lower().split() + [b""]
    count = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            for w in split(r.text):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in mixing_lm.score_documents(docs).collect()}
    better = []
    for r in rows:
        words, g = split(r.text), got[r.doc_id]
        base = sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in words)
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(words), sum(w in count for w in words), n)
        assert g.base_score == pytest.approx(base, rel=1e-9)
        assert g.score < 0 and g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        better.append(g.score > g.base_score)
    assert np.mean(better) > 0.8


def test_rare_words_meet_their_counts_in_the_join(spark, docs, monkeypatch):
    whole = {r.doc_id: r.score for r in mixing_lm.score_documents(docs).collect()}
    monkeypatch.setattr(mixing_lm, "FREQUENT", 50)
    few = {r.doc_id: r.score for r in mixing_lm.score_documents(docs).collect()}
    assert all(few[i] == pytest.approx(whole[i], rel=1e-9) for i in whole)


def test_class_probabilities_sum_to_one():
    """Mixing decides bits; over all classes of a next word they sum to one."""
    rng = np.random.default_rng(4)
    leaf = rng.integers(0, 5, (mixing_lm.CONTEXTS, mixing_lm.CLASSES))
    logits, seen = mixing_lm.node_logits(leaf)
    from types import SimpleNamespace
    model = SimpleNamespace(plain=logits[0], logits=[logits.ravel()] * 3, seen=seen.ravel())
    prefix = rng.integers(0, mixing_lm.CLASSES, 20)
    n = mixing_lm.CLASSES
    k = np.concatenate([np.append(prefix, c) for c in range(n)])
    ctx = np.tile(rng.integers(0, mixing_lm.CONTEXTS, (3, 21)), (1, n))
    starts, sizes = np.arange(n) * 21, np.full(n, 21)
    whole = mixing_lm.class_bits(model, k, ctx, starts, sizes)
    head = mixing_lm.class_bits(model, prefix, ctx[:, :20], np.array([0]), np.array([20]))[0]
    assert np.sum(10 ** (whole - head)) == pytest.approx(1, abs=1e-3)


def test_nodes_of_a_class_lie_together():
    """Every node has a place of its own; those of a class are in at most five cache lines of 16 numbers."""
    nodes = mixing_lm.NODES
    seen = {(b, k >> (mixing_lm.BITS - b)): int(nodes[k, b]) for k in range(mixing_lm.CLASSES) for b in range(mixing_lm.BITS)}
    assert len(set(seen.values())) == len(seen) == mixing_lm.CLASSES - 1 and max(seen.values()) < mixing_lm.WIDTH
    assert max(len(set(row // 16)) for row in nodes) <= 5


def test_lanes_at_a_time_do_not_change_the_mixing(monkeypatch):
    from types import SimpleNamespace

    rng = np.random.default_rng(6)
    logits, seen = mixing_lm.node_logits(rng.integers(0, 90, (mixing_lm.CONTEXTS, mixing_lm.CLASSES)))
    model = SimpleNamespace(plain=logits[0], logits=[logits.ravel()] * 3, seen=seen.ravel())
    sizes = np.array([5, 1, 1300, 40, 700, 2])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    k, ctx = rng.integers(0, mixing_lm.CLASSES, sizes.sum()), rng.integers(0, mixing_lm.CONTEXTS, (3, sizes.sum()))
    whole = mixing_lm.class_bits(model, k, ctx, starts, sizes)
    monkeypatch.setattr(mixing_lm, "LANES", 2)
    assert np.allclose(mixing_lm.class_bits(model, k, ctx, starts, sizes), whole, rtol=1e-12) and (whole < 0).all()
    assert len(mixing_lm.class_bits(model, k[:0], ctx[:, :0], starts[:0], sizes[:0])) == 0


def test_words_keep_their_columns_as_more_come():
    import xxhash

    words = mixing_lm.Interner()
    for text in (b"A b a", b"", b"c b \xff\xfe d"):
        index = words.indexes(text)
        full, ending, k = words.columns()
        asked = [*text.lower().split(), b""]
        assert [words.words[i] for i in index] == asked
        assert full[index].tolist() == [xxhash.xxh64_intdigest(w) for w in asked]
        assert ending[index].tolist() == [xxhash.xxh64_intdigest(w[-2:], 1) for w in asked]
        assert k[index].tolist() == mixing_lm.word_class(full[index], ending[index]).tolist()


# -- chunks

def test_gear_hash_by_doubling_is_the_rolling_hash():
    data = np.random.default_rng(1).integers(0, 256, 500).astype(np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = ((h << 1) + int(chunk_dedup.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert chunk_dedup.gear_hashes(data).tolist() == want


def test_cuts_keep_their_sizes_and_characters_and_resist_shifts():
    text = (fx.prose(4, 600) + " Größe été 漢字 ").encode() * 2
    data = np.frombuffer(text, np.uint8)
    ends = chunk_dedup.cut_points(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(text) and (sizes[:-1] >= chunk_dedup.MIN_CHUNK - 3).all() and (sizes <= chunk_dedup.MAX_CHUNK).all()
    pieces = [text[a:b] for a, b in zip([0, *ends], ends)]
    assert all(p.decode("utf-8") is not None for p in pieces)
    moved = b"inserted words " + text
    e2 = chunk_dedup.cut_points(np.frombuffer(moved, np.uint8))
    assert len({moved[a:b] for a, b in zip([0, *e2], e2)} & set(pieces)) > 0.9 * len(set(pieces))
    plain = np.full(5000, 97, np.uint8)
    assert sum(np.diff([0, *chunk_dedup.cut_points(plain)])) == 5000


def test_chunk_dedup_against_a_dictionary(spark, docs):
    import xxhash
    seen, want = set(), {}
    for r in sorted(docs.select("doc_id", "text").collect(), key=lambda r: r.doc_id):
        raw = (r.text or "").encode()
        ends = chunk_dedup.cut_points(np.frombuffer(raw, np.uint8))
        spans = []
        for a, b in zip([0, *ends], ends):
            d = xxhash.xxh3_128_digest(raw[a:b])
            if d in seen:
                spans.append((a, b))
            seen.add(d)
        runs = cuts.merged(np.array([a for a, _ in spans]), np.array([b for _, b in spans]), chunk_dedup.MIN_RUN)
        want[r.doc_id] = (len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(cuts._kept(raw, runs)).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in chunk_dedup.dedup_digests(docs).collect()}
    assert got == want and sum(v[1] for v in got.values()) > 0
    for r in chunk_dedup.dedup_texts(docs).collect():
        assert hashlib.sha256((r.text or "").encode()).hexdigest() == want[r.doc_id][3] and r.n_chars == len(r.text)


def test_passages_of_fifty_words_are_cut_after_their_first_text(spark):
    passage = fx.prose(42, 60)
    rows = [(i, fx.prose(500 + i, 40) + " " + passage + " " + fx.prose(700 + i, 40)) for i in range(12)]
    rows += [(100 + i, fx.prose(900 + i, 150)) for i in range(12)]
    got = {r.doc_id: r.n_removed for r in chunk_dedup.dedup_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == 0 and all(got[i] > 0.5 * len(passage) for i in range(1, 12)) and all(got[100 + i] == 0 for i in range(12))


@pytest.mark.parametrize("dedup", [chunk_dedup.dedup_digests, suffix_dedup.dedup_digests])
def test_thousands_of_texts_under_a_null_id_keep_apart(spark, dedup):
    """Cuts of one text must not reach another with the same id."""
    passage = fx.prose(43, 60)
    clean = [fx.prose(20_000 + i, 30) for i in range(3000)]
    shared = [fx.prose(30_000 + i, 10) + " " + passage + " " + fx.prose(40_000 + i, 10) for i in range(500)]
    d = spark.createDataFrame([(None, t) for t in clean + shared], "doc_id long, text string")
    got = {}
    for r in dedup(d).collect():
        got.setdefault(r.kept_sha256, []).append(r.n_removed)
    assert all(got.get(hashlib.sha256(t.encode()).hexdigest()) == [0] for t in clean)
    cut = [n for removed in got.values() for n in removed if n]
    assert len(cut) >= 490 and min(cut) >= 100
    if dedup is suffix_dedup.dedup_digests:
        assert len(cut) == 499 and min(cut) >= len(passage)


# -- sharding

def test_table_shares_and_small_disruption():
    names = [f"s{i}" for i in range(10)]
    full = lookup_sharding.fill_table(names, 1009)
    counts = np.bincount(full, minlength=10)
    assert counts.max() - counts.min() <= 1
    less = lookup_sharding.fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(full, less) if a != 9)
    assert moved < 0.1 * 1009
    with pytest.raises(ValueError):
        lookup_sharding.fill_table(names, 1000)
    with pytest.raises(ValueError):
        lookup_sharding.fill_table([], 1009)


def test_placement_against_python(spark, docs):
    names = [f"shard-{i:03d}" for i in range(64)]
    owner = lookup_sharding.fill_table(names)
    for r in lookup_sharding.place_documents(docs).collect():
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % lookup_sharding.SLOTS
        assert (r.slot, r.shard) == (slot, names[owner[slot]])


# -- packing

def test_words_have_the_tokenizers_ids(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path(swap_packing.VOCABULARY)
    tok, words = Tokenizer.from_file(path), swap_packing.WordIds(path)
    odd = [r.text or "" for r in fx.awkward(spark).collect()] + ["don't they'll I'M 3rd a_b <|startoftext|>x   ÀÉ×÷ª tab\tnew\r\nline \x1c x", "ΑΣ ΣΑΣ", "ŉ ǅ ß ẞ"]
    for text in odd + [r.text or "" for r in docs.limit(120).collect()]:
        assert np.frombuffer(words.ids(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text[:60]


def test_packing_is_whole_gapless_and_tight(spark, docs):
    got = swap_packing.pack_documents(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for off, size in sorted(parts):
            assert off == at
            at += size
        assert at <= 4096
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // 4096) * 1.02 + 1
    assert len({(r.doc_id, r.piece) for r in got}) == len(got) and len({r.doc_id for r in got}) == docs.count()


def test_local_search_empties_bins_that_best_fit_leaves():
    lengths = [6, 5, 5, 4, 4, 3, 3]  # 30: three bins of 10 take exactly two exchanges
    start = [[0], [1], [2], [3, 4], [5, 6]]
    got = swap_packing.local_search(lengths, start, 10)
    assert sorted(i for b in got for i in b) == list(range(7)) and all(sum(lengths[i] for i in b) <= 10 for b in got)
    assert len(got) < len(start)
    r = random.Random(1)
    many = [r.randrange(1, 4096) for _ in range(800)]
    bins = swap_packing.pack(many)
    assert sorted(i for b in bins for i in b) == list(range(800)) and len(bins) <= len(swap_packing.best_fit(many, 4096))


# -- suffixes

def test_suffix_order_by_grouping():
    r = random.Random(2)
    for _ in range(1500):
        s = [r.randrange(r.choice([1, 2, 3, 6])) for _ in range(r.randrange(0, 70))]
        assert suffix_dedup.suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_suffixes(rows, length=100):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        cover = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            if w in seen:
                cover[i] += 1
                cover[i + length] -= 1
            seen.add(w)
        gone = np.cumsum(cover[:-1]) > 0
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[doc] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2048, 2])
def test_suffix_dedup_against_a_set_of_all_strings(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    passage = fx.prose(4, 60)
    top = max(i for i, _ in rows)
    rows += [(top + 1 + i, fx.prose(600 + i, i) + passage[i % 7:] + fx.prose(800 + i, 9)) for i in range(40)]
    rows += [(top + 100, "ab" * 300), (top + 101, "x" * 250), (top + 102, "x" * 99), (top + 103, "ab" * 60 + "c" * 120)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in suffix_dedup.dedup_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_suffixes(rows)


# -- quality

def test_quality_of_the_held_out_fold(spark):
    base = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = pu_quality.score_documents(d, lab).filter("held_out").join(lab, "doc_id").collect()
    assert len(got) > 40 and np.mean([r.predicted == r.quality for r in got]) > 0.9


def test_nnpu_separates_what_it_may():
    rng = np.random.default_rng(1)
    p, n = rng.normal(1.5, 1, (600, 3)), rng.normal(-1.5, 1, (300, 3))
    w1, b1, w2, b2 = pu_quality.fit_nnpu(p[:300], np.concatenate([p[300:], n]), 0.5, epochs=30)
    f = lambda x: np.maximum(0, x @ w1 + b1) @ w2 + b2[0]
    assert (f(p) > 0).mean() > 0.9 and (f(n) < 0).mean() > 0.9


# -- texts longer than one part

def test_long_texts_in_parts(spark, docs, monkeypatch):
    whole = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_documents(docs).collect()}
    monkeypatch.setattr(langid, "PART", 4000)
    parts = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_documents(docs).collect()}
    assert np.mean([whole[i][0] == parts[i][0] for i in whole]) > 0.98
    data = np.frombuffer(fx.prose(3, 3000).encode(), np.uint8)
    offs = np.array([0, 0, len(data)])
    one = pu_quality.described(data, offs)
    monkeypatch.setattr(pu_quality, "PART", 5000)
    assert np.allclose(one, pu_quality.described(data, offs), atol=0.25) and (one[0] == 0).all()


def test_histograms_never_rule_out_a_near_pair():
    r = random.Random(11)
    for n in (1, 2, 3, 9, 40, 200, 3000):
        for vocabulary in (3, 50, 5000):
            a = [r.randrange(vocabulary) for _ in range(n)]
            for edits in (0, int(n * 0.1), int(n * 0.2)):
                b = list(a)
                for _ in range(edits):
                    at = r.randrange(len(b)) if b else 0
                    kind = r.randrange(3)
                    if kind == 0 and b:
                        b[at] = r.randrange(vocabulary)
                    elif kind == 1 and len(b) > 1:
                        del b[at]
                    else:
                        b.insert(at, r.randrange(vocabulary))
                one, two = (order_minhash.word_hashes(" ".join(f"w{x}" for x in t).encode()) for t in (a, b))
                if order_minhash.aligned([(one, two)])[0]:
                    assert order_minhash._may_be_near(np.array([len(two)]), order_minhash.histogram(two)[None], len(one),
                                                      order_minhash.histogram(one))[0]
    far = [order_minhash.word_hashes(" ".join(f"w{r.randrange(60)}" for _ in range(100)).encode()) for _ in range(2)]
    assert not order_minhash._may_be_near(np.array([100]), order_minhash.histogram(far[1])[None], 100, order_minhash.histogram(far[0]))[0]
