import random
from collections import Counter

import numpy as np
import pytest

from tallywright import session
from tallywright.llm import components, fm_index, induced, minhash, segments, suffix_dedup
from tallywright.llm.exact_dedup import exact_dedup, keep_first

WORDS = "red green blue one two three sun moon sea sky tree bird fish rock sand wind".split()


def words(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) for _ in range(n))


def rows_of(frame, key="doc_id"):
    return sorted(frame.collect(), key=lambda r: (r[key] is None, r[key], str(r)))


# --- exact


def test_exact_nulls_ties_and_repeats(make):
    docs = make([(3, "a b"), (1, "ab"), (2, "a b"), (2, "a b"), (None, "a\tb"), (7, None), (8, ""), (9, " \n")])
    got = exact_dedup(docs).collect()
    assert len(got) == 8
    group = [r for r in got if r.doc_id in (1, 2, 3, None)]
    assert {r.keep_id for r in group} == {2} and {r.group_size for r in group} == {5}
    assert sum(r.kept for r in group) == 1 and [r.doc_id for r in group if r.kept] == [2]
    empty = [r for r in got if r.doc_id in (7, 8, 9)]
    assert {r.keep_id for r in empty} == {9} and {r.group_size for r in empty} == {3}


def test_exact_short_digests_fall_back_to_full_texts(make):
    docs = make([(i, f"text {i % 7}" + " " * (i % 3)) for i in range(60)])
    whole = rows_of(exact_dedup(docs).drop("locator"))
    short = rows_of(exact_dedup(docs, digest_chars=1).drop("locator"))
    assert whole == short


def test_exact_several_batches_and_empty(make, spark):
    docs = make([(i, f"text {i % 5}") for i in range(40)])
    assert rows_of(exact_dedup(docs, files_per_batch=1).drop("locator")) == rows_of(exact_dedup(docs).drop("locator"))
    assert exact_dedup(docs.limit(0)).count() == 0
    kept = keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4]


# --- near duplicates


def brute_components(docs):
    sets = {}
    for i, text in docs:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def chain_documents():
    """Groups of near copies, chains of near copies, and texts that share a passage only."""
    draw, docs = random.Random(5), []
    passage = words(99, 60)
    for g in range(6):
        text = words(g, 120).split()
        for _ in range(12):
            docs.append(" ".join(text))
            at = draw.randrange(120)
            text[at : at + 2] = [f"w{len(docs)}"]
            text += [f"v{len(docs)}"]
    docs += [f"{words(1000 + k, 30)} {passage}" for k in range(60)]
    docs += ["a b c", "A B C", "a b", "", None]
    return list(enumerate(docs))


def test_near_duplicates_equal_brute_force(make):
    docs = chain_documents()
    expected = brute_components(docs)
    got = {r.doc_id: r for r in minhash.near_duplicates(make(docs)).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == expected
    assert all(r.kept == (i == expected[i][1]) for i, r in got.items())


def test_near_duplicates_prefix_join_finds_all(make, monkeypatch):
    """Without the star checks, the exact join over open buckets finds every link alone."""
    docs = [(i, t) for i, t in chain_documents() if t]
    everything = make(docs)
    expected = brute_components(docs)
    rows = minhash.identified(everything, "doc_id", "text")
    nodes = rows.selectExpr("doc_id as node", "doc_id", "twin")
    sets = minhash.written(minhash._sets_of(rows, nodes, 5), "sets")
    open_nodes = nodes.selectExpr("node", "node as label")
    links = minhash._confirmed(minhash._prefix_pairs(open_nodes, sets, 75), sets, 75)
    labels = {r.node: r.label for r in minhash.component_labels(links).collect()}
    assert {i: labels.get(i, i) for i, _ in docs} == {i: v[1] for i, v in expected.items()}


def test_near_duplicates_links_short_texts_that_share_no_band(make):
    draw, hashing = random.Random(4), minhash.MinMax(minhash.BANDS, minhash.BAND_VALUES)
    longer = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(8)) for _ in range(30_000)]
    pairs = [(t, t.rsplit(" ", 1)[0]) for t in longer]
    keys = [hashing.keys(minhash.shingle_sets([p[k].encode() for p in pairs], 5)) for k in (0, 1)]
    apart = [p for p, a, b in zip(pairs, *keys) if not set(a.tolist()) & set(b.tolist())]
    assert apart
    docs = [(i, t) for i, t in enumerate(t for p in apart for t in p)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(make(docs)).collect()}
    assert got == {i: (4 - i % 2, i - i % 2) for i, _ in docs}


def test_near_duplicates_nulls_and_repeats(make):
    text = words(3, 50)
    docs = make([(None, text), (4, text), (4, text), (2, text + " more"), (None, None), (9, words(8, 50))])
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == 6 and sum(r.kept for r in got) == 3
    assert {r.component_id for r in got if r.n_shingles and r.doc_id != 9} == {2}
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "9", "None"]


def test_min_and_max_estimate_without_bias():
    draw = np.random.default_rng(1)
    shared = draw.integers(0, 1 << 64, 300, np.uint64)
    a, b = (np.concatenate([shared, draw.integers(0, 1 << 64, 50, np.uint64)]) for _ in range(2))
    rows = minhash.MinMax(100, 4).signatures([a, b])
    assert abs((rows[0] == rows[1]).mean() - 300 / 400) < 0.08


# --- word windows


def brute_windows(docs, size):
    seen, found = set(), {}
    order = sorted(docs, key=lambda d: d[0])
    for i, text in order:
        w = (text or "").split()
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            if key in seen:
                gone[s : s + size] = [True] * size
            seen.add(key)
        found[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return found


def passages(n, seed=1):
    draw, shared = random.Random(seed), [words(500 + k, 30) for k in range(4)]
    docs = [(i, " ".join(words(seed * 1000 + i * 5 + k, 12) + " " + draw.choice(shared) for k in range(3))) for i in range(n)]
    return docs + [(n, docs[0][1]), (n + 1, "x " * 60), (n + 2, None), (n + 3, "short"), (n + 4, "x " * 30 + "\ty")]


@pytest.mark.parametrize("hot", [1, 20_000])
def test_word_windows_equal_brute_force(make, hot):
    docs = passages(60)
    got = fm_index.remove_repeated_windows(make(docs), window=8, gram=3, hot_route=hot, shard_bytes=2000)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got.collect()} == brute_windows(docs, 8)


def test_word_windows_nulls_and_repeats(make):
    text = words(1, 40)
    docs = make([(None, text), (2, text), (2, text), (1, "other " + text), (5, "")])
    got = rows_of(fm_index.remove_repeated_windows(docs))
    assert [(r.doc_id, r.n_removed) for r in got] == [(1, 0), (2, 40), (2, 40), (5, 0), (None, 40)]
    assert fm_index.remove_repeated_windows(docs.limit(0)).count() == 0


def test_fm_index_counts():
    draw = np.random.default_rng(2)
    seqs = [draw.integers(0, 4, draw.integers(3, 30)) for _ in range(40)]
    text = np.concatenate(seqs)
    lengths = np.array([len(s) for s in seqs])
    index = fm_index.FmIndex(text, lengths)
    stops = np.cumsum(lengths)
    ends, counts = [], Counter(tuple(s[i : i + 3]) for s in seqs for i in range(len(s) - 2))
    for s, stop in zip(seqs, stops):
        ends += [(stop - len(s) + i + 2, tuple(s[i : i + 3])) for i in range(len(s) - 2)]
    length, _ = index.matches(text, np.array([e for e, _ in ends]), 3)
    assert [n == 3 for n in length] == [counts[key] > 1 for _, key in ends]


# --- byte strings


def brute_strings(docs, size):
    counts = Counter()
    texts = [(i, (t or "").encode()) for i, t in docs]
    for _, t in texts:
        counts.update(t[s : s + size] for s in range(len(t) - size + 1))
    found = []
    for i, t in texts:
        gone = [False] * len(t)
        for s in range(len(t) - size + 1):
            if counts[t[s : s + size]] > 1:
                gone[s : s + size] = [True] * size
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        found.append((i, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(found, key=str)


@pytest.mark.parametrize("hot", [1, 20_000])
def test_byte_strings_equal_brute_force(make, hot):
    docs = passages(40, seed=2) + [(900, "é" * 90), (901, "ab" * 50), (902, None), (903, "é" * 40)]
    got = suffix_dedup.remove_repeated_strings(make(docs), window=40, gram=9, hot_route=hot, shard_bytes=5000)
    rows = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()]
    assert sorted(rows, key=str) == brute_strings(docs, 40)


def test_byte_strings_nulls_and_repeats(make):
    text = words(4, 60)
    docs = make([(None, text), (2, words(5, 60)), (2, words(5, 60)), (3, None), (4, words(6, 60))])
    got = rows_of(suffix_dedup.remove_repeated_strings(docs))
    assert [(r.doc_id, r.n_removed > 0) for r in got] == [(2, True), (2, True), (3, False), (4, False), (None, False)]
    assert suffix_dedup.remove_repeated_strings(docs.limit(0)).count() == 0


def brute_suffixes(text, cap):
    n = len(text)
    order = sorted(range(n), key=lambda i: [x + n if x else n - 1 - i - j for j, x in enumerate(text[i:])])
    shared = [0] * n
    for k in range(1, n):
        a, b = order[k - 1], order[k]
        while shared[k] < cap and max(a, b) < n and text[a] == text[b] != 0:
            shared[k], a, b = shared[k] + 1, a + 1, b + 1
    return order, shared


@pytest.mark.parametrize("memory,names,few", [(1 << 20, 1 << 20, 12), (5, 0, 0), (10, 10, 2)])
def test_induced_sorting_equals_plain_sorting(monkeypatch, memory, names, few):
    monkeypatch.setattr(induced, "FEW", few)
    monkeypatch.setattr(induced, "ROUND", 7)
    draw = random.Random(memory + names)
    for _ in range(150):
        symbols, text = draw.choice([1, 2, 5]), []
        for _ in range(draw.choice([1, 3, 8])):
            piece = [draw.randint(1, symbols) for _ in range(draw.choice([1, 4, 20]))]
            text += (piece + [0]) * draw.choice([1, 2])
        cap = draw.choice([1, 3, 100])
        order, shared = induced.sort_suffixes(np.array(text), cap, memory, names)
        assert (order.tolist(), shared.tolist()) == brute_suffixes(text, cap)


def test_equal_windows_share_a_route():
    draw = np.random.default_rng(4)
    shape = segments.Shape("byte", 12, 4)
    codes = segments.BYTE_CODES[draw.integers(0, 3, 4000)]
    found = segments.cut(codes, np.array([0, 2500]), np.array([2500, 4000]), shape)
    assert found.windows.sum() == 2500 - 11 + 1500 - 11
    route = {}
    for d, r, s, n in zip(found.document, found.route, found.start, found.windows):
        base = 0 if d == 0 else 2500
        for i in range(s, s + n):
            key = codes[base + i : base + i + 12].tobytes()
            assert route.setdefault(key, r) == r


def test_anchors_do_not_depend_on_the_slice(monkeypatch):
    # Hashes that differ in low bits only: short and long slices must rank them alike.
    shape = segments.Shape("byte", 12, 4)
    draw = np.random.default_rng(9)
    own = draw.integers(0, 256, 300).astype(np.uint64)
    noise = draw.integers(0, 256, 200_000).astype(np.uint64)
    monkeypatch.setattr(segments, "gram_hashes", lambda codes, m: (codes[: len(codes) - m + 1] << np.uint64(12)) + np.uint64(1 << 50))

    def routes(codes, starts, stops):
        found = segments.cut(codes, np.array(starts), np.array(stops), shape)
        last = found.document == len(starts) - 1
        return [x[last].tolist() for x in (found.route, found.start, found.windows)]

    assert routes(own, [0], [300]) == routes(np.concatenate([noise, own]), [0, 200_000], [200_000, 200_300])


def _reachable(links):
    least = {}

    def find(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return {x: find(x) for x in least if find(x) != x}


def test_components_take_no_round_for_stars_and_look_at_new_links_only(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(components, "written", lambda df, name: tables.append(session.written(df, name)) or tables[-1])
    stars = [(i % 7, 10 + i) for i in range(90)] * 2 + [(3, 3)]
    labels = session.written(components.component_labels(spark.createDataFrame(stars, "u long, v long")))
    assert {tuple(r) for r in labels.collect()} == set(_reachable(stars).items()) and labels.count() == 90
    assert len(tables) == 1  # the links; every further table is a round
    path = [(i, i + 1) for i in range(200, 240)] + [(500, i) for i in range(300, 320)] + [(96, 240), (97, 500), (1, 1)]
    more = components.with_links(labels, spark.createDataFrame(path, "u long, v long"))
    every = _reachable(stars + path)
    assert {tuple(r) for r in more.collect()} == set(every.items()) and more.count() == len(every)
    assert not tables[1].where("u BETWEEN 10 AND 95 OR v BETWEEN 10 AND 95").count()
