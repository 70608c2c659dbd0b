import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tallywright.llm import bpe, chat, common, mixing, quality, sharding, token_files
from tallywright.session import scratch_path

WORD_FILE, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
ODD = ["", "a", "It's <|endoftext|> 'LL x", "é" * 300, "日本語 テキスト", "\t\x0b\x1c tab\x85\xa0nbsp", "a" * 3000, "🙂 👩‍👩‍👧", "ab" * 2000]


# --- token files


def test_token_files_equal_the_library(make, spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (None, "no id"), (60, "The end.\n\nOf it")]
    folder = scratch_path(spark, "tokens")
    manifest = token_files.write_token_files(make(docs), folder, WORD_FILE, end_id=2)
    got = token_files.read_token_files(spark, folder, batch_docs=2).orderBy("start").collect()
    library, start = Tokenizer.from_file(WORD_FILE), 0
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in order]
    for row, (_, text) in zip(got, order):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (row.start, row.n_tokens, np.frombuffer(row.ids, "<u4").tolist()) == (start, len(ids), ids)
        start += len(ids)
    assert manifest.agg({"n_tokens": "sum"}).first()[0] == start


def test_lower_case_ascii_words_need_the_model_only():
    words, library = token_files.Words(WORD_FILE, "<u2"), Tokenizer.from_file(WORD_FILE)
    words.encode = None
    draw = random.Random(5)
    some = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randrange(1, 30))) for _ in range(2000)]
    for word in [*some, *"0123456789!~", "'s", "'ll", "...", '"#$%&()*+,-./:;<=>?@[]^_`{|}~', "a" * 5000]:
        assert np.frombuffer(words[word], "<u2").tolist() == library.encode(word, add_special_tokens=False).ids


def test_token_files_of_nothing(make, spark):
    folder = scratch_path(spark, "tokens")
    token_files.write_token_files(make([(1, "a")]).limit(0), folder, WORD_FILE, end_id=2)
    assert token_files.read_token_files(spark, folder).count() == 0


# --- sharding


def test_shards_hold_every_row_once(make, spark):
    docs = make([(i % 40, f"text {i}") for i in range(200)] + [(None, None)] * 3 + [(7, "same")] * 500)
    shards = sharding.shuffle_into_shards(docs, scratch_path(spark, "shards"), bucket_bytes=400)
    rows = shards.collect()
    assert sorted(str(r.record) for r in rows) == sorted(map(str, docs.collect()))
    sizes = {}
    for r in rows:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert sorted(sizes) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1


def test_shuffle_repeats_and_is_uniform(make, spark):
    docs = make([(i, f"text {i}") for i in range(400)])
    first, second = (
        {r.record.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(docs, scratch_path(spark, "s"), bucket_bytes=500).collect()}
        for _ in range(2)
    )
    assert first == second
    place = [first[i][0] * 50 + first[i][1] for i in range(400)]
    assert abs(np.corrcoef(range(400), place)[0, 1]) < 0.2
    assert sharding.shuffle_into_shards(docs.limit(0), scratch_path(spark, "s")).count() == 0


# --- mixing


def test_targets_stop_and_excess_is_shared(spark):
    sizes = spark.createDataFrame([("0a", 10), ("0b", 1000), ("0c", 1000), ("1", 50)], "key string, size long")
    got = {r.key: r.target for r in mixing.targets(sizes).collect()}
    assert got["0a"] == 30 and got["1"] == 150
    assert got["0b"] == pytest.approx(1880 * 2 / 3) and got["0c"] == pytest.approx(1880 / 3)


def test_mix_repeats_whole_rows(make):
    draw = random.Random(2)
    docs = make([(i, "w " * draw.randint(0, 40), draw.choice(["a", "b", None])) for i in range(300)] + [(1, None, "z")])
    sizes = mixing.mixed_sizes(docs)
    rows = sizes.collect()
    by_source = {}
    for r in rows:
        assert r.taken <= 3 * r.size
        total = by_source.setdefault((r.source_size, r.target), [0])
        total[0] += r.taken
    assert all(abs(t[0] - target) <= 0.05 * target + 40 for (_, target), t in by_source.items() if target)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert sorted(map(str, sizes.collect())) == sorted(map(str, rows))
    assert mixing.mixed_sizes(docs.limit(0)).count() == 0


# --- byte-level BPE


@pytest.fixture(scope="module")
def tokens():
    return bpe.Bpe(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(tokens, library):
    draw = random.Random(6)
    for k in range(800):
        letters = draw.choice(["ab", "aeth ", "éèàçth .,01\n\t", "日本語漢字", "=-_*# ", "thequickinrao"])
        text = "".join(draw.choice(letters) for _ in range(draw.choice([1, 9, 60, 400])))
        ids = np.frombuffer(tokens.encode(text), "<u4")
        assert ids.tolist() == library.encode_ordinary(text)
        assert tokens.decode(ids) == text.encode()


def test_bpe_remembers_no_more_words_than_asked(library):
    small, text = bpe.Bpe(RANKS, P.PATTERN, memory_words=10), " ".join(f"word{i % 37}x{i}" for i in range(300))
    assert np.frombuffer(small.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    assert len(small.words) <= 10 and len(small.words.older) <= 10
    small.forget()
    assert not small.words and not small.words.older and not small.stable_pairs
    assert np.frombuffer(small.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_workers_give_back_what_they_freed():
    def resident():
        with open("/proc/self/statm") as pages:
            return int(pages.read().split()[1]) * 4096

    # Values that the allocator keeps on its heap, under one that stays.
    values = [b"x" * 2000 + bytes([i % 256]) for i in range(50_000)]
    last, full = values.pop(), resident()
    del values
    common.released()
    assert len(last) == 2001 and resident() < full - (50 << 20)


def test_bpe_join_is_associative(tokens):
    text = b"thequickbrownfoxjumpsoverthelazydogandrunsawayintothewoods" * 4
    whole = tokens.merged(text)
    for cut in (1, 7, 50, 120, len(text) - 1):
        assert tokens.join(tokens.merged(text[:cut]), tokens.merged(text[cut:])) == whole


def test_bpe_round_trip(make, library):
    docs = list(enumerate(ODD)) + [(70, None), (None, "no id"), (71, "twice"), (71, "twice")]
    rows = bpe.round_trip(make(docs), RANKS, P.PATTERN).collect()
    expected = []
    for i, text in docs:
        ids = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
        expected.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(expected, key=str)
    assert bpe.round_trip(make(docs).limit(0), RANKS, P.PATTERN).count() == 0


# --- quality


def brute_longest(w):
    longest = [0] * len(w)
    for a in range(len(w)):
        for b in range(len(w)):
            n = 0
            while a != b and max(a, b) + n < len(w) and w[a + n] == w[b + n]:
                n += 1
            longest[a] = max(longest[a], n)
    return longest


def test_repeat_lengths_equal_brute_force():
    draw = random.Random(3)
    for _ in range(60):
        docs = [[draw.randint(0, 2) for _ in range(draw.choice([0, 1, 5, 40]))] for _ in range(4)]
        codes = np.array([d * 100 + x for d, w in enumerate(docs) for x in w], np.int64)
        stops = np.cumsum([len(w) for w in docs])
        ends = np.repeat(stops, [len(w) for w in docs])
        got = quality.repeat_lengths(codes, ends, 3)
        assert got.tolist() == [n if n >= 3 else 0 for w in docs for n in brute_longest(w)]


def test_quality_cases(make):
    clean = " ".join(f"w{i}" for i in range(200))
    long_repeat = " ".join(f"a{i}" for i in range(1000)) + " " + " ".join(f"a{i}" for i in range(70))
    rows = [(1, clean), (2, "spam ham " * 50), (3, None), (4, ""), (5, long_repeat), (6, clean), (6, clean), (None, clean), (8, "a b\na b\n\n# $|")]
    docs = make(rows)
    got = {(r.doc_id, r.n_words): r for r in quality.measure_quality(docs).collect()}
    assert got[(1, 200)].kept and got[(None, 200)].kept and got[(6, 200)].kept
    assert got[(2, 100)].base_failed and got[(3, 0)].base_failed and got[(4, 0)].base_failed
    assert not got[(5, 1070)].base_failed and not got[(5, 1070)].kept and got[(5, 1070)].longest_repeat == 70
    assert (got[(8, 6)].n_symbols, got[(8, 6)].n_dup_lines, got[(8, 6)].word_chars) == (3, 1, 7)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "6", "6", "None"]
    assert quality.measure_quality(docs.limit(0)).count() == 0


# --- conversations


def test_snapshots_collapse(spark):
    rows = [(c, t, "user" if t % 2 == 0 else None, f"{g}-{t}") for c, g, n in [(1, "x", 2), (2, "x", 4), (3, "x", 4), (4, "y", 3), (5, "x", 3)] for t in range(n)]
    rows += [(6, 0, "user", None), (6, 0, "user", None), (None, 0, "user", "lost"), (6, None, "user", "late"), (7, 0, "user", "x-9")]
    turns = spark.createDataFrame([(*r, "q") for r in rows], "conv_id long, turn int, role string, text string, part string")
    got = {(r.conv_id, r.part): r for r in chat.collapse_and_render(turns, part_turns=3).collect()}
    assert {k[0] for k in got} == {2, 4, 6, 7, None}
    assert (got[(2, 0)].n_turns, got[(2, 0)].n_copies) == (4, 2)
    assert got[(2, 1)].rendered == "<|im_start|>unknown\nx-3<|im_end|>\n"
    assert got[(6, 0)].rendered == "<|im_start|>user\n<|im_end|>\n" and got[(6, 0)].n_turns == 2
    whole = {(r.conv_id, r.n_turns) for r in chat.collapse_and_render(turns).collect()}
    assert whole == {(r.conv_id, r.n_turns) for r in got.values()}
    assert chat.collapse_and_render(turns.limit(0)).count() == 0
