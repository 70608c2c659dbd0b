"""Ranked search, conversation repair and language-model scores against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tallywright.llm import lm_scoring, ranked_search, repair

# --- ranked search


def brute_ranks(docs, items, k):
    def terms(text):
        return ranked_search.TERM.findall((text or "").encode().lower())

    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 100 - 50 + (50 * c.total() * n_docs) // total if total else 0
            s = 0
            for w in set(terms(text)) & set(c):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                s += weight * ((10**9 * c[w]) // (1000 * c[w] + 20 * m))
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("options", [{}, {"shard_postings": 60, "block_items": 3}])
def test_search_equals_brute_force(spark, options):
    draw = random.Random(3)
    words = "alpha beta gamma delta Été naïve x1 42 zeta eta the of".split()
    docs = [(i, " ".join(draw.choice(words) for _ in range(draw.randrange(0, 30)))) for i in range(120)]
    docs += [(i, docs[7][1]) for i in range(200, 215)]  # copies with equal scores
    docs += [(300, None), (301, ""), (302, "--- !!"), (None, "alpha beta"), (5, docs[5][1]), (303, "alpha " * 30_000 + "unique")]
    items = [(1, "alpha, BETA-alpha"), (2, "unique"), (3, None), (4, "unseen words"), (5, "été x1 the of 42"), (6, "alpha"), (7, docs[7][1])]
    made = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, row long, term string").repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    got = ranked_search.ranked_search(made, asked, k=9, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(brute_ranks(docs, items, 9))


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "alpha")], "doc_id long, text string")
    items = docs.withColumnRenamed("doc_id", "item_id")
    assert ranked_search.ranked_search(docs.limit(0), items).count() == 0
    assert ranked_search.ranked_search(docs, items.limit(0)).count() == 0


def test_range_maxima():
    draw = np.random.default_rng(1)
    term, doc = np.divmod(np.sort(draw.choice(5 * 40, 90, replace=False)), 40)
    lists = ranked_search.Postings(term, doc, draw.integers(1, 50, 90), 5, 40)
    for _ in range(300):
        t = draw.integers(0, 5)
        low, high = np.sort(draw.integers(lists.start[t], lists.start[t + 1] + 1, 2))
        best, value = lists.highest(np.array([low]), np.array([high]))
        assert value[0] == (lists.impact[low:high].max() if high > low else 0)
        assert high == low or lists.impact[best[0]] == value[0]


# --- repair


def cheapest(codes, ends=repair.DONE, entry=0):
    """(cost, least letters) by plain dynamic programming from the end."""
    never = (repair.NEVER, "")

    def with_insertions(options):
        two = min(options[2], (5 + options[3][0], "I" + options[3][1]))
        three = min(options[3], (5 + options[2][0], "I" + options[2][1]))
        return [min(options[q], (5 + two[0], "I" + two[1])) for q in (0, 1)] + [two, three]

    now = with_insertions([(e, "") if e < repair.NEVER else never for e in ends])
    for code in reversed(codes):
        options = []
        for q in range(4):
            found = [(2 + now[q][0], "D" + now[q][1])]
            if code != "-":
                extra, to = 5 * code.isupper(), repair.KEPT.get((q, code.lower()))
                if to is not None:
                    found.append((extra + now[to][0], "K" + now[to][1]))
                to = repair.FILLED[q]
                found.append((1 + extra + now[to][0], "R" + now[to][1]))
            options.append(min(found))
        now = with_insertions(options)
    return now[entry]


def test_auction_finds_the_least_shortest_path():
    draw = random.Random(2)
    for _ in range(1500):
        codes = "".join(draw.choice("suaxSUAX-uaua") for _ in range(draw.randrange(1, 14)))
        letters, cost, _ = repair.solve(codes, repair.DONE, True, 0)
        assert (cost, letters) == cheapest(codes)


def brute_repair(rows):
    """The contract by plain loops; ``rows`` are (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = role if role is not None else " ", text if text is not None else " "
            name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            kind = zlib.crc32(name.encode()) % 20
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            after += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        after.sort()
        turns = {t for known, t, _, _ in after if known}
        seen, codes, faults = set(), "", Counter()
        for _, _, role, text in after:
            solid = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            initial = role[0] if role[:1] in ("s", "u", "a") and role else "x"
            codes += "-" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        cost, audit = cheapest(codes) if codes else (0, "")
        state, lines, rest = 0, [], iter(after)
        for letter in audit:
            row = None if letter == "I" else next(rest)
            if letter == "D":
                continue
            state = repair.KEPT[state, row[2][0]] if letter == "K" else repair.FILLED[state]
            lines.append(f"{row[2] if letter == 'K' else repair.ROLES[state]}:{row[3] if row else ''}")
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha)
    return out


@pytest.mark.parametrize("segment_rows", [3, 64])
def test_repair_equals_plain_loops(spark, segment_rows):
    draw = random.Random(4)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No", " \n", "Why?", "", None, "Long. " * 9, "é !"]
    rows = [
        (conv, draw.choice([None, *range(40)]), draw.choices(roles, [6, 6, 2, 1, 1, 1])[0], draw.choice(texts))
        for conv in [None, *range(25)]
        for _ in range(draw.randrange(1, 24))
    ]
    rows += [(99, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(300)]
    made = spark.createDataFrame([(*r, 7, "p") for r in rows], "conv_id long, turn long, role string, text string, pos int, seg string")
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(made.repartition(3), segment_rows).collect()}
    assert got == brute_repair(rows)
    assert repair.repair(made.limit(0)).count() == 0


# --- language-model scores


def plain_score(text, counts):
    """Bits of one text by loops over symbols, from counts {(order, context): Counter(symbol)}."""
    plain, end = lm_scoring.PLAIN, lm_scoring.PLAIN.index(lm_scoring.END)
    stream = []
    for byte in b" ".join((text or "").encode().lower().split()) + b"\n":
        stream += [plain.index(byte)] if byte in plain else [31, byte >> 5, byte & 31]
    return stream, end


def symbol_counts(texts):
    counts = {}
    for text in texts:
        stream, end = plain_score(text, None)
        for at, symbol in enumerate(stream):
            for order in lm_scoring.ORDERS:
                context = tuple(stream[at - b] if at >= b else end for b in range(order, 0, -1))
                counts.setdefault(context, Counter())[symbol] += 1
    return counts


def plain_bits(text, counts):
    stream, end = plain_score(text, counts)
    total = 0.0
    for first in range(0, len(stream), lm_scoring.SEGMENT):
        weights = {}
        for at in range(first, min(first + lm_scoring.SEGMENT, len(stream))):
            inputs = []
            for order in lm_scoring.ORDERS:
                known = counts.get(tuple(stream[at - b] if at >= b else end for b in range(order, 0, -1)), {})
                path = []
                for depth in range(1, 6):
                    above = sum(n for s, n in known.items() if s >> (6 - depth) == stream[at] >> (6 - depth))
                    taken = sum(n for s, n in known.items() if s >> (5 - depth) == stream[at] >> (5 - depth))
                    path.append(math.log((taken + lm_scoring.ADDED) / (above - taken + lm_scoring.ADDED)))
                inputs.append(path)
            gate = sum(path[0] != 0 for path in inputs)
            w = weights.setdefault(gate, [[lm_scoring.WEIGHT] * 5 for _ in inputs])
            for bit in range(5):
                mix = max(-15.0, min(15.0, sum(w[k][bit] * inputs[k][bit] for k in range(len(inputs)))))
                p = 1 / (1 + math.exp(-mix))
                total += math.log2(p)
                for k in range(len(inputs)):
                    w[k][bit] += lm_scoring.STEP * (1 - p) * inputs[k][bit]
    return total


def test_words_of_a_block_are_counted_together():
    texts = [b"the of the\n", b"\n", "naïve 漢字 the\n".encode(), b"\n"]
    codes, names, sizes = lm_scoring._words(texts)
    names = names.to_pylist()
    assert sizes.tolist() == [3, 0, 3, 0] and len(set(names)) == len(names)
    assert [names[c] for c in codes] == [w for t in texts for w in t.split()]
    codes, names, sizes = lm_scoring._words([b"\n"])
    assert (len(codes), len(names), sizes.tolist()) == (0, 0, [0])


def test_scores_equal_a_plain_model(spark):
    draw = random.Random(8)
    words = "the of and theory Ofen naïve 123 a-b x".split()
    docs = [(i, " ".join(draw.choice(words) for _ in range(draw.randrange(1, 60)))) for i in range(90)]
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, "漢字 the"), (None, "the of"), (7, docs[7][1]), (1004, "the theory " * 700)]
    made = spark.createDataFrame([(i, t, True, 5) for i, t in docs], "doc_id long, text string, held_out boolean, block long").repartition(3)
    got = lm_scoring.lm_scores(made).collect()
    trained = [t for i, t in docs if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    counts = symbol_counts(trained)
    tokens = Counter(w for t in trained for w in [*(t or "").encode().lower().split(), b"\n"])
    expected = {}
    for i, t in docs:
        mine = [*(t or "").encode().lower().split(), b"\n"]
        base = sum(math.log10((tokens[w] + 0.1) / (tokens.total() + 0.1 * (len(tokens) + 1))) for w in mine)
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
        expected.setdefault(i, []).append((held, len(mine), sum(w in tokens for w in mine), tokens.total(), base, plain_bits(t, counts) * math.log10(2)))
    assert len(got) == len(docs)
    for r in got:
        want = expected[r["doc_id"]][0]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:4]
        assert r["base_score"] == pytest.approx(want[4]) and r["score"] == pytest.approx(want[5], rel=2e-4, abs=1e-3)


def test_scores_without_training_texts_and_of_an_empty_table(spark):
    only = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    docs = spark.createDataFrame([(only, "some words")], "doc_id long, text string")
    row = lm_scoring.lm_scores(docs).first()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == (True, 3, 0, 0)
    assert row["score"] < 0 and lm_scoring.lm_scores(docs.limit(0)).count() == 0


def test_scores_beat_the_base_on_held_out_texts(spark, sf_dir):
    held = [r for r in lm_scoring.query(spark, sf_dir.replace("0.001", "0.01")).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
