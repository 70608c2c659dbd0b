"""The pipeline against SQL up to the mix, near duplicates by brute force included, then the library's tokens."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from oracle import connect
from test_dedup import brute_components

import corpus_pipeline
from tallywright.llm import bpe, mixing, quality


def expected_rows(sf_dir):
    duck = connect(sf_dir)
    duck.execute(f"CREATE TABLE good AS WITH {quality.sql()} SELECT d.* FROM documents d JOIN quality USING (doc_id) WHERE kept")
    duck.execute("""
        CREATE TABLE once AS SELECT * EXCLUDE (place) FROM (
          SELECT *, row_number() OVER (PARTITION BY regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')
            ORDER BY length(text) DESC, doc_id) AS place FROM good) WHERE place = 1""")
    documents = duck.execute("SELECT doc_id, text FROM once").fetchall()
    parts = brute_components(documents)
    kept = [i for i, (_, component) in parts.items() if i == component]
    duck.execute("CREATE TABLE apart AS SELECT * FROM once WHERE list_contains(?, doc_id)", [kept])
    copies = dict(duck.execute(f"WITH {mixing.sql('apart')} SELECT doc_id, copies FROM mix").fetchall())
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = []
    for i, text in duck.execute("SELECT doc_id, text FROM apart").fetchall():
        ids = np.array(library.encode_ordinary(text), "<u4")
        row = (i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        rows += [row] * copies[i]
    return sorted(rows)


def test_pipeline_equals_brute_force(spark, sf_dir):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == expected_rows(sf_dir)


def test_stages_take_empty_and_odd_documents(spark, sf_dir, make):
    clean = " ".join(f"w{i}" for i in range(60))
    odd = make([(None, clean, None), (1, None, "a"), (1, "", "a"), (2, clean, "b"), (2, clean, "b")])
    for docs, most in ((odd, 5), (odd.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            assert out.count() <= 3 * most


def test_the_last_stage_remembers_few_words_and_pairs():
    small = bpe.Bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, memory_words=5)
    text = " ".join(f"word{i % 37}x{i} Grüße{i}" for i in range(300))
    assert small.encode(text) == bpe.Bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encode(text)
    assert len(small.stable_pairs) <= 5 and len(small.words) + len(small.words.older) <= 10
    assert corpus_pipeline.MEMORY_WORDS <= 50_000
