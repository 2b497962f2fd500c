"""Packing, leakage and reading level against brute force, with their edge cases."""

from __future__ import annotations

import os
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readloom.llm import leakage, packing, reading

needs_tokenizer = pytest.mark.skipif(not os.path.exists(os.path.join(packing.TOKENIZERS, packing.VOCABULARY)), reason="no tokenizer files")


def _first_fit_decreasing(sizes, capacity):
    room: list[int] = []
    for s in sorted(sizes, reverse=True):
        k = next((i for i, r in enumerate(room) if r >= s), None)
        if k is None:
            room.append(capacity - s)
        else:
            room[k] -= s
    return len(room)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_best_two_fit_is_a_packing(case):
    capacity, sizes = case
    where, n = packing.best_two_fit(np.array(sizes, "int64"), capacity)
    load = np.bincount(where, sizes, n) if sizes else np.zeros(0)
    assert (load <= capacity).all() and (load > 0).all() and len(load) == n
    assert n >= -(-sum(sizes) // capacity)


def test_best_two_fit_fills_well():
    rng = random.Random(3)
    sizes = [min(512, int(rng.lognormvariate(4.5, 1)) + 1) for _ in range(5000)]
    _, n = packing.best_two_fit(np.array(sizes), 512)
    assert n <= _first_fit_decreasing(sizes, 512)
    # The smallest item gives way to two that fit the gap it leaves.
    where, n = packing.best_two_fit(np.array([7, 2, 2, 1, 6, 2]), 10)
    assert n == 2 and sorted(np.bincount(where, [7, 2, 2, 1, 6, 2])) == [10, 10]


def test_pack(spark):
    rng = random.Random(5)
    sizes = {i: rng.choice([0, 1, 7, 30, 64, 65, 128, 1000]) for i in range(500)}
    counts = spark.createDataFrame(list(sizes.items()), "id long, n_tokens long")
    caps = {1: 64, 2: 200}
    got = packing.pack(counts, spark.createDataFrame(list(caps.items()), "capacity_id int, max_tokens int"), shard_items=100).collect()
    load, seen = defaultdict(int), defaultdict(list)
    for r in got:
        seen[r.capacity_id, r.id].append((r.piece, r.first_token, r.n_tokens))
        if r.container_id is None:
            assert r.n_tokens == 0
        else:
            load[r.capacity_id, r.container_id] += r.n_tokens
    assert all(n <= caps[c] for (c, _), n in load.items())
    for c, cap in caps.items():
        for i, n in sizes.items():
            pieces = sorted(seen[c, i])
            assert len(pieces) == max(1, -(-n // cap))
            at = 0
            for k, (piece, first, size) in enumerate(pieces):
                assert (piece, first) == (k, at) and size <= cap
                at += size
            assert at == n
        whole = sum(n // cap for n in sizes.values())
        rests = [n % cap for n in sizes.values() if n % cap]
        assert sum(1 for x, _ in load if x == c) <= whole + _first_fit_decreasing(rests, cap) + 5  # five shards


def test_pack_edges(spark):
    caps = spark.createDataFrame([(1, 10)], "capacity_id int, max_tokens int")
    none = spark.createDataFrame([], "id long, n_tokens long")
    assert packing.pack(none, caps).collect() == []
    twice = spark.createDataFrame([(1, 6), (1, 6), (None, 4)], "id long, n_tokens long")
    got = packing.pack(twice, caps).collect()
    assert len(got) == 3 and len({r.container_id for r in got}) == 2
    assert packing.pack(twice, caps.limit(0)).collect() == []
    with pytest.raises(ValueError, match="capacity"):
        packing.pack(twice, spark.createDataFrame([(1, 0)], "capacity_id int, max_tokens int"))


def test_pack_does_not_depend_on_splits(spark):
    rng = random.Random(6)
    rows = [(i // 3, rng.choice([0, 3, 40, 90, 250])) for i in range(900)] + [(7, 33)] * 300
    counts, caps = spark.createDataFrame(rows, "id long, n_tokens long"), spark.createDataFrame([(1, 100), (2, 64)], "capacity_id int, max_tokens int")
    one, other = ([tuple(r) for r in packing.pack(counts.repartition(n), caps, shard_items=150).collect()] for n in (1, 7))
    assert sorted(one, key=str) == sorted(other, key=str)


@needs_tokenizer
def test_token_counts(spark):
    enc = packing.encoder()
    assert packing.count_tokens(enc, ["hello world", None, "", "<|endoftext|>"])[:3] == [2, 0, 0]
    df = spark.createDataFrame([(1, "a b c", "x"), (2, None, "y")], "id long, text string, n_tokens string")
    got = packing.pack_texts(df, F.col("id"), F.col("text"), spark.createDataFrame([(1, 2)], "capacity_id int, max_tokens int")).collect()
    assert sorted((r.id, r.piece, r.n_tokens) for r in got) == [(1, 0, 2), (1, 1, 1), (2, 0, 0)]


@needs_tokenizer
def test_token_counts_of_very_long_texts(monkeypatch):
    """Cut or not, a text has the same tokens; a run with no place to cut is counted too."""
    enc = packing.encoder()
    rng = random.Random(8)
    texts = ["word " * 100_000, "a1.\t b  \n\n c's" * 30_000, "x" * 250_000, "é ß \u00a0ö's 12 " * 20_000]
    texts += ["".join(rng.choices("ab1 .'s\n\t_\u00a0é", k=300)) for _ in range(200)]
    whole = [len(enc.encode_ordinary(t)) for t in texts]
    assert packing.count_tokens(enc, texts) == whole
    monkeypatch.setattr(packing, "_STRETCH", 7)
    assert packing.count_tokens(enc, texts) == whole
    monkeypatch.setattr(packing, "_MOST", 20)
    assert packing.count_tokens(enc, texts[-200:]) == whole[-200:]
    monkeypatch.undo()
    assert packing.count_tokens(enc, [" " * 1_000_000]) == [1_000_000]


ITEM = "The saddler labelled 23 wheels beside the north gate, then cooled 61 kites by candle light before noon. Why?"


def _dirty(words):
    yield " ".join(words)
    yield " ".join(words).upper()
    yield "> " + "\n> ".join(words)
    yield "// " + "\n// ".join(words)
    yield "".join(f"<b>{w}</b> " for w in words)
    yield " ".join(w[:2] + "­" + w[2:] for w in words)
    yield " ".join(w[:1] + "​" + w[1:] for w in words)
    yield " ".join(words).replace(",", "").replace(" the ", " **the** ")
    yield " ".join(words).replace(",", " &mdash;").replace(" ", "&nbsp;")
    yield " ".join(f"[{w}](http://x.example/some/words)" for w in words)
    yield "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in " ".join(words))
    yield "<br>".join(words)


def test_passages_in_every_guise(spark):
    words = ITEM.split()
    docs, want = [], set()
    for n in (11, 12, 15):
        for k, text in enumerate(_dirty(words[2 : 2 + n])):
            i = n * 100 + k
            docs.append((i, f"Before it {text} and after"))
            if n >= 12:
                want.add(i)
    docs += [(1, None), (2, ""), (3, " ".join(words).replace("23", "123").replace("61", "611")), (4, "x " * 200_000 + ITEM)]
    want.add(4)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(7, ITEM, "A"), (8, "too short", None), (None, ITEM, None), (9, None, None)], "item_id long, t string, a string")
    for block in (8_000_000, 50):
        got = leakage.leaks(df, F.col("doc_id"), F.col("text"), items, F.col("item_id"), [F.col("t"), F.col("a")], block_chars=block).collect()
        assert {r.id for r in got} == want and {r.item_id for r in got} == {7}


def test_spans_point_into_the_text(spark):
    text = f"Say <em>{ITEM}</em> twice: {ITEM} End"
    df = spark.createDataFrame([(1, text)], "id long, text string")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, t string")
    got = sorted((r.span_start, r.span_end) for r in leakage.leaked_spans(df, F.col("id"), F.col("text"), items, F.col("item_id"), [F.col("t")]).collect())
    assert [leakage.stream(text[a:b]) for a, b in got] == [leakage.stream(ITEM)] * 2
    empty = leakage.leaks(df, F.col("id"), F.col("text"), items.limit(0), F.col("item_id"), [F.col("t")])
    assert empty.collect() == [] and leakage.leaks(df.limit(0), F.col("id"), F.col("text"), items, F.col("item_id"), [F.col("t")]).collect() == []


def _brute(text, items, words):
    """Item -> the begins and ends, in the text's stream, of all its runs of words that stand in the text as words."""
    plain = leakage.stream(text)
    _, begins = leakage.stream_offsets(text)
    begins.append(True)
    out = defaultdict(set)
    for ident, item in items:
        w = leakage.item_words(item)
        for i in range(len(w) - words + 1):
            p = "".join(w[i : i + words])
            for at in range(len(plain) - len(p) + 1):
                if plain.startswith(p, at) and begins[at] and begins[at + len(p)]:
                    out[ident].add((at, at + len(p)))
    return out


@pytest.mark.parametrize("words", [1, 2, 3, 5, 12])
def test_passages_against_brute_force(words):
    """Few words of few lengths, so items repeat, overlap, share keys, and are broken by words of equal length."""
    rng = random.Random(words)
    vocabulary = ["a", "b", "ab", "ba", "c", "aa", "abc", "longer", "other"]
    for _ in range(150):
        items = [(i % 3, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 3 * words)))) for i in range(5)]
        parts = [" ".join(i[1].split()[rng.randrange(3) :]) for i in rng.choices(items, k=3)] + rng.choices(vocabulary, k=4)
        text = " ".join(rng.sample(parts, len(parts)))
        sought = leakage.Passages(items, words)
        got = sought.find(text) if sought.auto is not None else {}
        want = _brute(text, items, words)
        at, _ = leakage.stream_offsets(text)
        assert set(got) == set(want)
        for ident, spans in got.items():
            assert sum(n for _, _, n in spans) == len(want[ident])
            assert min(a for a, _, _ in spans) == min(at[p] for p, _ in want[ident]) and max(b for _, b, _ in spans) == max(at[q - 1] + 1 for _, q in want[ident])


def test_memory_of_an_automaton():
    """Under 50 bytes a character of the items: a whole block of 8 million of them takes less than 400 MB."""
    code = """
import random, resource, sys
from readloom.llm.leakage import Passages
rng = random.Random(0)
items = [(i, " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 10))) for _ in range(60))) for i in range(3000)]
size = sum(len(t) for _, t in items)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
kept = Passages(items, 12)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 / size)
"""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(leakage.__file__))))
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": root})
    assert float(got.stdout) < 50


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aZ9 .<>&;b/é­​](h\nﬁ１", max_size=40))
def test_stream_offsets_match_stream(text):
    at, begins = leakage.stream_offsets(text)
    plain = leakage.stream(text)
    assert len(at) == len(plain) == len(begins) and at == sorted(at)


def test_prose():
    text = 'Read this. `code here` and [the notes](http://a.example/x) at https://b.example/y\n\n```sql\nSELECT long_identifier\n```\n    indented(code)\n<pre><code>x &lt; y</code></pre>\nLast one &amp; done!'
    assert reading.sentences(reading.prose(text)) == [["Read", "this"], ["and", "the", "notes", "at"], ["Last", "one", "done"]]
    assert reading.measures("It's a well-known fact. 42!")[:3] == (4, 1, 17)
    assert reading.measures("```\nonly code\n```")[:3] == (0, 0, 0)


def _corpus(n, seed=0):
    rng = random.Random(seed)
    easy, hard = ["cat", "dog", "sun", "red", "run", "big"], ["asymptotic", "normalization", "heterogeneous", "stratification", "interdependent"]
    for i in range(n):
        if i % 3:
            yield i, " ".join(" ".join(rng.choices(easy, k=6)) + "." for _ in range(10))
        else:
            yield i, " ".join(" ".join(rng.choices(hard, k=22)) + "." for _ in range(4))


def test_reading_levels(spark):
    df = spark.createDataFrame(list(_corpus(300)) + [(900, None), (901, ""), (902, "```x```"), (903, "cat. " * 200_000)], "level long, text string")
    got = {r.id: r for r in reading.reading_levels(df, F.col("level"), F.col("text")).collect()}
    assert len(got) == 304
    assert all((got[i].level == 5) == (i % 3 == 0) for i in range(300))
    assert [got[i].level for i in (900, 901, 902)] == [None] * 3 and got[903].level == 1
    # Held out: other texts of the same kind, by the fitted models.
    models = reading.fit(df, F.col("level"), F.col("text"), seed_texts=200)
    new = spark.createDataFrame(list(_corpus(60, 9)), "id long, text string")
    held = reading.reading_levels(new, F.col("id"), F.col("text"), models=models).collect()
    assert all((r.level == 5) == (r.id % 3 == 0) for r in held)
    found = reading.reading_levels(df, F.col("level"), F.col("text")).where((F.col("level") == 5) & reading.is_demanding())
    assert {r.id for r in found.collect()} == set(range(0, 300, 3))
    assert reading.reading_levels(df.limit(0), F.col("level"), F.col("text")).collect() == []


def test_reading_levels_by_sentences_and_words(spark):
    """Texts of the same words in short sentences, and of short words in long ones, aren't demanding: the events tell."""
    rng = random.Random(4)
    easy = ["cat", "dog", "sun", "red", "run", "big", "map", "sky"]
    hard = ["asymptotic", "normalization", "heterogeneous", "stratification", "interdependent", "quantification"]

    def text(words, size):
        return " ".join(" ".join(rng.choices(words, k=max(2, int(rng.gauss(size, size / 5))))) + "." for _ in range(rng.randrange(4, 12)))

    kinds = [(easy, 7), (hard, 7), (easy, 30), (hard, 30)]
    rows = [(i, text(*kinds[i % 4])) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, text string")
    models = reading.fit(df.where("id < 400"), F.col("id"), F.col("text"))
    held = reading.reading_levels(df.where("id >= 400"), F.col("id"), F.col("text"), models=models).collect()
    assert len(held) == 400 and all((r.level == 5) == (r.id % 4 == 3) for r in held)
    few = reading.fit(df, F.col("id"), F.col("text"), vocabulary=3)  # the counts of the others go to their lengths
    assert sum(1 for t in few.index if not t.startswith("<")) == 3
    held = reading.reading_levels(df, F.col("id"), F.col("text"), models=few).collect()
    assert all((r.level == 5) == (r.id % 4 == 3) for r in held)
