"""Spelling variants by brute force: counts, pairs, blocks that are divided, forms and roots."""

import collections
import random
import re
import zlib

import pytest

from strikeflow.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
R = random.Random(12)


def lower(run):
    return "".join(c.lower() if c.isascii() else c for c in run)


def counts(rows, altered=199):
    found = collections.Counter()
    for doc, text in rows:
        for run in map(lower, RUN.findall(text or "")):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % altered == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n_of):
    near = {w: [x for x in n_of if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in n_of}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n_of[x], x), default=None)
        form[w] = best if best is not None and n_of[best] >= 5 * n_of[w] else None
    out = set()
    for w in n_of:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n_of[w], len(near[w]), n_of[form[w]] if form[w] else None))
    return out


def edited(word):
    k, c = R.randrange(len(word)), R.choice("abceéß×")
    return R.choice([word[:k] + word[k + 1 :], word[:k] + c + word[k:], word[:k] + c + word[k + 1 :]])


@pytest.fixture(scope="module")
def rows():
    base = ["".join(R.choice("abcde") for _ in range(R.randrange(6, 12))) for _ in range(40)]
    base += ["Écoleàge", "STRASSEß", "aaaaaa", "aaaaaaa", "aaaaaaaa", "q" * 3000, "q" * 3001, "q" * 1500 + "z" + "q" * 1500]
    lines = []
    for word in base:
        n = R.choice([5, 6, 30, 200])
        lines += [word] * n
        for _ in range(6):
            variant = edited(word)
            lines += [variant] * max(4, n // R.choice([3, 5, 6, 10]))
            lines += [edited(variant)] * R.choice([1, 5])
    R.shuffle(lines)
    found = [(k, R.choice([" ", ", ", "\n", "1"]).join(lines[k * 7 : k * 7 + 7])) for k in range(len(lines) // 7 + 1)]
    return [*found, (None, "Zebras zebras ZEBRAS zebras zebras zebra"), (3, None), (4, ""), (5, "12 日本 _"), (6, "under×scores " * 9), (6, "under×scores " * 9)]


@pytest.mark.parametrize("bucket", [128, 3])
def test_variants_match_brute_force(spark, rows, bucket):
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, word string, n int").repartition(5)
    want = brute(counts(rows))
    assert any(f for _, f, *_ in want) and any(r != f for _, f, r, *_ in want if f)
    got = spelling.variants(docs, bucket=bucket).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_crowded_blocks_are_divided_and_lose_no_pair(spark):
    # all words share their first half, most their last one, and each place has many letters
    words = {"shared" + "".join(R.choice("abcdefgh") for _ in range(4)) + "ending" for _ in range(600)}
    words |= {"shared" + "".join(R.choice("ab") for _ in range(R.randrange(3, 6))) + "ending" for _ in range(60)}
    words |= {"prefix" + chr(c) + "suffix" for c in [*range(97, 123), *range(0xC0, 0x100)]} | {"prefixsuffix", "prefix", "prefixa"}
    table = spark.createDataFrame([(w, 5 + len(w)) for w in words], "word string, n long")
    want = {(a, b, 5 + len(b)) for a in words for b in words if abs(len(a) - len(b)) < 2 and one_edit(a, b)}
    for bucket in (4, 64):
        got = [tuple(r) for r in spelling.near_words(table, bucket=bucket).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_altered_words_ties_and_chains(spark):
    rows = [(k, "misspelling corrections") for k in range(4000)]
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(counts(rows))
    assert {tuple(r) for r in got.values()} == want
    assert sum(r["form"] is None for r in got.values()) == 2 and len(got) > 2
    # two forms of one count: the smaller word; and a chain of three
    lines = [("abcdefx", 50), ("abcdefy", 50), ("abcdefz", 10), ("chainaaa", 500), ("chainaab", 100), ("chainabb", 20), ("chainbbb", 4)]
    told = {r["word"]: r for r in spelling.variants(spark.createDataFrame([(0, f"{w} " * n) for w, n in lines], "doc_id long, text string"), altered=0, count=4).collect()}
    assert told["abcdefz"]["form"] == "abcdefx" and told["abcdefx"]["form"] is None and told["abcdefx"]["n_near"] == 2
    assert [told[w]["root"] for w in ("chainbbb", "chainabb", "chainaab", "chainaaa")] == ["chainaaa"] * 4


def test_empty_tables_have_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "few words")], "doc_id long, text string")).count() == 0
