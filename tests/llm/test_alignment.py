"""Token alignment against whole texts in both libraries and a plain count of overlaps."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from strikeflow.llm import alignment, packing, pieces

R = random.Random(21)


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_of():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def tokens(text, tools):
    """Ids and bytes of both tokenizers for a whole text."""
    a, b = tools
    table = byte_of()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
    name = lambda i: b.id_to_piece(i)
    bytes_b = [bytes([int(name(i)[3:-1], 16)]) if b.is_byte(i) else name(i).replace("▁", " ").encode() for i in ids_b]
    return ids_a, bytes_a, ids_b, bytes_b


def brute(texts, tools):
    found = []
    for text in texts:
        links, parts = [], []
        ids_a, bytes_a, ids_b, bytes_b = tokens(text, tools) if text else ([], [], [], [])
        want = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            found.append(([], [], [], None))
            continue
        ends = [[sum(map(len, x[: k + 1])) for k in range(len(x))] for x in (bytes_a, bytes_b)]
        both = sorted(set(ends[0]) & set(ends[1]))
        at = 0
        for stop in both:
            own = [[i for i, e in zip(ids, end, strict=True) if at < e <= stop] for ids, end in zip((ids_a, ids_b), ends, strict=True)]
            parts.append("|".join(",".join(map(str, x)) for x in own))
            at = stop
        for i, ea, wa in zip(ids_a, ends[0], bytes_a, strict=True):
            for j, eb, wb in zip(ids_b, ends[1], bytes_b, strict=True):
                if max(ea - len(wa), eb - len(wb)) < min(ea, eb):
                    links.append((i, j))
        found.append((ids_a, ids_b, links, ";".join(parts)))
    count = collections.Counter(p for _, _, links, _ in found for p in set(links))
    best = collections.defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for ids_a, ids_b, links, parts in found:
        out.append((len(ids_a), len(ids_b), parts.count(";") + 1 if parts else 0, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(parts.encode()).hexdigest() if parts else ""))
    return out


def prose(n):
    return " ".join(R.choice(["alignment", "Tokens", "the", "délta", "日本語", "don't", "x1", "naïve", "1234567", "hello,world", "(a)", "Straße", "𝔸𝔹"]) for _ in range(n))


TEXTS = [None, "", " ", "  \n ", "one", prose(30), prose(30), "two  spaces   three", " lead and trail ", "line\nbreaks\n\n and\ttabs \r\n", "a▁b marker", "<|endoftext|> </s> <s> <unk> <0x41>", "nul\x00 \x1c byte", "no\xa0break  em 　 wide ​ zero\u0085x", "é" * 300, "x" * 3000, "1" * 700 + " " + "ab" * 500, "end ", " ﻿bom", "emoji 👩‍👩‍👧 flags 🇨🇭", "  separators  ", "a b", "a  b", "Ａ ﬁ ½ ²", "é combining"]
TEXTS += [prose(400), TEXTS[5], " " + TEXTS[5], TEXTS[5] + " "]


def test_matches_whole_texts_by_brute_force(spark, tools):
    docs = spark.createDataFrame([(i if i != 4 else None, t, "clash", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, pair string, batch int").repartition(4)
    want = sorted((-1 if i == 4 else i, *w) for i, w in enumerate(brute(TEXTS, tools)))
    for size in (1, 300, alignment.GROUP):
        got = alignment.aligned(docs, size=size).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in got) == want
    assert sum(w[-1] == "" for w in want) == 3  # null, empty and the marker


def test_long_texts_ties_and_repeats(spark, tools):
    long = prose(20_000) + " " + "z" * 10_000
    texts = ["tie one", "tie two", "tie one", "tie one", long]
    docs = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    got = sorted((r["n_a"], r["n_b"], r["n_groups"], r["n_best"], r["count_sum"]) for r in alignment.aligned(docs).collect())
    ids_a, bytes_a, ids_b, bytes_b = tokens(long, tools)
    assert (got[-1][0], got[-1][1]) == (len(ids_a), len(ids_b))
    assert got[:-1] == sorted((w[0], w[1], w[2], w[4], w[5]) for w in brute(texts[:-1], tools))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned(empty).count() == 0
    assert alignment.aligned(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).where("n_a + n_links = 0 and groups_sha256 = ''").count() == 2


def test_units_are_solved_together(tools):
    tool = alignment.Aligner(packing.vocabulary(), pieces.model_path())
    one = [b" word", "  \n x".encode(), b" other,thing", " a▁b".encode(), b" x  "]
    got = tool.solve(one)
    for unit, k in zip(one, got.rank.tolist(), strict=True):
        (n_a, n_b, n_groups, n_links, *_, sha), *_ = brute([unit[1:].decode()], tools)
        assert (got.n_a[k], got.n_b[k], got.n_groups[k], got.n_links[k]) == (n_a, n_b, n_groups, n_links)
        assert got.good[k] == (n_a > 0) and (not n_a or hashlib.sha256(got.texts[k][:-1]).hexdigest() == sha)
    labels = alignment.labels(5, np.array([2, 3]), np.array([3, 2]))
    assert labels == b"01203" and alignment.group_ends(labels + b"003").tolist() == [5, 8]
    text, edge = alignment.group_texts(np.array([7, 10, 100]), np.array([1, 20000, 0]), np.array([2, 1]), np.array([1, 2]))
    assert text == b"7,10|1;100|20000,0;" and edge.tolist() == [0, 2, 5, 7, 11, 17, 19]


def test_batches_are_held_a_few_at_once(spark, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    from strikeflow.llm import shared

    texts = [" ".join(f"{R.getrandbits(40):x}" for _ in range(20_000)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found, scratch = [], shared.scratch
    monkeypatch.setattr(shared, "scratch", lambda *a: found.append(scratch(*a)) or found[-1])
    monkeypatch.setattr(alignment, "ROW_GROUP", 1 << 20)
    assert alignment.aligned(docs, size=200_000).where("n_groups > 0").count() == 30
    groups = [m.row_group(k) for f in glob.glob(found[0].removeprefix("file:") + "/*.parquet") for m in [pq.ParquetFile(f).metadata] for k in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 30 and max(g.num_rows for g in groups) < 10
    assert alignment.GROUP <= 2 << 20
