"""Small and odd tables, brute force and round trips for the operators of the list."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from strikeflow.llm import language_id, line_dedup, lm_score, media, packing, pieces, pii, quality, shared, simhash, textbytes, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
R = random.Random(11)
VOCABULARY = ["alpha", "beta", "Gamma", "délta", "the", "of", "x1", "日本"]


def prose(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


TEXTS = [None, "", "   \n\t ", "one", "the of", prose(40), prose(40), prose(3000), "a\x00b \x1c c", "x" * 5000, prose(12)]
TEXTS += [TEXTS[5], TEXTS[5] + " more", "<|endoftext|> and <|endoftext|>", "mail me@a.example.com or +1 (017) 555-7713 4111 1111 1111 1111 10.0.0.255 10.0.0.256"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", 0, "clash") for i, t in enumerate(TEXTS)]
    rows += [(None, "no id here at all", "de", None, None, None), (5, TEXTS[5], "en", "s", 0, "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_long_words_have_hashes_of_their_own(spark):
    # two words that differ by a swap of bytes 1,024 apart
    a = bytearray(bytes(97 + R.randrange(26) for _ in range(3000)))
    b = bytearray(a)
    a[10], a[1034], b[10], b[1034] = 97, 98, 98, 97
    texts = [a.decode(), b.decode(), a.decode()]
    buf, offs = textbytes.to_bytes(pa.array(texts))
    h = textbytes.hash_spans(buf, offs[:-1], offs[1:])
    assert h[0] != h[1] and h[0] == h[2]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = by_id(packing.pack(d, capacity=4096))
    ids = packing.encoder(packing.vocabulary())(pa.array([x + " y" for x in texts]))
    assert rows[0]["ids_crc32"] == rows[2]["ids_crc32"] != rows[1]["ids_crc32"] and ids[0].tolist()[: ids[1][1]] != ids[0].tolist()[ids[1][1] : ids[1][2]]
    assert {r["n_known"] for r in lm_score.score(d, F.col("doc_id") == 1).where("doc_id = 1").collect()} == {1}
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in pieces.encode(d).collect())


def test_samples_are_bounded_and_spread(spark):
    rows = [(None if i % 2 else i, f"text {i}", "rare" if i % 100 == 0 else "often") for i in range(4000)] + [(7, "same", "often")] * 3000
    d = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = shared.sample(d, 100, stratified=True)
    kinds = collections.Counter(got.column("label").to_pylist())
    assert kinds["rare"] == 40 and 20 <= kinds["often"] <= 100
    again = shared.sample(d.repartition(7), 100, stratified=True)
    assert got.equals(again)
    assert shared.sample(d, 1000, max_bytes=2000).nbytes < 10_000
    assert shared.sample(d.limit(0), 10).num_rows == 0
    assert sum(shared.shares([5, 50, 500], 100, part=False)) == 100


# 1


def brute_scores(texts, train, prior):
    tokens = [[w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in WORD.findall(t or "")] + [None] for t in texts]
    c = [collections.Counter() for _ in range(3)]
    for toks, used in zip(tokens, train, strict=True):
        if used:
            for k in range(3):
                c[k].update(tuple(toks[i : i + k + 1]) for i in range(len(toks) - k))
    total, kinds = sum(c[0].values()), len(c[0])
    out = []
    for toks in tokens:
        base = score = 0.0
        for i in range(len(toks)):
            p = (c[0][(toks[i],)] + 0.1) / (total + 0.1 * (kinds + 1))
            base += math.log10(p)
            for k in (1, 2):
                if i >= k and (n := c[k - 1][tuple(toks[i - k : i])]):
                    p = (c[k][tuple(toks[i - k : i + 1])] + prior[k - 1] * p) / (n + prior[k - 1])
            score += math.log10(p)
        out.append((len(toks), sum(c[0][(t,)] > 0 for t in toks), total, base, score))
    return out


def test_scores_match_brute_force(spark, docs, nothing):
    rows = docs.collect()
    train = [r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 10 != 0 for r in rows]
    assert not all(train)
    want = brute_scores([r["text"] for r in rows], train, (3.0, 2.0))
    got = lm_score.score(docs, lm_score.held_out(), prior=(3.0, 2.0)).collect()
    key = lambda d, n, s: (-1 if d is None else d, n, round(s, 6))
    assert sorted((*key(r["doc_id"], r["n_tokens"], r["score"]), r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted((*key(r["doc_id"], w[0], w[4]), w[1], w[2], round(w[3], 6)) for r, w in zip(rows, want, strict=True))
    assert lm_score.score(nothing, lm_score.held_out()).count() == 0
    assert lm_score.score(docs, F.lit(True)).where("score <> 0").count() == 0  # nothing learned: one unknown word


def test_packed_arrays_round_trip():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**63, 1000, dtype=np.uint64))
    assert (lm_score.unpack_sorted(lm_score.pack_sorted(keys)) == keys).all()


# 2


def test_encoder_matches_the_tokenizer():
    from tokenizers import Tokenizer

    texts = [*TEXTS, "a  b \n\n c", "x  y z w", "\n\nfoo bar  ", "hi it's we'll  x", " lead ing", "全角　x y", "a <|endoftext|>  b"]
    ids, bounds = packing.Encoder(packing.vocabulary())(pa.array(texts))
    want = Tokenizer.from_file(packing.vocabulary()).encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [w.ids for w in want]


def test_cuts():
    assert shared.cuts(1024, 1024) == [(0, 1024)] and shared.cuts(1025, 1024) == [(0, 1), (1, 1025)] and shared.cuts(2048, 1024) == [(0, 1024), (1024, 2048)]


def check_packing(rows, capacity):
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own[:-1], own[1:], strict=True)) and sum(own[-1]) <= capacity
    return len(sequences)


def test_packing(spark, docs, nothing):
    rows = packing.pack(docs, capacity=64).collect()
    n = check_packing(rows, 64)
    assert n <= math.ceil(sum(r["length"] for r in rows) / 64) + 2
    for doc, own in collections.defaultdict(list, {d: [r for r in rows if r["doc_id"] == d] for d in {r["doc_id"] for r in rows} if d not in (5, None)}).items():
        own.sort(key=lambda r: r["piece"])
        ids = packing.encoder(packing.vocabulary())(pa.array([TEXTS[doc]]))[0].tolist() + [2]
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert packing.pack(nothing).count() == 0


def best_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - x)
    return len(rooms)


@pytest.mark.parametrize("seed", range(4))
def test_plans_are_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 200, 3000) if seed % 2 else rng.choice([30, 40, 70, 101], 3000)
    histogram = collections.Counter(lengths.tolist())
    runs = packing.plan(histogram, 200)
    assert collections.Counter(runs[:, 0].tolist()).keys() == histogram.keys()
    rows, ranks = [], collections.Counter()
    key = runs[:, 0] << 44 | runs[:, 1]
    for x in lengths.tolist():
        i = np.searchsorted(key, x << 44 | ranks[x], "right") - 1
        rows.append({"sequence_id": int(runs[i, 2] + ranks[x] - runs[i, 1]), "offset": int(runs[i, 3]), "length": x})
        ranks[x] += 1
    n = check_packing(rows, 200)
    assert n <= 1.01 * best_fit(lengths.tolist(), 200) + 1


def test_plans_of_a_known_optimum():
    # sequences that are filled to the last token, cut into pieces
    rng = np.random.default_rng(1)
    for n in (40, 4000):
        pieces_ = [x for _ in range(n) for x in np.diff(np.sort(np.concatenate([[0, 300], rng.choice(np.arange(1, 300), 3, replace=False)]))).tolist()]
        runs = packing.plan(collections.Counter(pieces_), 300)
        used = packing.solved(collections.Counter(pieces_), 300)[0]
        assert sum(k for _, k in used) <= 1.02 * n + 1 and len(runs)
    # 6 + 3 + 1 fill a sequence; the longest ones together would not
    assert sum(k for _, k in packing.solved({6: 5, 3: 5, 1: 5}, 10)[0]) == 5


@pytest.mark.parametrize("n", [1000, 100_000, 10_000_000])
def test_configurations_place_the_pieces(n):
    drawn = np.exp(np.random.default_rng(0).normal(5, 1, min(n, 200_000))).astype(int).clip(1, 1023)
    histogram = {int(x): int(c) * max(1, n // 200_000) for x, c in zip(*np.unique(drawn, return_counts=True), strict=True)}
    use, bound = packing.fractional(histogram, 1024)
    assert bound <= sum(use.values()) <= 1.02 * bound + 5
    for x, count in histogram.items():  # a solution of the program: each length is covered as often as it occurs
        assert abs(sum(u * dict(c).get(x, 0) for c, u in use.items()) - count) < 1e-6 * count + 1e-6
    configs, own, bound = packing.solved(histogram, 1024)
    pieces_ = [k * sum(c.values()) for c, k in configs]
    # with a piece or two of most lengths, fractions of configurations are left to the last step of rounding
    assert sum(pieces_) == sum(histogram.values()) and sum(pieces_[:own]) >= (0.5 if n == 1000 else 0.9) * sum(pieces_)
    assert sum(k for _, k in configs) <= 1.01 * bound + 2 and len(configs) < 4000


# 3


def test_pieces_round_trip(spark, docs, nothing):
    p = pieces.load(pieces.model_path())
    texts = [*TEXTS, "▁a▁▁b", "日本語 テキスト 𝒳", " a  b\n\nc ", "é" * 400]
    ids, bounds, score = p.encode(pa.array(texts))
    got = p.decode(ids, bounds)
    for i, t in enumerate(texts):
        assert got[i].decode() == (t or "").replace("▁", " ")
        if t:
            own, best = p._long((" " + t.replace("▁", " ")).encode())
            assert abs(best - score[i]) < 1e-6 and len(own) == bounds[i + 1] - bounds[i] or abs(best - score[i]) < 1e-6
    rows = pieces.encode(docs).collect()
    assert all(r["decoded_sha256"] == hashlib.sha256((TEXTS[r["doc_id"]] or "").encode()).hexdigest() for r in rows if r["doc_id"] is not None)
    assert pieces.encode(nothing).count() == 0


def test_viterbi_finds_the_best_path():
    p = pieces.load(pieces.model_path())

    def best(word):
        if not word:
            return 0.0
        return max((best(word[:-k]) + p.score[p.words[word[-k:]]] for k in range(1, len(word) + 1) if word[-k:] in p.words), default=-math.inf)

    for w in (b" the", b" onein", b" xqzt", b" a"):
        assert p._long(w)[1] == pytest.approx(best(w))


# 4


def test_toxicity_learns_and_finds_sentences(spark, nothing):
    rng = random.Random(3)
    fill = ["red", "green", "blue", "stone", "river", "cloud"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        s = [" ".join(rng.choice(fill) for _ in range(6)) for _ in range(8)]
        if bad:
            s[3] += " vileword"
        rows.append((i, ". ".join(s) + "."))
        labels.append((i, int(bad)))
    labels += [(None, 1), (3, None)]
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = by_id(toxicity.score(d, y, toxicity.held_out()))
    assert all(r["predicted"] == (i % 5 == 0) for i, r in got.items())
    assert any(r["held_out"] for r in got.values())
    for i, r in got.items():
        if i % 5 == 0:
            assert b"vileword" in rows[i][1].encode()[r["worst_start"] : r["worst_end"]]
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "VILEWORD!" * 3)], "doc_id long, text string")
    got = by_id(toxicity.score(d.unionByName(odd), y, toxicity.held_out()))
    assert got[1000]["predicted"] == got[1001]["predicted"] == 0
    assert toxicity.score(nothing, y, toxicity.held_out()).count() == 0
    assert {r["score"] for r in toxicity.score(d, y.limit(0), toxicity.held_out()).collect()} == {0.0}


def test_noisy_or_against_plain_python():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["red", "green", "stonework", "river"]) for _ in range(12)) + (". A vileword, vilewording! End" if i % 4 == 0 else ". End") for i in range(200)]
    model = toxicity.Model(pa.chunked_array([texts]), np.array([i % 4 == 0 for i in range(200)]))
    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))

    def hashed(word, k=None):
        own = np.frombuffer(word[:k], np.uint8)
        return int(textbytes.hash_spans(own, np.array([0]), np.array([len(own)]))[0] ^ np.uint64(k or 0))

    odd = [None, "", "...", "VILEWORD", "é vileword\nvilewords x", texts[0], texts[1], "a" * 5000, "", None]
    score, start, end, worst = model(pa.array(odd))
    for i, text in enumerate(odd):
        raw = (text or "").lower().encode()
        cuts = [0, *(m.end() for m in re.finditer(rb"[\n!.;?]", raw) if m.end() < len(raw)), len(raw)]
        best, clean = -1.0, 1.0
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            z = model.bias
            for w in re.findall(rb"[0-9a-z\x80-\xff]+", raw[a:b]):
                z += sum(weight.get(hashed(w, k), 0.0) for k in (None, *(k for k in toxicity.PREFIXES if len(w) > k)))
            p = 1 / (1 + math.exp(-z))
            clean *= 1 - p
            best = max(best, p)
        assert score[i] == pytest.approx(1 - clean, abs=1e-9) and worst[i] == pytest.approx(best)
        assert 0 <= start[i] <= end[i] <= len(raw)
    assert score[3] > 10 * score[2]


# 5


def test_png_round_trip():
    for n in (0, 1, 63, 64, 65, 5000):
        payload = media.payload_of(bytes(R.randrange(256) for _ in range(n)))
        assert len(payload) % 64 == 0 and len(payload) >= 64
        assert media.decode_png(media.encode_png(payload)).tobytes() == payload
    with pytest.raises(ValueError):
        media.decode_png(b"GIF89a")


def naive_feature(payload):
    """Size, mean, deviation and 8 x 8 average hash with plain loops."""
    h = len(payload) // 64
    mean = sum(payload) / len(payload)
    dev = math.sqrt(sum((x - mean) ** 2 for x in payload) / len(payload))
    edges = [int(k * h / 8) for k in range(9)]
    blocks = []
    for r in range(8):
        for c in range(8):
            own = [payload[64 * y + x] for y in range(edges[r], edges[r + 1]) for x in range(8 * c, 8 * c + 8)]
            blocks.append(sum(own) / max(edges[r + 1] - edges[r], 1))
    bits = "".join("1" if x > sum(blocks) / 64 else "0" for x in blocks)
    return f"64x{h} mean={mean:.4f} dev={dev:.4f} hash={int(bits, 2):016x}"


def test_media(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = media.op5_media_columns(spark, str(tmp_path)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] is not None:
            raw = (TEXTS[r["doc_id"]] or "").encode()
            payload = media.payload_of(raw)
            stored = media.encode_png(payload)
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(stored), hashlib.sha256(stored).hexdigest(), naive_feature(payload))
            assert (r["position"], r["caption"], r["text_before"]) == (1, f"{len(raw)} bytes", f"document {r['doc_id']}")


def test_pages_keep_their_text(spark):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["items"] for r in media.interleave(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        body = re.sub(r"(?s)<(script|style|head)\b.*?</\1>|<!--.*?-->|<!DOCTYPE[^>]*>", "", r["html"] or "")
        want = html.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        text = " ".join(i["text"] for i in got[r["page_id"]] if i["kind"] == "text").split()
        assert "".join(text) == "".join(want) and [i["position"] for i in got[r["page_id"]]] == list(range(len(got[r["page_id"]])))


def test_interleaving_keeps_order():
    html = "<html><head><title>t</title></head><body><p>one</p><figure><img src='sha256:AB'><figcaption>cap <b>x</b></figcaption></figure>two<script>no</script><img src='u.png' alt='alt'><p>three"
    got = media.Sequence(html).result()
    assert [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in got] == [(0, "text", "one", None, None), (1, "media", None, "ab", "cap x"), (2, "text", "two", None, None), (3, "media", None, None, "alt"), (4, "text", "three", None, None)]
    assert media.Sequence("").result() == []


# 6


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(text, n):
    out = list(text)
    for _ in range(n):
        k = R.randrange(len(out))
        out[k : k + R.randint(0, 1)] = R.choice(["z", "", "é"])
    return "".join(out)


@pytest.mark.parametrize("edits", [1, 2])
def test_line_dedup_matches_brute_force(spark, edits):
    base = ["".join(R.choice("abcd ") for _ in range(R.randint(12, 40))) for _ in range(25)]
    lines = [edited(R.choice(base), R.randint(0, 3)) for _ in range(160)]
    rows = [(i, "\n".join(lines[4 * i : 4 * i + 4] + ["", "short"])) for i in range(40)]
    got = by_id(line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), edits=edits, min_chars=8))
    seen = []
    for i, text in rows:
        kept = []
        for line in text.split("\n"):
            if len(line) < 8:
                kept.append(line)
                continue
            if not any(edit_distance(line, s) <= edits for s in seen):
                kept.append(line)
            seen.append(line)
        assert got[i]["text"] == "\n".join(kept)
        assert got[i]["n_dropped"] == 6 - len(kept) and got[i]["n_lines"] == 6


@pytest.mark.parametrize("bucket", [2, 32])
def test_lines_of_a_template(spark, bucket):
    # lines that share most of their text, in crowded keys; some a character longer
    rng = random.Random(3)
    lines = [f"the quick brown fox number {rng.randrange(300):04d} jumps over {rng.choice(['a', 'the', 'th', 'thex'])} dog" for _ in range(300)]
    lines += [x.replace("jumps", rng.choice(["jump", "jumpss", "humps"])) for x in lines[:60]] + ["日本語の行です。" * 6 + c for c in "あいうえおかきくけこ"]
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[5 * i : 5 * i + 5])) for i in range(len(lines) // 5)]
    got = by_id(line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), bucket=bucket))
    seen = []
    for i, text in rows:
        kept = [line for k, line in enumerate(text.split("\n")) if not any(edit_distance(line, s) <= 1 for s in seen + text.split("\n")[:k])]
        seen += text.split("\n")
        assert got[i]["text"] == "\n".join(kept)


def test_a_large_template_makes_few_rows(spark):
    lines = spark.range(100_000).select(F.format_string("ticket %06d was opened by the night shift and closed by the day shift", "id").alias("line"))
    classes = lines.select(F.xxhash64("line").alias("h"), F.struct(F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("tie"), F.monotonically_increasing_id().alias("pos")).alias("first"), "line").checkpoint()
    n = line_dedup.candidates(classes, 1).count()
    assert 300_000 < n < 3_000_000


def test_rows_with_one_id_and_clashing_columns(spark):
    same = "a line that stands in both of the rows that share an identifier"
    rows = [(5, same + "\nonly here", 777, "x", 1), (5, "first of the other row\n" + same, 778, "y", 1), (6, same, 779, "z", 1), (5, same + "\nonly here", 777, "x", 1), (None, same, 1, "w", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, n_dropped string, __gone int")
    out = line_dedup.dedup(d)
    assert out.columns == [*d.columns, "n_lines_", "n_dropped_"]
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"], r["n_lines_"], r["n_dropped_"]) for r in out.collect()), key=str)
    kept = [x for x in got if x[0] == 5]
    assert len(got) == 5 and (None, same, 1, "w", 1, 0) in got and (6, "", 779, "z", 1, 1) in got
    # one of the two different texts keeps the line, and no other line is lost
    assert sum(same in x[1] for x in kept if x[2] == 778) + any(same in x[1] for x in kept if x[2] == 777) == 1
    assert all("first of the other row" in x[1] if x[2] == 778 else "only here" in x[1] for x in kept)


def test_banded_distance(spark):
    rows = []
    for _ in range(300):
        a = "".join(R.choice("ab") for _ in range(R.randint(4, 12)))
        rows.append((a, edited(a + "b", R.randint(0, 3)) or "b"))
    rows = [(a, b) for a, b in rows if min(len(a), len(b)) > 3]
    df = spark.createDataFrame(rows, "a string, b string")
    for edits in (1, 2, 3):
        got = [r[0] for r in df.select(line_dedup.within(F.col("a"), F.col("b"), edits)).collect()]
        assert got == [edit_distance(a, b) <= edits for a, b in rows]


def test_line_dedup_of_odd_rows(docs, nothing):
    out = line_dedup.dedup(docs)
    assert set(docs.columns) <= set(out.columns) and out.count() == docs.count()
    rows = by_id(out)
    assert rows[0]["text"] is None and rows[0]["n_lines"] == 0 and rows[None]["text"] == "no id here at all"
    assert rows[11]["n_dropped"] == 1 and rows[11]["text"] == "" and rows[5]["n_dropped"] == 0
    assert line_dedup.dedup(nothing).count() == 0


def test_short_lines_are_compared_exactly(spark):
    line = "a line of forty characters or more, to be compared"
    texts = ["All rights reserved.\n\n \nx", "x\n\n \nAll rights reserved.\nAll rights reserved!", line + "\nAll rights reserved.", line[:-1] + "!\nend", "\n \nx"]
    got = by_id(line_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i]["text"] for i in range(5)] == [texts[0], "\n \nAll rights reserved!", line, "end", "\n "]
    assert [got[i]["n_dropped"] for i in range(5)] == [0, 2, 1, 1, 1]


# 7


def test_language(spark, docs, nothing):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["thing", "whole", "the", "with"] if i % 2 else ["schon", "über", "nicht", "ich"]) for _ in range(30)), "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "123 !!", "de"), (102, "The Thing", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = by_id(language_id.identify(d, held))
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(60))
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und" and got[102]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.identify(nothing, held).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(d.withColumn("lang", F.lit(None)), held).collect()} == {"und"}


class Partial:
    """Prediction by partial matching with dictionaries, escape method C with exclusion."""

    def __init__(self, texts):
        self.counts = collections.defaultdict(collections.Counter)
        for t in texts:
            t = b"\n" * language_id.DEPTH + t
            for i in range(language_id.DEPTH, len(t)):
                for d in range(language_id.DEPTH + 1):
                    self.counts[t[i - d : i]][t[i]] += 1

    def probability(self, context, byte):
        below = self.probability(context[1:], byte) if context else 1 / 256
        seen = self.counts.get(context)
        if not seen:
            return below
        total, kinds = sum(seen.values()), len(seen)
        if byte in seen:
            return seen[byte] / (total + kinds)
        return kinds / (total + kinds) * below / (1 - sum(self.probability(context[1:], b) if context else 1 / 256 for b in seen))

    def bits(self, text):
        text = b"\n" * language_id.DEPTH + text
        return -sum(math.log2(self.probability(text[i - language_id.DEPTH : i], text[i])) for i in range(language_id.DEPTH, len(text)))


def test_code_lengths_match_brute_force():
    texts = {"x": ["abracadabra banana", "the cat sat"], "y": ["décor à la carte", "日本語"]}
    m = language_id.Model(pa.chunked_array([[t for v in texts.values() for t in v]]), [k for k, v in texts.items() for _ in v])
    new = ["the abracat", "", "日本 décor", "zzz 😀", "Abracadabra"]
    bits, size, letter = m.code_lengths(pa.array(new))
    for k, (_, known) in enumerate(texts.items()):
        p = Partial([t.lower().encode() for t in known])
        assert [round(x, 2) for x in bits[:, k]] == [round(p.bits(t.lower().encode()), 2) for t in new]
    assert size.tolist() == [len(t.encode()) for t in new] and letter.tolist() == [True, False, True, True, True]


def test_code_lengths_are_of_distributions():
    m = language_id.Model(pa.chunked_array([["abracadabra banana", "the cat sat", "\xff".encode().decode() + "é"]]), ["x", "y", "y"])
    for context in (b"bra", b"the", b"zzz", b"at ", b"\n\n\n", bytes([3, 200, 255])):
        keys = np.arange(256, dtype=np.uint32) + np.uint32(int.from_bytes(context, "big") << 8)
        assert max(abs(np.exp2(-m.lengths(k, keys)).sum() - 1) for k in range(len(m.trees))) < 1e-9


def test_languages_of_empty_texts_and_many_languages(spark):
    d = spark.createDataFrame([(1, "hello world", "en"), (2, "bonjour le monde", "fr"), (3, "", "xx"), (4, "hello you", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(d, F.lit(False)).collect()} == {1: "en", 2: "fr", 3: "und", 4: "en"}
    many = [(k, f"text {k:04d} of its own", f"l{k:04d}") for k in range(2000)] + [(5000 + k, "often met words", "often") for k in range(5)]
    d = spark.createDataFrame(many, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(d.where("doc_id < 60 or doc_id >= 1100"), F.lit(False)).where("doc_id < 60 or doc_id >= 5000").collect()}
    assert len(got) == 65 and got[5000] == "often" and got[7] == "l0007"
    # beyond what is kept, code lengths are the same
    model = language_id.Model(pa.chunked_array([["hello world", "bonjour le monde"]]), ["en", "fr"])
    whole = model.code_lengths(pa.array(["hello le monde 😀"]))[0]
    model.keys, model.bits, model.slot = model.keys[::3], model.bits[::3], None
    assert np.allclose(whole, model.code_lengths(pa.array(["hello le monde 😀"]))[0], rtol=1e-6)


# 8


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(prints):
    ids = list(prints)
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_fingerprints(docs, nothing):
    got = simhash.fingerprints(pa.array(TEXTS))
    assert [int(x) for x in got] == [brute_fingerprint(t) for t in TEXTS]
    rows = [r for r in simhash.dedup(docs).collect() if r["doc_id"] is not None]
    want = brute_components({i: brute_fingerprint(t) for i, t in enumerate(TEXTS)})
    assert all(r["fingerprint"] == f"{brute_fingerprint(TEXTS[r['doc_id']]):016x}" and r["component_id"] == want[r["doc_id"]] for r in rows)
    assert simhash.dedup(nothing).count() == 0


@pytest.mark.parametrize("bucket", [4096, 8])
def test_links_are_whole(spark, bucket):
    rng = random.Random(9)
    prints = {}
    for c in range(12):
        x = rng.getrandbits(64)
        for _ in range(30):
            prints[len(prints)] = x
            if c < 8:
                for _ in range(rng.randint(1, 2)):
                    x ^= 1 << rng.randrange(64)
            else:  # many fingerprints around one
                x = prints[30 * c] ^ 1 << rng.randrange(64)
    want = brute_components(prints)
    kinds = {}
    for d, x in prints.items():
        kinds.setdefault(x, d)
    nodes = spark.createDataFrame([(simhash.signed(x),) for x in kinds], "fp long")
    shared.checkpoint_dir(spark)
    got = {r["node"]: r["label"] for r in simhash.components(simhash.near_links(nodes, bucket)).collect()}
    groups = collections.defaultdict(set)
    for x, d in kinds.items():
        groups[got.get(simhash.signed(x), simhash.signed(x))].add(want[d])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_components_of_rows_without_id(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(words[:-2]), " ".join(words[:-3])]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (7, "another text of one word more"), (7, texts[1] + " end"), (None, "alone here")]
    got = simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    prints = {i: brute_fingerprint(t) for i, (_, t) in enumerate(rows)}
    group = brute_components(prints)
    for r in got:
        own = {i for i, p in prints.items() if f"{p:016x}" == r["fingerprint"]}
        ids = [rows[j][0] for j in prints if group[j] in {group[i] for i in own} and rows[j][0] is not None]
        assert r["component_id"] == min(ids, default=None)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 20])
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for k in range(200):
        for b in rng.choice(64, k // 8, replace=False):
            values[k] ^= np.uint64(1) << np.uint64(b) if k else np.uint64(0)
        values[k] = values[0] ^ values[k] if k % 2 else values[k]
    near = np.unpackbits(simhash.within(int(values[0]), simhash.planes(values), list(range(64)), radius).view(np.uint8), bitorder="little")[:300]
    assert near.tolist() == [int(int(x ^ values[0]).bit_count() <= radius) for x in values]


# 9


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = pii.only_digits
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out)


def test_base_spans_match_the_patterns():
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice("ab1203@@..+-( )%é\n5") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text)[0] == brute_spans(text)
    for text in TEXTS:
        assert pii.base_spans(text or "")[0] == brute_spans(text or "")


def test_field_prefers_whole_spans(spark, docs, nothing):
    rng = random.Random(8)
    number = lambda: f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
    texts = [f"word {number()} word a{i}@mail.example.com, more 10.0.{i % 256}.1 and 12 apples" for i in range(300)]
    field = pii.train(texts)
    text = "call +1 (212) 555-1234 10.20.30.40 now"  # the pattern runs on into the address
    base, spans = pii.find(text, field)
    assert set(base) <= set(spans) and (5, 3, 22) in spans
    assert pii.redact(text, spans) == "call [PHONE] [IP] now"
    assert pii.find("12 apples and 1999", field)[1] == []
    rows = by_id(pii.detect(docs))
    assert rows[0]["spans"] == ""
    for i, t in enumerate(TEXTS):
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(b == j for _, b, _ in brute_spans(t or "")) for j in range(4)]
    assert rows[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.detect(nothing).count() == 0


def segmentations(n):
    if n == 0:
        yield []
    for k in range(1, min(n, pii.LONGEST) + 1):
        for rest in segmentations(n - k):
            for kind in range(pii.OTHER + (k == 1)):
                yield [*rest, (n - k, n, kind)]


def test_field_against_enumerated_labellings():
    rng = random.Random(12)
    texts = [f"call +1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)} or mail a{i}@b{i}.example.com, at 10.0.{i % 256}.1 and 12 apples" for i in range(60)]
    field = pii.train(texts)
    for text in ["+1 (212) 555-1234 10.20.30.40", "12 4111 1111 1111 1111", "a@b.example.com +44 20 7946 0000", "1 2 3 4 5"]:
        (words,) = pii.stretches(text)
        n = len(words[0])
        lattice = field.lattice(text, words)
        scores = field.scores(lattice)
        totals = {tuple(x): sum(scores[i, j][kind] for i, j, kind in x) for x in segmentations(n)}
        ahead, behind = field.sums(n, scores)
        assert ahead[n] == pytest.approx(np.logaddexp.reduce(list(totals.values()))) == behind[0]
        top = max(totals, key=totals.get)
        best, found = field.best(text, words)
        assert best == pytest.approx(totals[top])
        assert [x[:3] for x in found] == [x for x in top if x[2] != pii.OTHER]
        for i, j, kind, odds in found:
            assert odds == pytest.approx(scores[i, j][kind] - sum(scores[k, k + 1][pii.OTHER] for k in range(i, j)))


def test_a_long_table_of_numbers():
    import time
    import tracemalloc

    field = pii.train([f"word +1 (212) 555-{i:04d} word a{i}@mail.example.com, 10.0.{i % 256}.1" for i in range(100)])
    rng = random.Random(1)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(100_000)) + " mail me@a.example.com"
    began = time.perf_counter()
    tracemalloc.start()
    base, spans = pii.find(text, field)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(base) >= 1 and most < 60e6 and time.perf_counter() - began < 120


def test_cores_and_time_on_brackets():
    old = re.compile(r"[(+]*[0-9A-Za-z](?:.*[0-9A-Za-z)])?", re.S)
    for _ in range(3000):
        text = "".join(R.choice("(+)a1 -") for _ in range(R.randrange(1, 12)))
        m = old.search(text)
        assert pii.core(text, 0, len(text)) == (m.span() if m else (0, len(text)))
    field, began = pii.Field(), time.perf_counter()
    field.weights[""] = np.zeros(len(pii.KINDS) + 1)
    for text in ("(" * 1_000_000 + "@", "+" * 1_000_000 + "1", "(" * 500_000 + "@ " + "(" * 500_000 + "7"):
        assert pii.find(text, field)[0] == []
    assert time.perf_counter() - began < 30


# 10


def brute_statistics(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, docs):
    more = [prose(R.randint(0, 9)) + "\n" + prose(R.randint(0, 9)) + "\n#|$ a b a b a b\n" * R.randint(0, 3) for _ in range(60)]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    for r in quality.statistics(d).collect():
        if r["doc_id"] is not None:
            text = TEXTS[r["doc_id"]] if r["doc_id"] < 100 else more[r["doc_id"] - 100]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_statistics(text)


def test_rules_are_learned(spark, docs, nothing):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(300):
        words = [f"w{rng.randrange(900)}" for _ in range(80)]
        if i % 4 == 0:
            words = [w + "|" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 != 0)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 0), (1, None)], "doc_id long, quality int")
    got = by_id(quality.judge(d, y))
    assert all(r["kept"] == (i % 4 != 0) and not r["base_failed"] for i, r in got.items())
    assert by_id(quality.judge(d, y.limit(0)))[0]["kept"]
    assert quality.judge(nothing, y).count() == 0
    assert not by_id(quality.judge(docs, y))[0]["kept"]
