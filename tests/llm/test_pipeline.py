"""The pipeline and the guard of the entry module."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns and after.count() <= before
            if name == "pii":
                assert after.count() == before
            before = after.count()
        docs = after
    assert docs.select("doc_id").distinct().count() == before
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_entry_lists_every_operator():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names


def test_entry_works_without_the_subpackage(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("corpus_pipeline.py", "strikeflow", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "strikeflow").mkdir()
    for p in (ROOT / "strikeflow").iterdir():
        if p.name != "llm":
            (tmp_path / "strikeflow" / p.name).symlink_to(p)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(sum(n.startswith('op') for n in e.queries()), len(e.queries()) > 50)"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert said.stdout.split()[-2:] == ["0", "True"], said.stderr[-500:]


def _jaccard(a, b, words=5):
    sets = []
    for text in (a, b):
        w = text.lower().split()
        sets.append({" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_stage_matches_brute_force(spark):
    import random

    import corpus_pipeline
    from strikeflow.llm import near

    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(30)]
    texts = []
    for k in range(40):
        base = [word() for _ in range(rng.randint(3, 120))] + (passage if k % 2 else [])
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            base = copy if rng.random() < 0.5 else base
    rng.shuffle(texts)
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and _jaccard(texts[i], texts[j]) >= 0.8:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {i for i, x in enumerate(label) if i == x}
    assert len(want) < len(texts) - 40
    assert {r["doc_id"] for r in corpus_pipeline.dedup_near(spark, docs, SF).collect()} == want
    # rare keys late as well, in small buckets: the order of shingles doesn't change the links
    got = near.components(docs, hot=0, bucket=2).groupBy("component").agg({"doc_id": "min"}).collect()
    assert {r[1] for r in got} == want
    assert near.components(docs.limit(0)).count() == 0


def test_parities_lose_no_similar_pair():
    import numpy as np
    from strikeflow.llm import near

    rng = np.random.default_rng(3)
    sets = []
    for size in (0, 1, 7, 200, 210, 1000, 1200, 9000):
        base = rng.integers(0, 2**63, size, dtype=np.uint64)
        for share in (1.0, 0.9, 0.8, 0.5):
            sets.append(np.unique(np.concatenate([base[: int(size * share)], rng.integers(0, 2**63, int(size * (1 - share) / 3), dtype=np.uint64)])))
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    odd = near.parities(np.concatenate(sets), bounds)
    told = near.Parities(odd, np.diff(bounds))
    i, j = np.triu_indices(len(sets), 1)
    may = told.may_be_similar(i, j)
    similar = np.array([5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    assert may[similar].all() and similar.sum() > 20 and may[~similar].mean() < 0.2


def test_sets_of_a_template_are_not_paired(spark, monkeypatch):
    import random

    from strikeflow.llm import near

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    template, seen = [word() for _ in range(150)], []
    count = near.verified
    monkeypatch.setattr(near, "verified", lambda pairs, sets: seen.append(pairs.count()) or count(pairs, sets))
    taken = []
    for n in (250, 500):
        docs = spark.createDataFrame([(k, " ".join(template + [word() for _ in range(60)])) for k in range(n)], "doc_id long, text string")
        seen.clear()
        assert near.components(docs).select("component").distinct().count() == n
        taken.append(sum(seen))
    assert taken[1] < 3 * taken[0]


def test_near_stage_finds_pairs_at_the_bound(spark):
    import random

    from strikeflow.llm import near

    # 100 shingles, 88 or more of them left: a similarity from 0.8 on; each pair stands alone
    rng = random.Random(2)
    word = lambda: f"{rng.randrange(10**9)}"
    rows, linked = [], []
    for k in range(400):
        base = [word() for _ in range(rng.randint(80, 160))]
        copy, n = list(base), len(base) - 4
        at = rng.randrange(5, len(base) - 30)
        for x in range(at, at + max(1, n // 9 - 4)):  # one run of changed words
            copy[x] = word()
        if _jaccard(" ".join(base), " ".join(copy)) >= 0.8:
            linked.append(k)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    got = {r["doc_id"]: r["component"] for r in near.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[2 * k] == got[2 * k + 1] for k in linked)
    assert len(linked) > 300 and found >= 0.99 * len(linked)
    assert len(set(got.values())) == len(rows) - found


def test_near_stage_keeps_one_row_of_repeated_ones(spark):
    import corpus_pipeline

    one, two, three, four = (" ".join(f"{c}{i}" for i in range(40)) for c in "abcd")
    rows = [(1, one), (1, one), (1, one), (2, one), (None, one), (3, two), (3, four), (None, three), (None, three + " end"), (5, None), (None, "")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id int, text string, source string").repartition(3)
    got = corpus_pipeline.dedup_near(spark, docs, SF)
    assert got.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert {x for x in got if x[0] is not None} == {(1, one), (3, two), (3, four), (5, None)} and len(got) == 5
    assert len([x for x in got if x[0] is None]) == 1 and [x[1] for x in got if x[0] is None][0] in (three, three + " end")


def test_near_stage_broadcasts_no_row_of_a_document_without_neighbours(spark, monkeypatch):
    import corpus_pipeline
    from strikeflow.llm import shared

    own = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(60)]
    rows = [*enumerate(own), (100, own[0] + " end"), (101, own[1]), (2, own[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sizes, small = [], shared.small
    monkeypatch.setattr(shared, "small", lambda df, *limit: sizes.append(df.count()) or small(df, *limit))
    want = [(i, own[i]) for i in range(60)]
    assert sorted(map(tuple, corpus_pipeline.dedup_near(spark, docs, SF).collect())) == want
    assert 0 < max(sizes) <= 4
    # with all of these tables too large to be broadcast, and a bitmap that is full
    monkeypatch.setattr(shared, "FEW", 0)
    assert sorted(map(tuple, corpus_pipeline.dedup_near(spark, docs, SF).collect())) == want
    monkeypatch.setattr(shared, "BITS", (64, 64))
    assert sorted(map(tuple, corpus_pipeline.dedup_near(spark, docs, SF).collect())) == want


def test_large_buckets_without_broadcasts(spark, monkeypatch):
    from strikeflow.llm import near, shared

    common = " ".join(f"c{j}" for j in range(60))
    texts = [f"{common} own{i} and{i}" for i in range(30)] + [" ".join(f"z{i}y{j}" for j in range(20)) for i in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = lambda: {(r["component"], r["n"]) for r in near.components(docs).groupBy("component").agg({"*": "count"}).toDF("component", "n").collect()}
    want = got()
    assert sorted(n for _, n in want) == [1] * 10 + [30]
    monkeypatch.setattr(shared, "FEW", 0)
    assert got() == want


def test_bitmap_loses_no_key(spark):
    import numpy as np

    from strikeflow.llm import shared

    keys = np.random.default_rng(4).integers(-(1 << 63), 1 << 63, 5000)
    bits = shared.bitmap(spark.createDataFrame([(int(x),) for x in keys[:1000]], "key long").checkpoint())
    held = shared.may_hold(bits, keys)
    assert held[:1000].all() and held[1000:].mean() < 0.15
    assert not shared.may_hold(shared.bitmap(spark.createDataFrame([], "key long")), keys).any()


def _pipeline_docs():
    import random

    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(3000)}"
    line = lambda n=14: " ".join(word() for _ in range(n))
    rows, labels = [], []
    footer = "this footer of more than forty characters stands in many documents"
    for i in range(120):
        text = "\n".join(line() for _ in range(4))
        toxic = i % 6 == 0
        if toxic:
            text += f"\n{word()} vileword vileword {word()}."
        if i % 5 == 1:
            text += "\n" + footer
        rows.append((i, text))
        labels.append((i, 1, int(toxic)))
    long = [word() for _ in range(300)]
    near = list(long)
    near[150] = "changed"
    rows += [(200, " ".join(long)), (201, " ".join(near)), (202, rows[1][1]), (203, None), (204, ""), (205, f"write to me@mail.example.com {line()}"), (206, line(2500))]
    rows += [(207, line()), (207, "another text with the same number " + line()), (207, "a repeated row " + line())]
    rows += [rows[-1], (None, "no number " + line())]
    return rows, labels


def test_run_matches_brute_force(spark, tmp_path):
    """Each stage by plain Python over the rows that its predecessor kept, but for the two trained ones, which are held against what was planted."""
    from pyspark.sql import functions as F

    import corpus_pipeline
    from strikeflow.llm import packing

    rows, labels = _pipeline_docs()
    docs = spark.createDataFrame([(*r, "s", 7, "x") for r in rows], "doc_id long, text string, source string, n_dropped int, __key string").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "simhash_dedup", "pii", "best_fit_packing"]
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    before = read("documents.parquet")
    for name, stage in stages.items():
        stage(spark, before, str(tmp_path)).write.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert read(name).columns == docs.columns and read(name).where("n_dropped <> 7 or __key <> 'x'").count() == 0
        before = read(name)
    rows_of = lambda name: sorted(((r["doc_id"], r["text"]) for r in read(name).collect()), key=str)
    clean = rows_of("toxicity")
    assert clean == sorted((r for r in rows if "vileword" not in (r[1] or "")), key=str)
    # lines: the first of equal ones stays, in the order of the number and a hash of the text; equal rows count once
    hashes = {r["text"]: r["h"] for r in read("toxicity").select("text", F.xxhash64("text").alias("h")).collect()}
    first, kept = {}, {}
    for doc, text in sorted({r for r in clean if r[0] is not None}, key=lambda r: (r[0], hashes[r[1]])):
        out = []
        for pos, x in enumerate((text or "").split("\n")):
            if not x.strip() or first.setdefault(x, (doc, text, pos)) == (doc, text, pos):
                out.append(x)
        kept[doc, text] = text if text is None or len(out) == len(text.split("\n")) else "\n".join(out)
    lines = [(d, t if d is None else kept[d, t]) for d, t in clean]
    lines = sorted((r for r, was in zip(lines, clean, strict=True) if r[1] == was[1] or r[1].strip()), key=str)
    assert rows_of("line_dedup") == lines
    # near-duplicates: one row of each component
    label = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if label[i] != label[j] and _jaccard(lines[i][1] or "", lines[j][1] or "") >= 0.8:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    groups = {}
    for r, k in zip(lines, label, strict=True):
        groups.setdefault(k, []).append(r)
    left = rows_of("simhash_dedup")
    assert len(left) == len(groups)
    for own in groups.values():
        ids = [d for d, _ in own if d is not None]
        assert sum(r in own for r in left) >= 1 and all(r[0] == min(ids) for r in left if r in own and ids)
    redacted = dict(r for r in rows_of("pii") if r[0] not in (None, 207))
    assert redacted[205].startswith("write to [EMAIL] w") and all(redacted[d] == t for d, t in left if d not in (None, 205, 207))
    pieces = read("best_fit_packing")
    encode = packing.encoder(packing.vocabulary())
    import pyarrow as pa

    ids, bounds = encode(pa.array([t for _, t in rows_of("pii")], pa.string()))
    assert pieces.agg(F.sum("length")).first()[0] == len(ids) + len(left)
    over = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).where("n <> end or n > 1024")
    assert over.count() == 0 and corpus_pipeline.run(spark, str(tmp_path)).count() == pieces.count()


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
