"""Mixing by schedules: targets, places and odd tables by brute force."""

import collections
import hashlib
import random
import re

import duckdb
import pytest

from strikeflow.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SIZE = lambda text: len(WORD.findall(text or ""))
R = random.Random(5)


def shared_targets(sizes, weights, share, most):
    """Sharing again and again what sources that are full leave."""
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), share * sum(sizes.values())
    while open_:
        weight = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / weight >= most * sizes[s]]
        if not over:
            return target | {s: left * weights[s] / weight for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def area(schedule, t, steps=20_000):
    """The integral up to t, by the midpoint rule."""
    total = 0.0
    for (t0, w0), (t1, w1) in zip(schedule[:-1], schedule[1:]):
        to = min(t, t1)
        n = max(1, int(steps * (to - t0))) if to > t0 else 0
        total += sum(w0 + (w1 - w0) * ((k + 0.5) * (to - t0) / n) / (t1 - t0) for k in range(n)) * ((to - t0) / n if n else 0)
    return total


def brute(rows, schedules=mixing.SCHEDULES, share=mixing.SHARE, most=mixing.MOST):
    """(size, source_size, target, taken) of each of rows (doc_id, text, source) by index, without repeated rows."""
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(SIZE(t) for _, t, x in rows if x == s) for s in sources}
    weights = {s: mixing.integral(schedules[k % len(schedules)]) for k, s in enumerate(sources)}
    targets = shared_targets(sizes, weights, share, most)
    out = {}
    for s in sources:
        own = sorted((int(hashlib.md5(f"{'' if d is None else d}:{t or ''}".encode()).hexdigest()[:15], 16), i) for i, (d, t, x) in enumerate(rows) if x == s)
        left = int(targets[s] + 0.5)
        epochs = left // sizes[s] if sizes[s] else 0
        left -= epochs * sizes[s]
        for _, i in own:
            size = SIZE(rows[i][1])
            more = min(size, left)
            left -= more
            out[i] = (size, sizes[s], targets[s], epochs * size + more)
    return [out[i] for i in range(len(rows))]


@pytest.fixture(scope="module")
def rows():
    sources = ["a", "b", "é", "Z", None, "", "𝔸", "￿", "small"]
    found = [(i, " ".join("w" * R.randrange(1, 5) for _ in range(R.randrange(0, 60))), R.choice(sources[:-1]) if i % 3 else "a") for i in range(400)]
    return [*found, (400, None, "a"), (401, "", None), (402, " \t\n", "b"), (403, "one\x0btwo\x0cthree\xa0four", "small"), (404, "x " * 200_000, "b"), (None, "no id", "é")]


def test_targets_and_places_match_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, source string, Size string, __h long").repartition(5)
    got = mixing.place(docs).collect()
    want = brute(rows)
    key = lambda d: (d is None, d or 0)
    told = sorted(((r["doc_id"], r["size_"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got), key=lambda r: key(r[0]))
    assert told == sorted(((d, a, b, round(c, 6), e) for (d, _, _), (a, b, c, e) in zip(rows, want, strict=True)), key=lambda r: key(r[0]))
    assert {r["Size"] for r in got} == {"clash"} and {r["__h"] for r in got} == {7}
    per = collections.Counter()
    for r in got:
        per[r["source"]] += r["taken"]
        assert sum(c["words"] for c in r["copies"]) == r["taken"] <= 2 * r["size_"]
    assert all(abs(per[r["source"]] - r["target"]) <= 0.5 for r in got)
    assert sum(per.values()) == pytest.approx(1.5 * sum(SIZE(t) for _, t, _ in rows), abs=len(per))


def test_copies_are_due_when_the_schedule_has_asked_for_them(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    schedules = (((0.0, 0.0), (0.25, 2.0), (1.0, 0.0)), ((0.0, 1.0), (1.0, 1.0)))
    share, most = 1.5, 2
    got = mixing.mix(docs, schedules=schedules, share=share, most=most).collect()
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    budget = int(share * sum(SIZE(t) for _, t, _ in rows) + 0.5)
    ranks = {s: k for k, s in enumerate(sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode())))}
    total = collections.Counter()
    for r in got:
        total[r["source"]] += r["words"]
    seen = collections.Counter()
    for r in got:
        if r["words"]:
            schedule = schedules[ranks[r["source"]] % 2]
            asked = area(schedule, (r["position"] + 0.5) / budget) / mixing.integral(schedule) * total[r["source"]]
            # what a source has given when a copy comes is what its schedule has asked for by then
            assert abs(asked - seen[r["source"]]) <= 3 + 0.01 * total[r["source"]]
        seen[r["source"]] += r["words"]


def test_repeats_ties_and_empty_tables(spark):
    rows = [(1, "same words here", "s")] * 30 + [(2, "", "s")] * 5 + [(3, "other", None)] * 4
    got = mixing.place(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    assert len(got) == len(rows) and len({tuple(r) for r in map(str, got)}) == 3
    assert sum(r["taken"] for r in got) == pytest.approx(1.5 * 94, abs=31)
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.place(empty).count() == 0 and mixing.mix(empty).count() == 0
    blank = mixing.place(spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in blank] == [(0, 0.0, 0)] * 2
    with pytest.raises(ValueError, match="more than all sources"):
        mixing.place(empty, share=3.0)


def test_reruns_agree_and_sql_too(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    one = mixing.op13_mixing(spark, str(tmp_path))
    ordered = lambda found: sorted(map(tuple, found), key=str)
    found = ordered(one.collect())
    again = mixing.place(docs.repartition(7))
    assert sorted((r["doc_id"] or -1, r["taken"], str([c["position"] for c in r["copies"]][:1])) for r in again.collect()) == sorted((r[0] or -1, r[4], str([r[6]] if r[5] else [])) for r in found)
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = db.sql(mixing.ORACLE)
        assert sorted(want.columns) == sorted(one.columns)
        assert ordered(want.select(*one.columns).fetchall()) == found


def test_sources_are_ranked_over_many_partitions(spark):
    rows = [(i, "a b", f"s{i:05d}") for i in range(3000)]
    got = mixing.place(spark.createDataFrame(rows, "doc_id long, text string, source string"), most=3.0).collect()
    level = 1.5 * 6000 / 6000
    assert {(r["doc_id"] % 3, round(r["target"], 9)) for r in got} == {(0, round(3 * level, 9)), (1, round(level, 9)), (2, round(2 * level, 9))}
