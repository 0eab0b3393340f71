"""Operators 11 to 13: against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from modengine.llm import filter_audit, minhash_dedup, periodic_runs, queries

from .conftest import DATA


# -- 11 (the query itself is held against SQL) ------------------------------------------------

def shingle_set(text, words):
    parts = (text or "").lower().split()
    return {tuple(parts[i:i + words]) for i in range(max(len(parts) - words + 1, 1))} if parts else set()


def plain_groups(texts, words, percent):
    sets = {i: shingle_set(t, words) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def near_copies(rng, base, n, most):
    """Copies of a text with up to ``most`` words changed."""
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(len(words)), rng.randint(0, most)):
            words[at] = f"w{rng.randint(0, 300)}"
        yield " ".join(words)


@pytest.mark.parametrize("words", [4, 5])
def test_minhash_against_brute_force(spark, words):
    """Groups around a text that is there itself, groups without it, chains of
    copies of copies, a passage that unrelated texts share, and short texts."""
    rng = random.Random(words)
    draw = lambda n: [f"w{rng.randint(0, 300)}" for _ in range(n)]
    base, other, passage = draw(120), draw(60), draw(40)
    texts = [*near_copies(rng, base, 80, 12), " ".join(base), " ".join(base).upper(), *near_copies(rng, other, 60, 5)]
    texts += [" ".join(draw(30) + passage + draw(rng.randint(0, 40))) for _ in range(60)]
    chain = draw(80)
    for _ in range(25):
        chain = next(near_copies(rng, chain, 1, 3)).split()
        texts.append(" ".join(chain))
    texts += ["a b", "A  b", "a", "b a", "", None, " \t", "a b c d", "a b c d e", "x y z w v u"]
    rng.shuffle(texts)
    docs = dict(enumerate(texts))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash_dedup.minhash_groups(df, words=words).collect()}
    want = plain_groups(docs, words, 80)
    assert got == want and sum(not k for _, _, k in want.values()) > 40


def test_prefix_keeps_every_pair_with_enough_collisions(spark):
    rng = random.Random(6)
    signatures = {bytes([c]): [rng.choice([rng.randint(-9, 9), c // 4, 7]) for k in range(12)] for c in range(60)}
    df = spark.createDataFrame([(bytearray(c), 10, s) for c, s in signatures.items()], "class binary, n long, signature array<int>")
    lists = {}
    for r in minhash_dedup.postings(df, 7).collect():
        lists.setdefault(r["key"], set()).add(bytes(r["class"]))
    met = {(a, b) for members in lists.values() for a in members for b in members if a < b}
    want = {(a, b) for a in signatures for b in signatures if a < b and sum(x == y for x, y in zip(signatures[a], signatures[b])) >= 7}
    assert want and want <= met
    assert len(lists) < len({(k, v) for s in signatures.values() for k, v in enumerate(s)})  # long lists are skipped


def test_minhash_lowest_bits_pass_every_pair_with_enough_collisions():
    rng = np.random.default_rng(3)
    for coordinates in (12, 64, 100):
        a, b = rng.integers(-1 << 31, 1 << 31, (2, coordinates)).astype(np.int32)
        b[:7] = a[:7]
        x, y = minhash_dedup.planes([a, b])
        words = -(-coordinates // 64)
        assert len(x) == len(y) == minhash_dedup.PLANES * words
        same = sum(all((a[k] ^ b[k]) >> p & 1 == 0 for p in range(minhash_dedup.PLANES)) for k in range(coordinates))
        differ = np.bitwise_or.reduce((x ^ y).reshape(minhash_dedup.PLANES, words), axis=0)
        assert same >= 7 and 64 * words - np.unpackbits(differ.view(np.uint8)).sum() - (64 * words - coordinates) == same


def test_minhash_makes_no_pairs_of_texts_that_share_a_few_passages(spark, monkeypatch):
    """Long texts of passages from one pool: their bitmaps are too full to tell them
    apart, every list holds a share of all texts, and no two are similar."""
    rng = random.Random(12)
    pool = [[f"w{rng.randint(0, 5000)}" for _ in range(400)] for _ in range(24)]
    texts = [" ".join(w for p in rng.sample(pool, 5) for w in p) for _ in range(80)]
    texts += [t + " and one more" for t in texts[:3]]
    met, plain = [], minhash_dedup.confirmed
    monkeypatch.setattr(minhash_dedup, "confirmed", lambda pairs, *args: met.append(pairs.count()) or plain(pairs, *args))
    docs = dict(enumerate(texts))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash_dedup.minhash_groups(df, words=4).collect()}
    want = plain_groups(docs, 4, 80)
    similar = sum(not k for _, _, k in want.values())
    assert got == want and 3 <= similar < 20
    assert similar <= sum(met) < 200


def test_minhash_makes_a_pair_in_few_of_its_lists(spark):
    rng = random.Random(4)
    rows = [(key, bytearray([c]), 9, bytearray([c])) for c in range(40) for key in rng.sample(range(50), 30)]
    df = spark.createDataFrame(rows, "key long, class binary, n long, root binary")
    lists = {}
    for r in minhash_dedup._after_others(df).collect():
        lists.setdefault(r["key"], []).append((bytes(r["class"]), set(r["before"])))
    common, made = Counter(), Counter()
    for members in lists.values():
        for a, x in members:
            for b, y in members:
                if a < b:
                    common[a, b] += 1
                    made[a, b] += not x & y
    assert all(made[pair] for pair in common) and sum(made.values()) < 0.1 * sum(common.values())
    assert sum(map(len, lists.values())) == len(rows)


def test_minhash_edges(spark, edges, nothing):
    rows = minhash_dedup.minhash_groups(edges).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], set()).add(tuple(r)[1:])
    assert len(rows) == edges.count()
    assert got[1] == {(0, 1, True)} and got[2] == {(0, 2, True)} and got[3] == {(0, 3, True)}
    assert got[10] == {(12, 10, True)} and got[11] == {(12, 10, False)}
    assert got[7] == {(1, 7, True)} and got[None] == {(0, None, True), (3, None, True)}
    assert minhash_dedup.minhash_groups(nothing).count() == 0


# -- 12 (the query itself is held against SQL) ------------------------------------------------

def plain_audit(rows, labels, order):
    """(kept, removed, redundant, unique, good, toxic) per step; rows: (id, failing letters)."""
    out, alive = [], list(rows)
    for letter in order:
        gone = [i for i, bad in alive if letter in bad]
        alive = [(i, bad) for i, bad in alive if letter not in bad]
        fails = [i for i, bad in rows if letter in bad]
        out.append((
            len(alive), len(gone), len(fails) - len(gone), sum(bad == {letter} for _, bad in rows),
            sum(labels.get(i, (0, 0))[0] == 1 for i in gone), sum(labels.get(i, (0, 0))[1] == 1 for i in gone),
        ))
    return out


def test_audit_against_every_order(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["xx", "y", "zz x", "", None]), rng.choice(["p", "q", None])) for i in range(60)]
    labels = {i: (rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 70, 2)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = spark.createDataFrame([(i, *v) for i, v in labels.items()] + [(None, 1, 1), (0, *labels[0])], "doc_id long, quality int, toxic int")
    failures = [F.coalesce("text", F.lit("")).contains("x"), F.length(F.coalesce("text", F.lit(""))) < 2]
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(docs, told, failures).collect()}
    want, first = {}, {}
    for i, t, _ in rows:
        first.setdefault(t or "", i)
    for part in ("p", "q", ""):
        mine = [
            (i, {c for c, bad in zip("ABC", ("x" in (t or ""), len(t or "") < 2, first[t or ""] < i)) if bad}) for i, t, p in rows if (p or "") == part
        ]
        per = Counter()
        orders = ["ABC", "ACB", "BAC", "BCA", "CAB", "CBA"]
        for o in orders:
            for letter, step in zip(o, plain_audit(mine, labels, o)):
                per[letter] += step[1]
        for o in orders:
            for n, step in enumerate(plain_audit(mine, labels, o)):
                want[part, o, n + 1] = (*step, per[o[n]])
    assert got == want


def test_audit_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(edges, labels).collect()
    parts = {r["part"] for r in rows}
    assert parts == {"", "en"} and len(rows) == 2 * 120 * 5
    last = {(r["part"], r["filter_order"]): r for r in rows if r["step"] == 5}
    assert len({r["kept"] for r in last.values() if r["part"] == "en"}) == 1
    for part in parts:
        steps = [r for r in rows if r["part"] == part and r["filter_order"] == "EDCBA" and r["step"] == 1]
        n = steps[0]["kept"] + steps[0]["removed"]
        assert n == sum((row[2] or "") == part for row in edges.select("doc_id", "text", "lang").collect())
    # Documents 1 and 2 and the row without id share the empty text; 10 and 11 one text.
    assert sum(r["removed"] for r in rows if r["filter_order"] == "EABCD" and r["step"] == 1) == 3
    assert filter_audit.audit(nothing, labels).count() == 0


def test_audit_of_many_parts(spark):
    """More prefixes than Spark lets a recursion make by itself; the limit is put back."""
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "100")
    try:
        docs = spark.range(40).selectExpr("id as doc_id", "'a' as text", "cast(id as string) as lang")
        labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
        assert filter_audit.audit(docs, labels).count() == 40 * 600 and spark.conf.get(limit) == "100"
    finally:
        spark.conf.set(limit, before)


# -- 13 -----------------------------------------------------------------------------------------

def plain_runs(words, enough=24, times=3):
    """All runs, by trying every period at every place."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(enough, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def some_words(rng):
    out = []
    for _ in range(rng.randint(0, 7)):
        if rng.random() < 0.5:
            out += [rng.randint(0, rng.choice([1, 3, 50])) for _ in range(rng.randint(0, 40))]
        else:
            root = [rng.randint(0, rng.choice([1, 2, 30])) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 40]))]
            out += (root * 12)[:int(len(root) * rng.uniform(1.5, 7)) + rng.randint(0, 20)]
    return out


@pytest.mark.parametrize("enough,times", [(24, 3), (2, 3), (40, 3), (24, 5)])
def test_runs_against_brute_force(enough, times):
    rng = random.Random(enough * times)
    for _ in range(60):
        docs = [some_words(rng) for _ in range(rng.randint(1, 7))] + [[rng.randint(0, 1) for _ in range(150)]]
        got = periodic_runs.find_runs([np.array(d, dtype=np.int64) for d in docs], enough, times)
        assert got == [plain_runs(d, enough, times) for d in docs]


def test_transform_is_exact():
    rng = np.random.default_rng(3)
    for size in (4, 32, 256):
        windows = rng.integers(0, 2000, (5, size)).astype(np.uint64)
        patterns = np.zeros((5, size), dtype=np.uint64)
        patterns[:, :size // 2] = rng.integers(0, 2000, (5, size // 2))
        got = periodic_runs.transform(size).correlate(windows, patterns)
        for j in range(size // 2 + 1):
            assert (got[:, j] == (windows[:, j:j + size // 2] * patterns[:, :size // 2]).sum(axis=1)).all()


def test_long_runs_cost_little():
    """Inside a run every multiple of its period matches at every scale."""
    docs = [np.zeros(100_000, dtype=np.int64), np.array(([0] * 3000 + [1]) * 10)]
    runs = periodic_runs.find_runs(docs)
    assert runs[0] == [(0, 100_000, 1)] and len(runs[1]) == 11 and runs[1][0] == (0, 3000, 1) and (0, 30_010, 3001) in runs[1]


def test_runs_edges(spark, edges, nothing):
    with_names = edges.withColumnRenamed("th", "runs")
    out = periodic_runs.periodic_runs(with_names)
    assert out.columns == [*with_names.columns, "_runs", "best_run", "collapsed"]
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert [tuple(got[i][0][c] for c in ("_runs", "best_run", "collapsed")) for i in (1, 2, 3)] == [([], None, "")] * 3
    assert [r["collapsed"] for r in got[7]] == ["word", "word"] and got[7][0]["best_run"].asDict() == {"start": 0, "length": 30_000, "period": 1}
    assert got[13][0]["collapsed"] == "日本語 の テキスト é" and periodic_runs.periodic_runs(nothing).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(edges, times=2)


def test_periodic_query(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op13_periodic_runs"](spark, DATA).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert set(got) == set(texts)
    total = 0
    for i, text in texts.items():
        words, h = re.findall(r"[^\x20\x09-\x0D]+", text or ""), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        elif n > 1500:
            continue  # brute force is quadratic
        runs = plain_runs(words)
        total += len(runs)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[i] == (
            len(runs), *((*best, 1000 * best[1] // best[2]) if best else [None] * 4), sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            sha(" ".join(w for k, w in enumerate(words) if k not in gone)),
        )
    assert total > 20
