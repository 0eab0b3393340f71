"""Edge cases and inner parts of the operators on small tables."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from modengine.llm import chat_tree, common, license_scan, line_dedup, mixing, packing, quality_classifier, quality_rules
from modengine.llm import queries, sharding, simhash_dedup, topk

from .conftest import DATA

TOKENIZER, RANKS = queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("byte_bpe_50k.tiktoken")


# -- shared parts ---------------------------------------------------------------------

def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 9), (9, 9), (7, 5)]
    got = {r["node"]: r["root"] for r in common.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, 5: 3, 9: 3, 7: 3}


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") % 3 == 0).alias("g"), "id", (F.pmod(F.xxhash64("id"), F.lit(997)) / 997).alias("u"))
    rows = common.numbered(df, ["g"], F.col("u"), ["id"], "n", per_bucket=50).collect()
    for g in (True, False):
        assert sorted(r["n"] for r in rows if r["g"] == g) == list(range(sum(r["g"] == g for r in rows)))


# -- 1 ----------------------------------------------------------------------------------

def test_line_dedup_edges(edges, nothing):
    rows = line_dedup.dedup_lines(edges, removed="gone").collect()
    assert line_dedup.dedup_lines(edges).columns == [*edges.columns, "_n_removed_lines"]
    texts = {(r["doc_id"], r["source"]): r["text"] for r in rows}
    by_id = defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append((r["text"], r["gone"]))
    assert len(rows) == edges.count() and texts
    line = "one line of rather more than ten words that stands in several documents here"
    assert by_id[1] == [(None, 0)] and by_id[2] == [("", 0)] and by_id[3] == [("   \n\n \t", 0)]
    assert by_id[5] == [(f"{line}\nalpha beta", 1)]
    assert by_id[6] == [("", 2)]  # a run over both lines has the words
    assert by_id[9] == [("tail", 2)]  # document 5 holds "alpha beta" before the line as well
    assert by_id[7] == [("word " * 30_000, 0)] * 2  # rows of one document
    assert by_id[11] == [("", 1)] and by_id[10][0][1] == 0
    assert line_dedup.dedup_lines(nothing).count() == 0


def plain_dedup(docs: dict[int, list[str]], enough: int) -> dict[int, set[int]]:
    """Lines of every run with enough words that has an earlier copy."""
    seen, gone = {}, defaultdict(set)
    for d in sorted(docs):
        for a in range(len(docs[d])):
            for b in range(a + 1, len(docs[d]) + 1):
                run = tuple(docs[d][a:b])
                if sum(len(x.split()) for x in run) >= enough:
                    if run in seen:
                        gone[d].update(range(a, b))
                    else:
                        seen[run] = (d, a)
    return gone


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(5)
    lines = ["a", "b c", "d e f", "g h i j", "k", "l m"]
    docs = {d: [rng.choice(lines + [f"u{d} {rng.random()}"]) for _ in range(rng.randint(1, 14))] for d in range(40)}
    for enough in (3, 7):
        want = plain_dedup(docs, enough)
        df = spark.createDataFrame([(d, "\n".join(x)) for d, x in docs.items()], "doc_id long, text string")
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df, min_words=enough).collect()}
        assert got == {d: "\n".join(x for i, x in enumerate(v) if i not in want[d]) for d, v in docs.items()}


# -- 2 ----------------------------------------------------------------------------------

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_dedup_last_plan_is_small(spark):
    # Joins of all rounds in one plan ran at once and filled the driver's memory.
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = plan_of(line_dedup.dedup_lines(docs))
    assert plan.count("Join") == 1 and plan.count("Exchange") <= 3


def test_simhash_leaves_are_read_once_made(spark):
    fps = spark.range(3000).select(F.xxhash64("id").alias("fp"))
    assert "Join" not in plan_of(simhash_dedup.vantage_shards(fps, 4, 512))


def test_simhash_edges(edges, nothing):
    rows = simhash_dedup.simhash_groups(edges).collect()
    assert len(rows) == edges.count()
    got = defaultdict(set)
    for r in rows:
        got[r["doc_id"]].add((r["fingerprint"], r["component_id"]))
    assert got[1] == got[2] == got[3] == {("0" * 16, 1)}
    assert ("0" * 16, 1) in got[None] and len(got[None]) == 2
    assert got[10] == got[11] and {c for _, c in got[11]} == {10}
    kept = simhash_dedup.keep_one(edges)
    assert kept.columns == edges.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == ids[7] == ids[10] == ids[None] == 1 and not ids[2] and not ids[3] and not ids[11]
    assert simhash_dedup.simhash_groups(nothing).count() == 0 and simhash_dedup.keep_one(nothing).count() == 0


@pytest.mark.parametrize("shard", [4096, 64, 16])
def test_links_are_exact(spark, shard):
    """Clusters of fingerprints, so that nodes of 16 or 64 are divided, some of them in vain."""
    rng = random.Random(2)
    values = set()
    for _ in range(3):
        base = rng.getrandbits(64)
        for _ in range(150):
            v = base
            for b in rng.sample(range(64), rng.randint(0, 6)):
                v ^= 1 << b
            values.add(v)
    values = sorted(values)
    from .test_queries import plain_components

    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    roots = {r["node"]: r["root"] for r in common.components(spark, simhash_dedup.fingerprint_links(df, 4, shard)).collect()}
    groups = defaultdict(set)
    for v in values:
        groups[roots.get(signed(v), signed(v))].add(v)
    want = defaultdict(set)
    for v, root in plain_components({v: v for v in values}).items():
        want[root].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_vantage_points_divide(spark):
    """Unrelated fingerprints: leaves stay below the bound, and close pairs share one."""
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(6000)]
    pairs = []
    for v in values[:500]:
        w = v
        for b in rng.sample(range(64), 4):
            w ^= 1 << b
        pairs.append((v, w))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in {*values, *[w for _, w in pairs]}], "fp long")
    homes, sizes = defaultdict(set), Counter()
    for r in simhash_dedup.vantage_shards(df, 4, 512).collect():
        homes[r["fp"]].add((r["tree"], r["node"]))
        sizes[r["tree"], r["node"]] += 1
    assert max(sizes.values()) <= 512 and len(sizes) > 3 * 13
    assert all(homes[signed(v)] & homes[signed(w)] for v, w in pairs)
    assert sum(sizes.values()) < 20 * len(values)


# -- 3 ----------------------------------------------------------------------------------

def test_quality_rules_edges(edges, nothing):
    got = {(r["doc_id"], r["n_words"]): r for r in quality_rules.apply_rules(edges).collect()}
    assert got[1, 0]["base_failed"] and not got[2, 0]["kept"]
    long = got[7, 30_000]
    assert (long["n_repeat_words"], long["word_chars"], long["base_failed"]) == (30_000, 120_000, True)
    assert got[5, 30]["n_dup_lines"] == 1 and got[5, 30]["n_repeat_words"] == 28
    assert got[10, 16]["kept"] and quality_rules.apply_rules(nothing).count() == 0


def test_fences_follow_their_group(spark):
    """Sources that write differently are judged by their own habits."""
    short, long = "ab cd ef gh", "extraordinarily incomprehensible circumlocutions notwithstanding"
    rows = [(i, " ".join(f"{w}{i % 7}" for w in (short if s == "brief" else long).split() * 4), "en", s) for s in ("brief", "wordy") for i in range(150)]
    rows += [(900, " ".join(f"{w}9" for w in long.split() * 4), "en", "brief"), (901, " ".join(f"{w}9" for w in short.split() * 4), "en", "wordy")]
    df = spark.createDataFrame([(n, t.replace(" ", f" x{n} ", 1), a, s) for n, (_, t, a, s) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(df, repeat_share=100).collect()}
    assert sorted(d for d, r in got.items() if "word_length" in r["failed"]) == [300, 301]


def test_the_sketches_decide(spark):
    """On the given tables groups have different fences, and verdicts differ from
    those of any one set of cutoffs."""
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/documents.parquet")
    rows = quality_rules.counts(docs.select("doc_id", "lang", "source", "text")).drop("text")
    rows = rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    sql = {n: e for m in quality_rules.MEASURES for n, e in ((m.name, m.value), (f"{m.name}_unit", m.unit))}
    measured = common.written(rows.withColumns({n: F.when(F.col("n_words") > 0, F.expr(f"cast({e} as bigint)")) for n, e in sql.items()}))
    fences = quality_rules.fences(measured, quality_rules.MEASURES)
    low, high = (fences.select(c).distinct().count() for c in ("low_word_length", "high_word_length"))
    assert low >= 3 and high >= 3 and fences.select("high_repeat_words").distinct().count() >= 3
    one = fences.agg(F.median("low_word_length").alias("l"), F.median("high_word_length").alias("h")).first()
    joined = measured.filter(~F.col("base_failed")).join(fences, ["lang", "source"])
    own = ~F.col("word_length").between(F.col("low_word_length"), F.col("high_word_length"))
    assert joined.filter(own != ~F.col("word_length").between(one["l"], one["h"])).count() > 20


def test_bins(spark):
    values = [0, 1, 63, 64, 65, 127, 128, 130, 10 ** 9]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality_rules.bin_of(F.col("v")).alias("b")).collect()
    assert all(0 <= r["v"] - r["b"] <= r["v"] / 32 for r in rows) and rows[3]["b"] == 64


# -- 4 ----------------------------------------------------------------------------------

def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    good = {i: rng.normal(size=6).round(2).tolist() for i in range(0, 300)}
    good[50] = good[100] = good[7]  # ties
    rows = list(good.items()) + [(1000, None), (1050, [nan] * 6), (1100, [None] * 6), (1150, [inf] * 6), (None, good[3]), (2000, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v in good.items()}
    want = {}
    for q in [i for i in whole if i % 50 == 0]:
        ranked = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(ranked)}
    for options in ({}, {"centres": 5, "block": 40, "sample": 60}):
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, **options).collect()}
        assert got == want
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_keeps_rows_that_repeat(spark):
    """Each row is a candidate and a query of its own, whatever its id."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).round(2).tolist()) for i in range(1, 200)]
    rows += [(7, [4.0] * 5), (7, [5.0] * 5), (7, [5.0] * 5), (50, [1.0] * 5), (50, [1.0] * 5), (100, [9.0, 0.0, 0.0, 0.0, 0.0])]
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows]
    want = Counter()
    for n, (i, v) in enumerate(whole):
        if i % 50 == 0:
            best = sorted((-int(v @ w), j) for m, (j, w) in enumerate(whole) if m != n)[:5]
            want.update((i, at + 1, j, -s) for at, (s, j) in enumerate(best))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for options in ({}, {"centres": 4, "block": 30, "sample": 60}):
        got = Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, **options).collect())
        assert got == want


def test_clustered_vectors_are_pruned():
    """Bounds by radii prune most pairs of nodes where vectors form clusters."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    centres *= 256 / np.linalg.norm(centres, axis=1)[:, None]
    points = (centres[:, None] + rng.normal(size=(30, 64, 16))).reshape(-1, 16)
    level = topk.Level(points)
    scores = points @ points.T
    worst = np.sort(scores, axis=1)[:, -6]
    floors = np.array([worst[m].min() for m in level.members])
    met = topk.bound(level.centre, level.radius, level.centre, level.radius) >= floors[:, None]
    assert met.mean() < 0.2 and met.diagonal().all()


# -- 5 ----------------------------------------------------------------------------------

def test_mixing_edges(edges, nothing):
    rows = mixing.mix(edges, F.lit("d"), max_epochs=3, total=200).collect()
    assert rows and {r["epoch"] for r in rows} <= {0, 1, 2}
    mixed = mixing.mixed_documents(edges, F.lit("d"))
    assert mixed.columns == edges.columns and mixed.count() > 0
    assert mixing.mix(nothing, F.lit("d")).count() == 0


def test_repeated_rows_keep_to_the_budget(spark):
    """One row six times, four tokens each, for a budget of eight."""
    df = spark.createDataFrame([(1, "a b c", "en", "s")] * 6, "doc_id long, text string, lang string, source string")
    assert mixing.mix(df, F.lit("d"), total=8).count() == mixing.mixed_documents(df, F.lit("d"), total=8).count() == 2
    rows = spark.createDataFrame([(i % 30, f"t {i % 30}", "en", "s") for i in range(45)], df.schema)
    for total in (30, 100, 200):
        assert mixing.mix(rows, F.lit("d"), total=total).count() == mixing.mixed_documents(rows, F.lit("d"), total=total).count()


def test_budgets(spark):
    leaves = [("a", "x", "1", 100), ("a", "x", "2", 1000), ("a", "y", "3", 500), ("b", "x", "4", 5000)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in mixing.budgets(df, 6000, 2, 0.0).collect()}
    # b and a get 3000 each; a.y can give 1000 of its 1500, so a.x gets 2000; of
    # that source 1 can give 200 and its sibling takes the rest.
    assert got == {"4": 3000, "3": 1000, "1": 200, "2": 1800}


def test_buckets_do_not_change_the_mix(spark):
    df = spark.range(500).selectExpr("id as doc_id", "repeat('w ', int(id % 7)) as text", "'en' as lang", "if(id < 300, 's1', 's2') as source")
    runs = [sorted(map(tuple, mixing.mix(df, F.lit("d"), total=900, bucket=b).collect())) for b in (20_000, 10)]
    assert runs[0] == runs[1] and len(runs[0]) > 100


# -- 6 ----------------------------------------------------------------------------------

def test_license_edges(edges, nothing):
    got = {(r["doc_id"], r["n_words"]): r for r in license_scan.scan(edges).collect()}
    r = got[12, 11]
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["score"]) == (3, 2, 9, "cc-by,reserved", 1.0)
    assert (got[1, 0]["n_base"], got[1, 0]["first_word"], got[1, 0]["labels"], got[1, 0]["score"]) == (0, None, "", 0.0)
    assert license_scan.scan(nothing).count() == 0


def test_gram_hash_is_sparks(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("all"), F.lit("rights")).alias("a"), F.xxhash64(F.lit("under"), F.lit("the"), F.lit("mit")).alias("b")).first()
    assert (row["a"], row["b"]) == (license_scan.gram_hash(["all", "rights"]), license_scan.gram_hash(["under", "the", "mit"]))


def test_shifted_notice(spark):
    words = license_scan.NOTICES[1].words
    text = " ".join(["intro"] * 5 + words[:8] + ["inserted"] + words[8:])
    df = spark.createDataFrame([(1, text), (2, " ".join(words[:6]))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert got[1]["labels"] == "bsd" and got[1]["score"] == 1.0 and got[2]["labels"] == "" and 0 < got[2]["score"] < 0.5


# -- 7 ----------------------------------------------------------------------------------

def test_tokens_by_parts():
    rng = random.Random(1)
    bits = [" ", "  ", "\n", " \n", "\n\n", "a", "b,", "'s", "1", "é", "<|endoftext|>", "\t", "!", "x y", "\r\n", "don't", "日本", "　"]
    for ranks in (RANKS, None):
        encode = packing.Tokens(TOKENIZER, ranks, keep=50)
        for _ in range(1500):
            text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
            assert encode(text) == encode.whole(text), text


def test_packing_edges(edges, nothing):
    rows = packing.pack(edges, TOKENIZER, RANKS, size=64, with_ids=True).collect()
    total = Counter()
    for r in rows:
        total[r["sequence_id"]] += r["length"]
        assert len(r["ids"]) == r["length"]
    assert max(total.values()) <= 64 and len({r["doc_id"] for r in rows}) == len({r["doc_id"] for r in edges.collect()})
    assert [r["doc_tokens"] for r in rows if r["doc_id"] == 1] == [1]
    assert packing.pack(nothing, TOKENIZER, RANKS).count() == 0


def test_open_windows_are_bounded(spark):
    """Pieces of three quarters of a window leave it open; beyond the bound they are cut."""
    text = " ".join(["word"] * 47)
    docs = spark.range(400).selectExpr("id as doc_id", f"'{text}' as text").coalesce(1)
    rows = packing.pack(docs, TOKENIZER, RANKS, size=64, open_windows=20).collect()
    fill, pieces = Counter(), defaultdict(list)
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
        pieces[r["doc_id"]].append((r["start"], r["length"]))
    assert all(sorted(p)[-1][0] + sorted(p)[-1][1] == 48 == sum(n for _, n in p) for p in pieces.values()) and len(pieces) == 400
    short = [n for n in fill.values() if n < 64]
    assert max(fill.values()) == 64 and 0 < len(short) <= 400 // 20
    levels = packing.SumOfSquares(64)
    for n in range(30):
        levels.place((n, 0, 48))
    assert levels.n_open == levels.counts[1:64].sum() == 30


def test_sum_of_squares_choice():
    """Against trying every level."""
    rng, levels = random.Random(4), packing.SumOfSquares(20)
    for n in range(400):
        size, counts = rng.randint(1, 19), levels.counts.copy()
        best = None
        for h in range(0, 21 - size):
            if h and not counts[h]:
                continue
            after = counts.copy()
            after[h] -= bool(h)
            if h + size < 20:
                after[h + size] += 1
            cost = int((after[1:20] ** 2).sum())
            best = cost if best is None or cost < best else best
        levels.place((n, 0, size))
        assert int((levels.counts[1:20] ** 2).sum()) == best


# -- 8 ----------------------------------------------------------------------------------

def test_template_is_reversible():
    rng = random.Random(3)
    bits = ["<", "|", "\\", "<|im_end|>", "<|im_start|>", "a", "\n", ">", "n", "é"]
    for _ in range(3000):
        turns = [("".join(rng.choice(bits) for _ in range(rng.randint(0, 6))), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for _ in range(3)]
        assert chat_tree.parse("".join(chat_tree.render(*t)[0] for t in turns)) == turns


def test_tree_emits_shared_turns_once(spark):
    rng = random.Random(3)
    rows = [
        (c if c else None, t, ["user", "assistant", None][t % 2 if rng.random() < 0.9 else 2], rng.choice(["hi", "<|im_end|>", "", None]))
        for c in range(120) for t in range(rng.randint(1, 5))
    ]
    rows.append(rows[-1])  # a repeated row is a turn
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    stream = common.written(chat_tree.tree(df))
    branches = stream.orderBy("branch").collect()
    at = 0
    for r in branches:
        assert r["start"] == at
        at += len(r["text"])
    said = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        said[c].append(chat_tree.render(role or "", text or "")[0])
    nodes = {tuple(v[:i + 1]) for v in said.values() for i in range(len(v))}
    assert at == sum(len(n[-1]) for n in nodes)
    whole = "".join(r["text"] for r in branches)
    for r in branches:
        read = "".join(whole[i["start"]:i["end"]] for i in r["ancestors"])
        assert len(read) == r["position"] and read + r["text"] == "".join(said[r["conv_id"]])
    assert chat_tree.digests(stream).filter("formatted_chars is null").count() == 0
    assert chat_tree.tree(df.limit(0)).count() == 0


# -- 9 ----------------------------------------------------------------------------------

def test_classifier_edges(spark, edges, nothing):
    none = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    kept = quality_classifier.score_documents(edges, none)
    assert kept.columns == [*edges.columns, "p_text", "p_meta", "_score", "_kept"]
    assert all(r["_kept"] and r["_score"] is None for r in kept.collect())
    both = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 15)] + [(3, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality_classifier.score_documents(edges, both).collect()
    assert len(rows) == edges.count() and all(0 <= r["_score"] <= 1 for r in rows)
    assert quality_classifier.score_documents(nothing, both).count() == 0


# -- 10 ---------------------------------------------------------------------------------

def test_sharding_edges(spark, edges, nothing):
    for df, shards in ((edges, 4), (edges, 16), (spark.range(900).selectExpr("id as doc_id", "if(id < 400, 'a', string(id)) as text"), 8)):
        rows = sharding.shard(df, shards=shards).collect()
        counts = Counter(r["shard"] for r in rows)
        assert len(rows) == df.count() and max(counts.values()) - min([counts[s] for s in range(shards)]) <= 1
        for s in counts:
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    hot = Counter(r["shard"] for r in rows if r["size"] == 2 and r["doc_id"] < 400)
    assert sorted(hot.values())[-3:] >= [112, 112, 112] or len(hot) <= 5  # fills shards instead of spreading
    assert sharding.shard(nothing).count() == 0
