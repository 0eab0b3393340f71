"""Attacks, sources, streaming and models."""

import hashlib
import itertools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from modengine.functions import lexicon
from modengine.functions.obfuscation import _rewritten, _rewritten_in_turn, obfuscate, obfuscate_by, obfuscate_in_turn
from modengine.functions.text import fold_synonyms, normalize_obfuscation
from modengine.operators import attacks, cleaning, models, resilience, tagging
from modengine.plans import attacks as plans, learning
from modengine.sources import comments, results
from modengine.sources.checkpoint import cut_lineage
from modengine.streaming import cleaning as stream

SMOKE_DIR = "/root/testdata/sf0.001"
TEXT = "This is a Silly\ncomment, I hate it"


def attacked(spark, pattern, text=TEXT, key="k"):
    df = spark.createDataFrame([(text, key)], "text string, key string")
    return df.select(obfuscate(F.col("text"), F.col("key"), pattern)).first()[0]


def test_attack_shapes(spark):
    a = {p: attacked(spark, p) for p in lexicon.PATTERNS}
    chars = len(TEXT) - 1  # without the line feed
    assert a["space_injection"] == "".join(c if c == "\n" else c + " " for c in TEXT)
    assert len(a["special_chars"]) == len(a["emoji_injection"]) == len(a["zero_width"]) == 2 * chars + 1
    assert set(a["special_chars"][1:8:2]) <= set(lexicon.SPECIAL_CHARS)
    assert 2 * chars <= len(a["char_repetition"]) - 1 <= 3 * chars
    assert a["case_variation"].lower() == TEXT.lower() and a["case_variation"] != TEXT
    assert len(a["leetspeak"]) == len(TEXT) and a["leetspeak"][0] == "T" and a["leetspeak"] != TEXT
    assert a["character_swapping"].startswith("hTsi si a iSll")
    assert a["word_substitution"].split()[-2] in lexicon.SYNONYMS["hate"]
    assert a["unicode"] == TEXT and attacked(spark, "no such attack") == TEXT
    assert attacked(spark, "character_swapping", "hello") == "ehllo"
    assert attacked(spark, "unicode", "ﬁ Ａ\n①") == "fi A\n1"
    assert all(attacked(spark, p, "") == "" for p in lexicon.PATTERNS)


ODD = ["", "a", "\n", "ab\n\nc d_e", "é\u0301x ﬁ Ａ①½", "😡tie a\U00010400\U00010401b", "one two three " * 40 + "\n"]


def _symbols(key, salt, n, symbols):
    share = 16 // len(symbols)
    blocks = max(-(-n // (32 if share * len(symbols) == 16 else 28)) + (share * len(symbols) != 16), 1)
    digits = "".join(hashlib.md5(f"{key}:{salt}:{b}".encode()).hexdigest() for b in range(1, blocks + 1))
    image = [s for s in symbols for _ in range(share)]
    drawn = [image[int(d, 16)] for d in digits if int(d, 16) < len(image)]
    return (drawn + [symbols[0]] * n)[:n]


def _plainly(pattern, t, key):
    """The attack, character by character."""
    bits, after = _symbols(key, pattern, len(t), "01"), lambda symbols: "".join(c if c == "\n" else c + s for c, s in zip(t, symbols))
    return {
        "leetspeak": lambda: "".join(lexicon.LEET.get(c, [c])[-int(b)] for c, b in zip(t, bits)),
        "space_injection": lambda: after(" " * len(t)), "zero_width": lambda: after(lexicon.ZERO_WIDTH * len(t)),
        "char_repetition": lambda: "".join(c if c == "\n" else c * (2 + int(b)) for c, b in zip(t, bits)),
        "special_chars": lambda: after(_symbols(key, pattern, len(t), lexicon.SPECIAL_CHARS)),
        "emoji_injection": lambda: after(_symbols(key, pattern, len(t), lexicon.EMOJI)),
        "case_variation": lambda: "".join((c.upper() if b == "1" else c.lower()) if c.isascii() else c for c, b in zip(t, bits)),
        "unicode": lambda: "".join(unicodedata.normalize("NFKC", c) for c in t),
        "character_swapping": lambda: re.sub(r"(\w)(\w)", r"\2\1", t),
    }[pattern]()


def test_attacks_on_odd_texts_need_no_array_of_characters(spark):
    """The same as character by character, and no element per character in the JVM."""
    rows = [(f"k{i}", t) for i, t in enumerate([*ODD, None])]
    out = attacks.obfuscation_variants(spark.createDataFrame(rows, "key string, text string"), "text", "key")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "split(" not in plan
    got = {(r["key"], r["pattern"]): r["attacked"] for r in out.collect()}
    assert len(got) == len(rows) * 11
    for (key, pattern), value in got.items():
        t = dict(rows)[key]
        if pattern not in ("original", "word_substitution"):
            assert value == (None if t is None else _plainly(pattern, t, key)), (pattern, t)
    by_number = spark.createDataFrame([(7, "tie"), (None, "tie")], "key long, text string")
    got = [r[0] for r in by_number.select(obfuscate(F.col("text"), F.col("key"), "case_variation")).collect()]
    assert got[0] == _plainly("case_variation", "tie", 7) and got[1].lower() == "tie"


def test_attacks_in_turn_are_one_call(spark):
    """The same as attack after attack, by a single evaluation in Python."""
    said = "I hate it, kill_ KILL! stupid\n\u212aill die\u0301 or die"
    turns = [list(p) for p in itertools.permutations(["word_substitution", "zero_width", "unicode", "case_variation", "no such attack"], 3)]
    turns += [[p, "word_substitution"] for p in lexicon.PATTERNS] + [["leetspeak"], []]
    rows = [(i, f"k{i}:{j}", t, names) for i, t in enumerate([said, *ODD, None]) for j, names in enumerate(turns)]
    df = spark.createDataFrame(rows, "id int, key string, text string, names array<string>")
    got = df.withColumn("out", obfuscate_in_turn(F.col("text"), F.col("key"), F.col("names")))
    staged = df.withColumn("out", F.col("text"))
    for stage in (1, 2, 3):
        name, key = F.coalesce(F.try_element_at("names", F.lit(stage)), F.lit("none")), F.concat("key", F.lit(f":{stage}"))
        staged = cut_lineage(staged.withColumn("out", obfuscate_by(F.col("out"), key, name)))
    assert {r["key"]: r["out"] for r in got.collect()} == {r["key"]: r["out"] for r in staged.collect()}
    base = spark.createDataFrame([(1, said, "toxic"), (2, said, "clean")], "base_id int, text string, class string")
    plan = attacks.attack_rows(base)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("udf, names", [(_rewritten, ["emoji_injection"] * 40), (_rewritten_in_turn, [["emoji_injection", "char_repetition"]] * 40)])
def test_attacked_batches_are_handed_on_in_parts(udf, names):
    """No attacked batch is held: what one batch gives leaves as several arrays, in order."""
    texts = ["x" * 10] * 38 + ["y" * (1 << 20), None]
    batch = tuple(pa.array(x) for x in (texts, [f"k{i}" for i in range(40)], names))
    parts = [x for x in udf.func(iter([batch] * 3))]
    assert sum(map(len, parts)) == 120 and len(parts) >= 4
    assert [x for p in parts for x in p.to_pylist()].count(None) == 3
    assert len(next(iter(udf.func(itertools.chain([batch], itertools.repeat(batch)))))) == 39


@pytest.mark.parametrize("text, want", [
    ("", ""), (None, ""), ("...", ""), ("a a a", "aaa"), ("aaa bb-b", "abbb"), ("n n\n\nn", "nnn"), ("ＡＡＡ ﬁ", "afi"), ("😡x\u200by😡", "xy"),
])
def test_normalizer(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(normalize_obfuscation(F.col("t"))).first()[0] == want


def test_keywords_are_searched_once(spark):
    """Labels that share a word share its search: the keyword is tested once per text."""
    df = spark.createDataFrame([(1, "kill it", "k1ll it")], "id int, text string, attacked string")
    plan = lambda out: out._jdf.queryExecution().optimizedPlan().toString()
    assert plan(tagging.weak_labels(df.select("id", "text"))).count("painfully") == 1
    assert plan(resilience.with_truth(df)).count("painfully") == 1
    assert plan(resilience.attack_predictions(resilience.with_truth(df), ["id"], truth="truth")).count("painfully") == 2
    assert plan(resilience.defence_gain(resilience.with_truth(df), ["id"], truth="truth")).count("painfully") == 3


def test_levels_label_the_original_once_for_all_variants(spark):
    """The labels of a text are found before it is fanned out, and one call in Python makes all stages."""
    plan = plans.resilience_by_level(spark, SMOKE_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert plan.split("explode(sequence")[0].count("painfully") == 1  # above the fan-out only the attacked text is searched
    rows = attacks.attack_rows(spark.createDataFrame([(1, "kill", "threat", 5)], "base_id int, text string, class string, more int"), keep=["more"])
    assert [r["more"] for r in rows.collect()] == [5, 5, 5]


def test_synonyms_fold_back(spark):
    got = attacked(spark, "word_substitution", "hate, Kill! stupid", "z")
    df = spark.createDataFrame([(got,)], "t string")
    assert df.select(fold_synonyms(F.col("t"))).first()[0] == "hate, kill! stupid"


def test_normalizer_undoes_attacks(spark):
    for p in ("space_injection", "special_chars", "zero_width", "emoji_injection", "case_variation"):
        df = spark.createDataFrame([(attacked(spark, p, "so stupid it is"),)], "t string")
        assert df.select(normalize_obfuscation(F.col("t"))).first()[0] == "sostupiditis"


def test_attack_set_counts(spark):
    classes = [*lexicon.LABELS, "clean"]
    base = spark.createDataFrame([(i, f"text number {i}", c) for i, c in enumerate(classes * 3)], "base_id int, text string, class string")
    rows = attacks.build_attack_set(base, 500).collect()
    assert len(rows) == 71 * 6 * 3 + 71
    toxic = [r for r in rows if r["class"] != "clean"]
    clean = [r for r in rows if r["class"] == "clean"]
    assert all(r["obfuscation_level"] == len(set(r["pattern"].split("+"))) in (2, 3) for r in toxic)
    assert all(0.7 <= r["confidence"] < 1 and r["is_toxic"] == 1 for r in toxic)
    assert all(r["text"] == r["original_text"] and r["pattern"] == "clean" and 0.8 <= r["confidence"] < 1 for r in clean)


def test_tolerant_and_strict_csv(spark, tmp_path):
    path = str(tmp_path / "c.csv")
    (tmp_path / "c.csv").write_text(
        "id,comment_text," + ",".join(lexicon.LABELS) + "\n"
        '1,"two\nlines, ""quoted""",1,0,0,0,0,0\n2,short,1\n3,long,0,0,0,0,0,0,extra\n4,,0,0,0,0,0,1\n'
    )
    rows = {r["id"]: r for r in comments.read_comments(spark, path).collect()}
    assert sorted(rows) == ["1", "2", "4"]
    assert rows["1"]["comment_text"] == 'two\nlines, "quoted"' and rows["2"]["threat"] is None
    assert rows["4"]["comment_text"] is None and rows["4"]["identity_hate"] == 1
    assert comments.read_comments(spark, path).select("id").count() == 3
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        comments.read_strict(spark, path).collect()
    with pytest.raises(FileNotFoundError):
        comments.read_required(spark, str(tmp_path / "none.csv"), ["id"])
    with pytest.raises(ValueError, match="nope"):
        comments.read_required(spark, path, ["id", "nope"])


def test_tolerant_csv_goes_by_header(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("toxic,comment_text,other\n1,well met,z\n0,three,,\nx,four,\n0,\"a, \"\"b\"\", c\"\n")
    rows = comments.read_comments(spark, str(path), unparsed="bad").collect()
    assert [(r["comment_text"], r["toxic"], r["id"], r["insult"], r["bad"]) for r in rows] == [
        ("well met", 1, None, None, []), ("four", None, None, None, ["toxic"]), ('a, "b", c', 0, None, None, []),
    ]
    assert comments.read_comments(spark, str(path), multi_line=False).count() == 3


def test_files_with_different_headers(spark, tmp_path):
    folder = tmp_path / "with space"
    folder.mkdir()
    (folder / "a.csv").write_text("id,comment_text,toxic\n1,first,1\n")
    (folder / "b.csv").write_text("toxic,id,comment_text\n0,2,second\n1,3,\"two\nlines\"\n0,4,x,extra\n")
    (folder / "c.csv").write_text("id,comment_text,toxic\r\n5,fifth,0\r\n")
    (folder / "d.csv").write_text("comment_text\nsixth\n")
    rows = comments.read_comments(spark, str(folder)).collect()
    assert sorted((r["comment_text"], r["id"], r["toxic"]) for r in rows) == sorted([
        ("fifth", "5", 0), ("first", "1", 1), ("second", "2", 0), ("sixth", None, None), ("two\nlines", "3", 1),
    ], key=lambda r: r[0])
    alike = tmp_path / "alike"
    alike.mkdir()
    for n in (1, 2):
        (alike / f"{n}.csv").write_text(f"id,comment_text\n{n},text\n")
    for same in (True, False):
        assert {r["id"] for r in comments.read_comments(spark, str(alike), same_header=same).collect()} == {"1", "2"}


def test_strict_csv_that_spark_can_split(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("id,comment_text," + ",".join(lexicon.LABELS) + "\n" + "".join(f"{i},text {i},0,0,0,0,0,1\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        one, split = (comments.read_strict(spark, str(path), multi_line=m) for m in (True, False))
        assert one.rdd.getNumPartitions() == 1 < split.rdd.getNumPartitions()
        assert sorted(one.collect()) == sorted(split.collect()) and split.count() == 2000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "b"\nc', *[0] * 6)], comments.COMMENT_SCHEMA)
    comments.write_csv(df, str(tmp_path / "csv"))
    assert comments.read_strict(spark, str(tmp_path / "csv")).collect() == df.collect()
    vectors = spark.createDataFrame([(1, [0.5, 0.25])], "id int, embedding array<float>")
    comments.write_embeddings(vectors, str(tmp_path / "emb"), "id")
    assert spark.read.parquet(str(tmp_path / "emb")).collect() == vectors.collect()


def test_results(spark, tmp_path):
    scores = spark.createDataFrame(
        [(i, m, l, i % 2, i / 10) for i in range(8) for m in ("a", "b") for l in ("toxic", "insult")],
        "id int, model string, label string, y int, p double")
    record = resilience.metric_record(scores, nested=True)
    results.write_results(record, str(tmp_path / "r"))
    back = results.read_results(spark, str(tmp_path / "r"))
    key = lambda df: sorted(tuple(r) for r in results.flatten_nested(df).collect())
    assert key(back) == key(record) and len(key(back)) == 2 * (4 + 2 * 9)
    results.write_results(record.filter("model = 'a'"), str(tmp_path / "r"))
    assert {r["model"] for r in results.read_results(spark, str(tmp_path / "r")).collect()} == {"a", "b"}
    flat = tmp_path / "flat.json"
    flat.write_text(json.dumps({"eval_severe_toxic_f1": 0.5, "eval_f1_macro": 0.25, "epoch": 2.0}))
    got = {tuple(r) for r in results.read_flat_document(spark, str(flat), "m").collect()}
    assert got == {("m", "severe_toxic", "f1", 0.5), ("m", "overall", "f1_macro", 0.25)}


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, f"A stupid comment about woman number {i} and many other things") for i in range(20)], "doc_id int, text string")
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    df.write.parquet(src)
    q = stream.write_prepared(stream.prepare(stream.read_comment_stream(spark, src, df.schema)), out, ckpt).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, stream.prepare(df).collect()))


def test_encoder_rows_do_not_depend_on_batches(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "", "日本", "x " * 1000])], "id int, clean string")
    length = lambda texts: np.array([[len(t), t.count(" ")] for t in texts])
    for batch in (1, 3, 32):
        whole = models.embed(df, encoder=length, batch=batch)
        assert [r["features"] for r in whole.orderBy("id").collect()] == [[3, 1], [0, 0], [2, 0], [1999, 999]]
        cut = models.embed(df, encoder=length, batch=batch, max_tokens=128)
        assert [r["features"] for r in cut.orderBy("id").collect()] == [[3, 1], [0, 0], [2, 0], [255, 127]]


def test_embedding_sees_every_word(spark):
    df = spark.createDataFrame([(1, "a " * 500), (2, "a " * 500 + "b " * 500)], "id int, clean string")
    one, two = [r["features"] for r in models.embed(df, dim=64).orderBy("id").collect()]
    assert max(one) == 1 and sorted(two)[-2:] == [0.5, 0.5]


def test_models_round_trip(spark, tmp_path):
    rows = [(i, [float(i % 2), float(i % 3)], i % 2, int(i % 3 == 0)) for i in range(60)]
    df = models.as_features(spark.createDataFrame(rows, "id int, features array<float>, toxic int, insult int"), "features")
    fitted = models.fit_multilabel(df, ["toxic", "insult"], params={"maxIter": 2, "maxDepth": 2})
    models.save_models(fitted, str(tmp_path / "m"))
    loaded = models.load_models(str(tmp_path / "m"), ["toxic", "insult"])
    a, b = (sorted(map(tuple, models.predict_long(m, df, "id", "t").collect())) for m in (fitted, loaded))
    assert a == b and len(a) == 120
    assert models.MacroF1Evaluator().evaluate(models.predict_long(fitted, df, "id", "t")) == pytest.approx(1.0)


def test_text_model_cleans_every_text_once(spark, monkeypatch):
    """Fits and scores of a query read written terms; and those score as the texts do."""
    read, rows = spark.sparkContext.accumulator(0), learning.labelled(spark, SMOKE_DIR)

    @F.udf("string")
    def seen(t):
        read.add(1)
        return t

    monkeypatch.setattr(learning, "labelled", lambda *_: rows.withColumn("text", seen.asNondeterministic()("text")))
    got = {r["id"]: r["p"] for r in learning.lr_scores(spark, SMOKE_DIR).filter("label = 'toxic'").collect()}
    assert read.value == len(got) == rows.count()
    clean = cleaning.clean_basic(rows)
    fitted = models.fit_weighted_linear(clean, ["toxic"])
    texts = models.predict_long(fitted, clean, "doc_id", "linear", text_col="clean")
    assert {r["id"]: r["p"] for r in texts.collect()} == pytest.approx(got)


def test_drawn_settings_stay_in_range():
    drawn = models.draw_params(n_iter=100)
    assert len(drawn) == 100 and drawn == models.draw_params(n_iter=100)
    assert all(3 <= s["maxDepth"] <= 10 and 0.01 <= s["stepSize"] <= 0.3 and 100 <= s["maxIter"] <= 500 for s in drawn)


def test_cut_lineage_uses_the_session_folder(spark):
    df = cut_lineage(spark.range(5).withColumn("x", F.col("id") * 2))
    assert "RDD" in df._jdf.queryExecution().optimizedPlan().toString() and df.count() == 5
    assert spark.sparkContext.getCheckpointDir()


def test_obfuscation_flags(spark):
    rows = {"n0th1ng g00d": "leet", "s t u p i d": "spaced", "heyyyy": "repeated", "a​b": "zero_width",
            "Yоu": "mixed_script", "sTuPid": "mid_case", "s.t.u.p": "joined", "a plain text": None}
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    for r in tagging.obfuscation_flags(df).collect():
        want = rows[r["text"]]
        assert r["is_obfuscated"] == int(want is not None) and (want is None or r[want] == 1)
