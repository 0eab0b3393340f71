"""Text functions: examples and edge cases."""

import unicodedata
from functools import partial
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from modengine.functions import lexicon, tags, text as tx
from modengine.functions.unicode import ascii_fold, nfkc_chars
from modengine.operators import attacks, cleaning, models, tagging

TEXTS = [
    "", "   ", "Hello World!", "\nNew\nLines\n", "Tab\tTab\x0bv\x1cs nbsp　", "soooo cooool!!! ??.. ....",
    "a<b\nc>d <i>x</i> <>", "see https://x.y/z?a=1 and www.a.b httpfoo wwwbar", "a@b @c d@ me@x.y,z @@b x@@", "#tag @me_1 @é",
    "&amp; &é; &;", "it's can't won't they've I'm he'd we'll don't", "½ é ß ﬁ Ａ ① İstanbul ñ", "日本語 текст ١٢٣ x² _a_",
    "aaabbbb  cccc\n\n\n😀😀😀", "é combining", "1,234.5", "x" * 300 + "@" + "y" * 5, None,
]


# step: (function, [(text, expected), ...]), the expected texts written by hand
STEPS = {
    "html": (tx.strip_html, [("a<b\nc>d <i>x</i> <>", "a<b\nc>d  x   "), ("1 < 2", "1 < 2")]),
    "urls": (tx.strip_urls, [("see https://x.y/z?a=1 and www.a.b httpfoo wwwbar", "see   and   httpfoo wwwbar")]),
    "urls_c": (lambda c: tx.strip_urls(c, "contractions"), [("see https://x.y and www.a.b httpfoo wwwbar", "see  and   ")]),
    "emails": (tx.strip_emails, [("a@b @c d@ me@x.y,z @@b x@@", "  @c d@      "), ("x" * 300 + "@yyyyy", " ")]),
    "handles": (tx.strip_handles, [("#tag @me_1 @é @-", "      @-")]),
    "entities": (tx.strip_entities, [("&amp; &é; &;", "    &;")]),
    "punct": (tx.strip_punct, [("it's ½! _a_ x²", "it's ½  _a_ x²")]),
    "punct_b": (lambda c: tx.strip_punct(c, "basic"), [("it's\nx_1!", "it s x_1 ")]),
    "digits": (tx.strip_digits, [("١٢٣ x² 1,234.5", "  x²  , . ")]),
    "repeats": (tx.collapse_repeats, [("aaabbbb  cccc\n\n\n😀😀😀", "aabb  cc\n\n\n😀😀")]),
    "squeeze": (tx.squeeze_ws, [("\tTab\x0bv\x1cs nbsp\u3000 ", "Tab v s nbsp"), ("   ", "")]),
    "fold": (ascii_fold, [("½ é ß ﬁ Ａ ① İ ñ 日本", "12 e  fi A 1 I n ")]),
    "count": (tx.n_tokens, [("", 0), (" a\tb\u2003c ", 3)]),
    "nfkc_chars": (nfkc_chars, [("ﬁ Ａ\n① ½ e\u0301", "fi A\n1 1\u20442 e\u0301")]),
}


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").cache()


@pytest.mark.parametrize("name", sorted(STEPS))
def test_steps(spark, frame, name):
    fn, cases = STEPS[name]
    df = spark.createDataFrame([(t,) for t, _ in cases], "text string")
    assert [r["out"] for r in df.select(fn(F.col("text")).alias("out")).collect()] == [e for _, e in cases]
    assert frame.select(fn(F.col("text"))).count() == len(TEXTS)


def test_nfkc_of_every_character(spark):
    changed = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x30000)]) if unicodedata.normalize("NFKC", c) != c]
    df = spark.createDataFrame([(f"x{c}y",) for c in changed], "text string")
    got = df.select(nfkc_chars(F.col("text"))).collect()
    assert [r[0] for r in got] == [f"x{unicodedata.normalize('NFKC', c)}y" for c in changed]


def test_fold_of_every_character_without_a_table(spark):
    chars = [c for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x30000)]) if unicodedata.decomposition(c)]
    df = spark.createDataFrame([(f"x{c}y\u0301",) for c in chars], "text string").select(ascii_fold(F.col("text")))
    assert [r[0] for r in df.collect()] == ["".join(x for x in unicodedata.normalize("NFKD", f"x{c}y") if x < "\x80") for c in chars]
    assert "translate(" not in df._jdf.queryExecution().optimizedPlan().toString()


LEMMAS = """
houses house, cases case, sizes size, courses course, nurses nurse, purposes purpose, responses response, bias bias, canvas canvas,
policemen policeman, firemen fireman, women woman, men man, specimen specimen, omen omen, dogs dog, cats cat, ideas idea,
boxes box, taxes tax, glasses glass, classes class, churches church, wishes wish, buzzes buzz, quizzes quiz, cities city,
babies baby, days day, keys key, buses bus, gases gas, status status, basis basis, class class, news news, is is, his his,
photos photo, videos video, heroes hero, shoes shoe, leaves leaf, children child, mice mouse, games game, roses rose,
noises noise, prizes prize, mazes maze, phrases phrase, bases base, causes cause, senses sense, horses horse, films film,
headaches headache, crises crisis, atlas atlas, chaos chaos, movies movie, cookies cookie, abdomen abdomen, gentlemen gentleman
"""


def test_lemmas(spark):
    pairs = [p.split() for p in LEMMAS.strip().replace("\n", " ").split(",")]
    df = spark.createDataFrame(pairs, "word string, want string")
    assert df.filter(tx.lemma(F.col("word")) != F.col("want")).collect() == [] and len(pairs) > 60


@pytest.mark.parametrize("raw, clean", [
    ("Green Apples?", "green apple"), ("LOUD", "loud"), ("wide \t open  doors", "wide open door"), ("~+(odd)=", "odd"),
    ("%^*+", ""), ("7 lamps 88", "lamp"), ("", ""), (" \t ", ""), ("\nred\nboats\n", "red boat"), (None, ""),
    ("Mail me@x.org <b>now</b> &amp; see http://a.b soooon", "mail see soon"),
    ("The women weren't at Cafés in 1999", "woman cafe"),
])
def test_clean_thorough(spark, raw, clean):
    df = spark.createDataFrame([(raw,)], "text string")
    assert cleaning.clean_thorough(df).first()["clean"] == clean


def test_other_cleaners(spark):
    df = spark.createDataFrame([("It's GREAT!!! won't 2 @x http://a.b <b>..</b> é",)], "text string")
    assert cleaning.clean_contractions(df).first()["clean"] == "it is great! will not 2 ."
    assert cleaning.clean_basic(df).first()["clean"] == "great 2 x http b b b é"
    assert df.select(tx.clean_light(F.col("text"))).first()[0].startswith("it's great!!!")


def test_filter_does_not_repeat_the_cleaning(spark):
    df = tagging.min_tokens(cleaning.clean_thorough(spark.range(3).selectExpr("string(id) as text")), 5)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("https?://") == 1


def test_lemma_table(spark):
    df = spark.createDataFrame([(1, "two mice ran"), (2, ""), (3, "mice mice")], "id int, clean string")
    lemmas = spark.createDataFrame([("mice", "mouse"), ("ran", "run")], "word string, lemma string")
    lemmas = lemmas.union(lemmas)
    out = cleaning.lemmatize_with_table(df, "id", "clean", lemmas, "out").orderBy("id").collect()
    assert [r["out"] for r in out] == ["two mouse run", "", "mouse mouse"]


def test_lemmas_by_vocabulary(spark):
    """The longest result that is a word wins; without one the word stays."""
    pairs = """dies die, analyses analysis, theses thesis, indices index, matrices matrix, vetoes veto, physics physics,
    politics politics, mathematics mathematics, does does, goes goes, wives wife, leaves leaf, cookies cookie, cities city, boxes box,
    buses bus, quizzes quiz, women woman, children child, bacteria bacterium, criteria criterion, cacti cactus, larvae larva, unknowns unknowns,
    houses house, is is, class class, news news, s s""".replace("\n", " ").split(",")
    want = dict(p.split() for p in pairs)
    known = """die dy analysis analyse thesis these index matrix veto physics politics mathematics wife leaf cookie city box bus quiz
    woman bacterium criterion cactus larva house class news""".split()
    df = spark.createDataFrame([(1, " ".join(want)), (2, ""), (3, "dies dies")], "id int, clean string")
    vocabulary = spark.createDataFrame([(w,) for w in known * 2], "word string")
    out = {r["id"]: r["out"] for r in cleaning.lemmatize_by_vocabulary(df, "id", "clean", vocabulary, "out").collect()}
    assert dict(zip(want, out[1].split())) == want and out[2] == "" and out[3] == "die die"


def test_lemmas_by_vocabulary_read_every_text_twice(spark):
    """Once for its words and once to replace them, whatever is done with the words."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(t):
        read.add(1)
        return t

    texts = [(i, f"cats and {'women' if i % 2 else 'boxes'} x{i}s") for i in range(50)]
    df = spark.createDataFrame(texts, "id int, text string").select("id", seen.asNondeterministic()("text").alias("clean"))
    vocabulary = spark.createDataFrame([("cat",), ("woman",), ("box",)], "word string")
    out = {r["id"]: r["out"] for r in cleaning.lemmatize_by_vocabulary(df, "id", "clean", vocabulary, "out").collect()}
    assert out == {i: f"cat and {'woman' if i % 2 else 'box'} x{i}s" for i, _ in texts}
    assert read.value <= 2 * len(texts)


@pytest.mark.parametrize("rules", [[("s", ""), ("es", ""), ("men", "man"), (".", "")], [("ies", "y")]])
def test_only_words_with_an_ending_are_looked_up(spark, rules):
    words = ["s", "es", "cats", "men", "women", "y", "end.", "feet", "ties", "ie", ""]
    could = cleaning.detachable({"feet": "foot"}, rules)
    df = spark.createDataFrame([(w,) for w in words], "w string")
    want = {w for w in words if w == "feet" or any(w.endswith(s) for s, _ in rules)}
    assert {r["w"] for r in df.filter(could(F.col("w"))).collect()} == want


def test_lookup_is_even_on_a_skewed_corpus(spark):
    """A word of every text spreads over the salts, and the result is the literal map's."""
    rows = [(i, " ".join(["cats", f"w{i % 50}s", f"x{i}"])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, clean string")
    table = {"cats": "cat"} | {f"w{i}s": f"w{i}" for i in range(50)}
    lemmas = spark.createDataFrame(list(table.items()), "word string, lemma string")
    out = cleaning.replace_words(df, "id", "clean", lemmas, "out", salts=32)
    assert {r["id"]: r["out"] for r in out.collect()} == {i: " ".join(table.get(w, w) for w in t.split()) for i, t in rows}
    sent = df.select(F.explode(F.split("clean", " ")).alias("word"), F.pmod(F.xxhash64("id"), F.lit(32)).alias("salt")).groupBy("word", "salt").count()
    assert sent.agg(F.max("count")).first()[0] < 2000 / 32 * 2


@pytest.mark.parametrize("value, substring, word", [
    ("She met one woman there", 1, 1), ("rain all day", 0, 0), ("", 0, 0), ("THE MAN LEFT", 1, 1),
    ("womann", 1, 0), ("human", 1, 0), (None, 0, 0),
])
def test_identity(spark, value, substring, word):
    df = spark.createDataFrame([(value,)], "text string")
    c = F.col("text")
    assert df.select(tags.has_identity(c), tags.has_identity(c, "word")).first() == (substring, word)


def test_weak_labels(spark):
    rows = {
        "You are stupid": "toxic insult", "I hope it fails painfully": "toxic severe_toxic",
        "what the sh*t": "toxic obscene", "kill the lights": "toxic severe_toxic threat",
        "I will find you": "toxic severe_toxic threat", "all [GROUP] should go": "toxic identity_hate",
        "[group] is here": "", "nice day": "",
    }
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    got = {r["text"]: " ".join(l for l in tagging.LABELS if r[l]) for r in tagging.weak_labels(df).collect()}
    order = lambda s: sorted(s.split())
    assert {k: order(v) for k, v in got.items()} == {k: order(v) for k, v in rows.items()}


def test_guards_and_stats(spark):
    df = spark.createDataFrame([("a b", "a"), ("c d", "")], "text string, clean string")
    assert tagging.cleaning_effectiveness(df).first()["reduction_pct"] == 75.0
    assert tagging.cleaning_effectiveness(df.limit(0)).first()["reduction_pct"] == 0.0
    assert tagging.drop_empty(df).count() == 1
    with pytest.raises(ValueError, match="at least 3"):
        tagging.require_rows(df, 3)
    with pytest.raises(ValueError, match="threat"):
        tagging.require_columns(df, ["text", "threat"])


def test_thorough_cleaner_is_its_steps_in_one_call(spark):
    """The same as step by step, also on attacked texts, and no regex in the JVM."""
    every = "".join(map(chr, range(128)))
    said = [*TEXTS, every, every * 3, "".join(c * 4 for c in every), "℡ K İx the classes of women's wives, buses a's news aaas menmen 12men",
            "http://a@b.c&amp;www.x y@z.c#t <a href=''>@<b> &a_1;b;c x\x1cy\x85z", "é" * 5 + "e" * 4, "it ''" + "'' ____ s_s"]
    df = attacks.obfuscation_variants(spark.createDataFrame(list(enumerate(said)), "id int, t string"), "t", "id").localCheckpoint()
    steps = [tx.text_or_empty, tx.lower_text, ascii_fold, tx.strip_html, tx.strip_urls, tx.strip_emails, tx.strip_handles,
             tx.strip_entities, tx.strip_punct, tx.strip_digits, tx.collapse_repeats, tx.squeeze_ws]
    of = lambda out: {(r["id"], r["pattern"]): r["clean"] for r in out.collect()}
    for words, exceptions in ((tuple(lexicon.STOP_WORDS), None), ((), {}), (("a",), {"news": "new", "x": ""})):
        got = cleaning.clean_thorough(df, "attacked", "clean", words, exceptions)
        last = partial(tx.drop_and_lemmatize, words=words, exceptions=exceptions)
        assert of(got) == of(cleaning.through(df, "attacked", "clean", [*steps, last]))
    assert "regexp_replace" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_hashed_means_find_a_words_axis_once(spark):
    """Means by the md5 of every word, without a digest per word in the JVM."""
    said = ["", None, "a", "  b　a b\x1c", "wort über ß 日本 wort", " ".join(map(str, range(300)))]
    out = models.embed(spark.createDataFrame(list(enumerate(said)), "id int, t string"), "t", dim=16)
    assert "md5" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.collect():
        words = (r["t"] or "").split()
        axes = [int(md5(w.encode()).hexdigest()[:8], 16) % 16 for w in words]
        assert r["features"] == pytest.approx([axes.count(i) / max(len(words), 1) for i in range(16)], abs=1e-7)
