"""Word lists and constants.

Values marked FIXED decide results and are stated as they must be; every
operator that reads one also takes its own list as a parameter.
"""

from __future__ import annotations

# FIXED: the six labels, in canonical order.
LABELS = ["toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate"]

# FIXED: the labels that are oversampled, in this sequence.
RARE_LABELS = ["threat", "identity_hate", "severe_toxic"]

# FIXED: identity terms, matched as substrings of the lowered text.
IDENTITY_TERMS = [
    "muslim", "christian", "jewish", "black", "white", "asian",
    "latino", "gay", "lesbian", "trans", "female", "male",
    "woman", "man", "nonbinary", "disabled",
]

# FIXED: keyword groups behind the weak labels; each group sets several labels.
INSULT_WORDS = ["stupid", "worthless", "idiot"]
DEATH_WORDS = ["die", "cancer", "painfully"]
OBSCENE_WORDS = ["fuck", "shit", "f*ck", "sh*t"]
THREAT_WORD = "kill"
THREAT_PAIR = ("find", "you")
GROUP_MARK = "[group]"
GROUP_WORDS = ["eliminate", "die", "should"]

# FIXED: synonym lists of the word-substitution attack.
SYNONYMS = {
    "hate": ["despise", "loathe", "detest"],
    "kill": ["murder", "eliminate", "destroy"],
    "stupid": ["idiotic", "foolish", "dumb"],
    "fuck": ["screw", "damn", "hell"],
    "shit": ["crap", "garbage", "trash"],
    "die": ["perish", "expire", "succumb"],
    "cancer": ["disease", "illness", "malady"],
}

# FIXED: contraction rewrites, applied in this order.
CONTRACTIONS = [
    ("won't", "will not"),
    ("can't", "cannot"),
    ("n't", " not"),
    ("'re", " are"),
    ("'s", " is"),
    ("'d", " would"),
    ("'ll", " will"),
    ("'t", " not"),
    ("'ve", " have"),
    ("'m", " am"),
]

# FIXED: character substitutions of the leetspeak attack.
LEET = {
    "a": ["4", "@"],
    "e": ["3"],
    "i": ["1", "!"],
    "o": ["0"],
    "s": ["5", "$"],
    "t": ["7"],
}
# FIXED: symbols of the special-character and emoji attacks; zero-width space.
SPECIAL_CHARS = ["*", "#", "@", "$", "%"]
EMOJI = ["😡", "🤬", "💩", "👎", "🤢"]
ZERO_WIDTH = "\u200b"

# FIXED: attack names, in canonical order.
PATTERNS = [
    "leetspeak", "space_injection", "char_repetition", "special_chars",
    "case_variation", "unicode", "word_substitution", "character_swapping",
    "emoji_injection", "zero_width",
]

# FIXED: declared per-label thresholds.
DEFAULT_THRESHOLDS = {
    "toxic": 0.5, "severe_toxic": 0.6, "obscene": 0.5,
    "threat": 0.55, "insult": 0.45, "identity_hate": 0.5,
}
# FIXED: blended-threshold weights, per-label factors, clip range, and the
# threshold of a label that has one class only.
F1_WEIGHT, YOUDEN_WEIGHT = 0.7, 0.3
THRESHOLD_FACTORS = {"toxic": 0.9, "severe_toxic": 1.1, "threat": 1.15}
THRESHOLD_RANGE = (0.1, 0.9)
SINGLE_CLASS_THRESHOLD = 0.5
# FIXED: guard against 0/0 in the F1 of a precision-recall curve.
F1_EPSILON = 1e-8

# FIXED: the usual English stop-word list of 179 words.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how
all any both each few more most other some such no nor not only own same so
than too very s t can will just don don't should should've now d ll m o re ve
y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't
shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn
wouldn't
""".split()

# Noun forms the plural rules of ``text.lemma`` would get wrong. A stand-in for
# a full dictionary: pass your own mapping or lemma table for more.
LEMMA_EXCEPTIONS = {
    "men": "man", "women": "woman", "children": "child", "feet": "foot",
    "teeth": "tooth", "geese": "goose", "mice": "mouse", "wives": "wife",
    "lives": "life", "knives": "knife", "leaves": "leaf", "wolves": "wolf",
    "halves": "half", "selves": "self", "thieves": "thief", "loaves": "loaf",
    "calves": "calf", "shelves": "shelf", "oxen": "ox", "criteria": "criterion",
    "phenomena": "phenomenon", "movies": "movie", "cookies": "cookie",
    "shoes": "shoe", "ties": "tie", "pies": "pie", "lies": "lie",
    "buses": "bus", "gases": "gas",
    "news": "news", "series": "series", "species": "species",
    "always": "always", "perhaps": "perhaps", "sometimes": "sometimes",
    "lens": "lens", "gas": "gas", "yes": "yes", "las": "las", "los": "los",
    "bias": "bias", "canvas": "canvas", "atlas": "atlas", "alias": "alias",
    "christmas": "christmas", "chaos": "chaos", "cosmos": "cosmos", "ethos": "ethos",
    "specimen": "specimen", "abdomen": "abdomen", "acumen": "acumen", "regimen": "regimen",
    "heroes": "hero", "potatoes": "potato", "tomatoes": "tomato", "echoes": "echo",
    "aches": "ache", "headaches": "headache", "caches": "cache", "quizzes": "quiz",
    "crises": "crisis", "axes": "axe",
}

# Suffixes of English plurals and what stands for them in the singular; a
# vocabulary decides which result is a word.
DETACHMENTS = [
    ("s", ""), ("es", ""), ("ies", "y"), ("ies", "ie"), ("ves", "f"), ("ves", "fe"), ("men", "man"), ("es", "is"),
    ("ses", "s"), ("zes", ""), ("zzes", "z"), ("ices", "ex"), ("ices", "ix"), ("i", "us"), ("a", "um"), ("a", "on"), ("ae", "a"),
]
# Plurals that no suffix tells.
LEMMA_IRREGULAR = {
    "children": "child", "feet": "foot", "teeth": "tooth", "geese": "goose", "mice": "mouse", "lice": "louse",
    "oxen": "ox", "people": "person",
}
