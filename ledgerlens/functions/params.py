"""Defaults of the engine, in one place. Values that results depend on are fixed."""

from __future__ import annotations

WINDOW_DAYS = 30
EXPIRE_AFTER_DAYS = 90
DISCARD_RETENTION_DAYS = 60
TRUST_THRESHOLD = 20
DISCARD_THRESHOLD = -20
LABEL_DAYS = 7
REJECTION_DAYS = 30
FAILURE_STREAK = 2
DOUBT_THRESHOLD = 2
LTR_MIN_QUERIES = 500

# Weight of each kind of signal, by its name: (polarity, source, weight).
SIGNALS = {
    "human-confirm": ("positive", "human", 5.0),
    "evidence-pass": ("positive", "evidence", 3.0),
    "implicit-use": ("positive", "implicit", 1.0),
    "user-reject": ("negative", "human", -6.0),
    "evidence-fail": ("negative", "evidence", -3.0),
}

K1, B = 1.2, 0.75
FIELD_WEIGHTS = {"title": 3.0, "tag": 2.0, "text": 1.0}
STATUS_FACTOR = {"trusted": 1.0, "candidate": 0.85, "expired": 0.5}
TIER_FACTOR = {"project": 1.0, "global": 0.8}
REVIEW_FACTOR = 0.7

RRF_K = 60
RECALL_DEPTH = 50
RERANK_CANDIDATES = 30
RESULT_LIMIT = 5
SEMANTIC_FLOOR, SEMANTIC_CEIL = 0.3, 0.8
FRESHNESS_HALF_LIFE_DAYS = 30
BINDING_BOOST = 1.5

# What each rerank feature adds to the score.
FEATURE_WEIGHTS = {
    "bm25ish": 1.0,
    "exactPhrase": 0.6,
    "semantic": 0.8,
    "specificity": 0.5,
    "bindingOverlap": 0.5,
    "redlineRatio": -0.3,
    "freshness": 0.2,
    "signalScore": 0.3,
    "docMountBonus": 0.15,
    "semanticRank": 0.0,
    "fusedRank": 0.0,
    "semanticAbsent": 0.0,
}
LTR_FEATURES = ["bm25ish", "exactPhrase", "semantic", "specificity", "bindingOverlap", "redlineRatio", "freshness", "signalScore", "docMountBonus"]

CHUNK_CHARS, WINDOW_STEP, ANCHOR_CHARS = 800, 600, 40
CHUNKER_VERSION = "struct-800-w800s600-v1"
REDLINE_PROPOSAL_RATIO = 0.4
EMBED_DIM = 256

STATUSES = ["candidate", "trusted", "expired", "discarded", "superseded"]
TRIGGERS = ["approve-promote", "expire-idle", "human-retire", "strong-negative", "split", "reactivate", "rescue"]
# Legal state changes (from, to, trigger).
EDGES = [
    ("candidate", "trusted", "approve-promote"),
    ("candidate", "expired", "expire-idle"),
    ("candidate", "expired", "human-retire"),
    ("candidate", "discarded", "strong-negative"),
    ("candidate", "superseded", "split"),
    ("trusted", "expired", "expire-idle"),
    ("trusted", "expired", "human-retire"),
    ("trusted", "discarded", "strong-negative"),
    ("trusted", "superseded", "split"),
    ("expired", "candidate", "reactivate"),
    ("expired", "discarded", "expire-idle"),
    ("expired", "discarded", "strong-negative"),
    ("expired", "superseded", "split"),
    ("discarded", "candidate", "rescue"),
]

# Fixed values: (longest query, strip code, take identifiers out of the embedded text).
PROFILES = {"tool": (0, False, False), "pre-step": (1200, True, False), "gate": (0, False, True)}

# Fixed values, as equal results need them: a word is an identifier if one of these patterns matches it.
IDENTIFIER_PATTERNS = [
    r"[/\\]",
    r"^[\w.-]+\.[A-Za-z][A-Za-z0-9]{0,5}$",
    r"^[A-Za-z][\w]*(?:[-_][\w]+)+$",
    r"^[A-Z][A-Z0-9_]{2,}$",
    r"^v?\d+(?:\.\d+)+$",
    r"^[A-Z]?\d{3,}$",
    r"^[a-z]+[A-Z][A-Za-z0-9]*$",
]
# Signs that do not belong to a word before it and behind it.
LEADING_SIGNS, TRAILING_SIGNS = r"^[`'\"\[({<]+", r"[`'\"\[)\]}>.,;:!?]+$"
# Pieces of an identifier by case, and where letters and digits meet.
IDENTIFIER_PIECE = "[A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+"
LETTER_DIGIT = "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"

# How tags of a page become text. Those without readable content go with all that they hold.
SKIPPED_TAGS = ["script", "style", "noscript", "template", "svg"]
OPENING_TAGS = {**{f"h{n}": "\n\n" + "#" * n + " " for n in range(1, 7)}, "li": "\n- "}
CLOSING_TAGS = {**{f"h{n}": "\n" for n in range(1, 7)}, "li": "", "td": " | ", "th": " | "}
BLOCK_TAGS = "p div section article header footer main aside nav tr table thead tbody blockquote figure figcaption pre ul ol dl dt dd form fieldset h[1-6] li br hr".split()
# Entities, of which the ampersand comes last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;|&apos;": "'", "&amp;": "&"}
