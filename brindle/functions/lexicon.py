"""The review lexicon and its term tables."""

from __future__ import annotations

# Term, normalised term, type, aspect, prior, intensity, confidence
LEXICON = [
    ("mast", "excellent", "sentiment", None, "positive", 0.86, 0.9),
    ("zabardast", "excellent", "sentiment", None, "positive", 0.92, 0.9),
    ("paisa vasool", "value for money", "sentiment", "value", "positive", 0.9, 0.92),
    ("bekar", "bad", "sentiment", None, "negative", 0.86, 0.9),
    ("bakwas", "terrible", "sentiment", None, "negative", 0.93, 0.92),
    ("faltu", "useless", "sentiment", None, "negative", 0.88, 0.88),
    ("theek hai", "okay", "sentiment", None, "neutral", 0.5, 0.82),
    ("camera", "camera", "aspect", "camera", None, None, 0.95),
    ("camra", "camera", "spelling_variant", "camera", None, None, 0.86),
    ("kamera", "camera", "spelling_variant", "camera", None, None, 0.84),
    ("battery", "battery", "aspect", "battery", None, None, 0.95),
    ("baatri", "battery", "spelling_variant", "battery", None, None, 0.82),
    ("battri", "battery", "spelling_variant", "battery", None, None, 0.82),
    ("backup", "battery backup", "aspect", "battery", None, None, 0.9),
    ("heating", "heating", "aspect", "heating", None, None, 0.95),
    ("garam", "heating", "aspect", "heating", "negative", 0.78, 0.9),
    ("display", "display", "aspect", "display", None, None, 0.95),
    ("performance", "performance", "aspect", "performance", None, None, 0.95),
    ("lag", "lag", "aspect", "performance", "negative", 0.78, 0.88),
    ("charging", "charging", "aspect", "charging", None, None, 0.95),
    ("delivery", "delivery", "delivery_service", None, None, None, 0.95),
    ("packaging", "packaging", "delivery_service", None, None, None, 0.95),
    ("seller", "seller", "delivery_service", None, None, None, 0.95),
    ("return", "return", "delivery_service", None, None, None, 0.9),
    ("refund", "refund", "delivery_service", None, None, None, 0.9),
    ("wah wah", "sarcasm marker", "sarcasm_marker", None, None, None, 0.7),
    ("kya kehna", "sarcasm marker", "sarcasm_marker", None, None, None, 0.7),
]

# Of each aspect (term, prior, confidence)
MORE_ASPECT_TERMS = {
    "heating": [("heating", "negative", 0.94), ("heat", "negative", 0.9), ("hot", "negative", 0.86), ("garam", "negative", 0.92), ("tawa", "negative", 0.9), ("overheat", "negative", 0.94), ("thermal", "negative", 0.82)],
    "software": [("software", None, 0.92), ("ui", None, 0.88), ("bug", "negative", 0.9), ("bugs", "negative", 0.9), ("bloatware", "negative", 0.88), ("update", None, 0.82), ("ads", "negative", 0.82)],
    "performance": [("performance", None, 0.94), ("smooth", "positive", 0.88), ("fast open", "positive", 0.86), ("apps fast", "positive", 0.86), ("multitasking", None, 0.84), ("gaming", None, 0.82), ("speed", None, 0.8), ("processor", None, 0.82)],
    "audio": [("speaker", None, 0.92), ("sound", None, 0.86), ("audio", None, 0.9), ("volume", None, 0.84), ("mic", None, 0.84), ("microphone", None, 0.88), ("call quality", None, 0.9), ("loud", "positive", 0.84)],
    "connectivity": [("network", None, 0.92), ("internet", None, 0.84), ("wifi", None, 0.84), ("wi-fi", None, 0.84), ("bluetooth", None, 0.82), ("5g", None, 0.82), ("signal", None, 0.86), ("call drop", "negative", 0.9), ("drop", "negative", 0.78)],
    "design": [("design", None, 0.9), ("premium", "positive", 0.86), ("feel", None, 0.76), ("grip", None, 0.78), ("weight", None, 0.76), ("back panel", None, 0.82), ("build", None, 0.82)],
    "display": [("display", None, 0.94), ("screen", None, 0.9), ("brightness", None, 0.86), ("bright", "positive", 0.84), ("outdoor", None, 0.76), ("touch", None, 0.82)],
}

# Sentiment words with intensity and confidence
NEGATIVE_WORDS = [("terrible", 0.9, 0.86), ("bakwas", 0.93, 0.92), ("bekar", 0.86, 0.9), ("bad", 0.78, 0.76), ("poor", 0.78, 0.76), ("worst", 0.92, 0.86), ("slow", 0.74, 0.72), ("drain", 0.8, 0.76), ("problem", 0.72, 0.68), ("issue", 0.72, 0.68), ("hot", 0.78, 0.72), ("heat", 0.82, 0.78), ("heating", 0.86, 0.84), ("garam", 0.82, 0.82), ("tawa", 0.86, 0.8), ("lag", 0.76, 0.72), ("bug", 0.78, 0.76), ("bugs", 0.78, 0.76), ("unstable", 0.78, 0.74), ("drop", 0.76, 0.72), ("not good", 0.82, 0.8)]
POSITIVE_WORDS = [("excellent", 0.86, 0.9), ("zabardast", 0.92, 0.9), ("mast", 0.86, 0.9), ("good", 0.72, 0.72), ("best", 0.78, 0.76), ("nice", 0.68, 0.68), ("great", 0.78, 0.74), ("love", 0.82, 0.72), ("super", 0.78, 0.72), ("bright", 0.72, 0.72), ("clearly", 0.68, 0.68), ("clear", 0.72, 0.74), ("smooth", 0.78, 0.76), ("fast", 0.74, 0.72), ("premium", 0.76, 0.74), ("acha", 0.72, 0.72), ("achha", 0.72, 0.72), ("loud", 0.72, 0.7)]

# A term of an aspect that counts only beside (True) or only without (False) other words
CONTEXTS = [
    ("performance", "lag", False, ["ui", "software", "bug", "bugs"]),
    ("performance", "gaming", False, ["heat", "heating", "hot", "garam", "tawa", "overheat", "thermal"]),
    ("design", "feel", True, ["design", "premium", "haath", "hand", "grip", "build", "back panel"]),
    ("connectivity", "drop", True, ["network", "call", "signal", "internet", "wifi", "wi-fi"]),
]

# Fixed values
HINGLISH_HINTS = ["hai", "nahi", "bahut", "ekdum", "mast", "bekar", "bakwas", "paisa", "vasool", "garam", "jaldi", "khatam", "theek", "acha", "bura", "bhai"]
ROUTE_MARKERS = ["wah", "kya phone", "tawa", "haath garam", "10 min", "but", "lekin", "par", "overall", "mixed", "not bad", "not good", "theek", "aisa bhi nahi", "expected better"]


def lexicon_rows() -> list[dict]:
    names = ["term", "normalized", "type", "aspect", "prior", "intensity", "confidence"]
    return [dict(zip(names, row)) | {"intensity": row[5] or 0.5} for row in LEXICON]


def of_type(*types: str) -> list[dict]:
    return [r for t in types for r in lexicon_rows() if r["type"] == t]


def aspect_terms() -> list[tuple[str, str, float, str | None]]:
    """(aspect, term, confidence, prior) in order of preference."""
    out = [(r["aspect"], r["normalized"], r["confidence"], r["prior"]) for r in of_type("aspect", "spelling_variant")]
    return out + [(aspect, term, confidence, prior) for aspect, terms in MORE_ASPECT_TERMS.items() for term, prior, confidence in terms]


def sentiment_terms() -> list[tuple[str, str, float, float]]:
    """(term, sentiment, intensity, confidence) in order of preference."""
    out = [(r["term"], r["prior"], r["intensity"], r["confidence"]) for r in of_type("sentiment")]
    return out + [(term, sentiment, i, c) for sentiment, words in (("negative", NEGATIVE_WORDS), ("positive", POSITIVE_WORDS)) for term, i, c in words]
