"""Fixed values of the note model: types, links, costs, stop words."""

from __future__ import annotations

# Fixed values.
NOTE_TYPES = ["fleeting", "literature", "permanent", "moc"]
INVERSES = {
    "related": "related", "derived-from": "derived-to", "derived-to": "derived-from", "supports": "supported-by", "supported-by": "supports",
    "contradicts": "contradicted-by", "contradicted-by": "contradicts", "part-of": "has-part", "has-part": "part-of", "answers": "answered-by",
    "answered-by": "answers", "refines": "refined-by", "refined-by": "refines", "same-as": "same-as", "alias-of": "has-alias",
    "has-alias": "alias-of", "follows": "precedes", "precedes": "follows",
}
HALF_COST = ["part-of", "has-part", "follows", "precedes", "same-as", "alias-of", "has-alias"]
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()
#: Column weights of full-text search and of term frequencies.
WEIGHTS = {"title": 2.0, "tags": 1.5, "body": 1.0}
DEFAULT_VALUE = 50
BM25_K1, BM25_B = 1.2, 0.75
RECENCY_NUMERATOR, RECENCY_DECAY_DAYS = 0.1, 7.0
ID_PREFIX = "qp-"
