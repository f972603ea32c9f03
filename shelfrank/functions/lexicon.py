"""Word lists and rules as parameters.

``Lexicon()`` is empty; every operator works without one. ``SHOP`` is the list
written for the test tables (hardware titles, English/French/German/Spanish
prose). Callers with another catalogue pass their own, or load one from JSON.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from shelfrank.functions.stopwords import ENGLISH


@dataclass(frozen=True)
class Lexicon:
    # query token -> text appended to the query
    expansions: dict[str, str] = field(default_factory=dict)
    # query token -> accepted spellings of the concept
    concepts: dict[str, list[str]] = field(default_factory=dict)
    # query tokens that are no concept
    query_stop_words: list[str] = field(default_factory=list)
    # tags (as normalised keys) left out of the corpora
    noisy_tags: list[str] = field(default_factory=list)
    # label -> regexes, any match adds the label
    hint_rules: dict[str, list[str]] = field(default_factory=dict)
    # (needed label, any-of labels, appended labels)
    hint_combos: list[tuple[str, list[str], list[str]]] = field(default_factory=list)
    # tokens never indexed
    index_stop_words: list[str] = field(default_factory=lambda: list(ENGLISH))


def load_lexicon(path: str) -> Lexicon:
    """A lexicon from a small JSON file with the field names above."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    if "hint_combos" in raw:
        raw["hint_combos"] = [tuple(c) for c in raw["hint_combos"]]
    return Lexicon(**raw)


SHOP = Lexicon(
    expansions={
        "bolts": "screw fastener",
        "ring": "loop small ring",
        "rings": "loop small ring",
        "anvil": "forge iron",
        "cheap": "economy promo",
        "than": "large widget",
        "thes": "popular",
        "anti": "red bolt economy",
        "inin": "gizmo",
        "und": "standard gear",
        "pour": "cold plate",
        "cafe": "hot plate",
    },
    concepts={
        "ring": ["ring", "small loop"],
        "bolt": ["bolt", "Schraube", "écrou"],
        "than": ["large widget", "large gear", "than the"],
        "thin": ["thin", "thinly", "réthin"],
        "tion": ["tion of", "popular"],
        "und": ["und der", "medium"],
        "pour": ["pour la", "promo"],
        "cheap": ["economy", "promo"],
    },
    query_stop_words=[
        "the", "of", "to", "in", "and", "a", "de", "la", "en", "der", "is", "it", "on",
    ],
    noisy_tags=["steam cloud", "src3", "brand#7", "gift wrap"],
    hint_rules={
        "fasteners": [r"\bbolts?\b", r"\brods?\b"],
        "heavy tools": [r"\banvils?\b", r"\blarge plate\b"],
        "warm goods": [r"\bhot\b", r"\bred\b"],
        "cool goods": [r"\bcold\b", r"\bblue\b"],
        "bargain": [r"\beconomy\b", r"\bpromo\b"],
        "busy prose": [r"\bthan the\b", r"\bof the\b.{0,80}\bwith the\b"],
        "romance language": [r"\bpour\b", r"\bpara\b", r"\bque la\b"],
        "german language": [r"\bund der\b", r"\bsich\b", r"\bfur die\b"],
        "novelty": [r"\bnew\b", r"\bgizmos?\b"],
    },
    hint_combos=[
        ("fasteners", ["warm goods", "cool goods"], ["coloured fastener", "painted bolt"]),
        ("heavy tools", ["bargain"], ["budget forge"]),
        ("romance language", ["busy prose", "novelty"], ["mixed prose", "new voice"]),
        ("german language", ["bargain"], ["gunstig", "cheap und gut", "sparangebot"]),
    ],
)

# Rules of the tag extractor for the test texts: label -> regexes.
SHOP_TAG_RULES = {
    "Fastener": [r"\bbolt\b", r"\brod\b", r"\bring\b"],
    "Heavy": [r"large (?:plate|anvil)", r"\banvil\b"],
    "Warm": [r"\bhot\b", r"\bred\b"],
    "Thin": [r"\bthin", r"\binin\b"],
    "Prose": [r"that .*with the", r"it is"],
    "French": [r"que la", r"\bune\b"],
    "German": [r"\bund\b", r"\beine?\b"],
    "Spanish": [r"\blos\b", r"\bdel\b"],
}

SHOP_BLOCKLIST = ["anvil", "src13", "brand#21", "nsfw"]
SHOP_PRIORITY = ["Red Ring", "blue widget", "cold rod"]
