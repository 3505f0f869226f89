"""What a search text asks for: a place, a topic, a name; and how its parts become queries."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.text import STATES

#: Weights of the legs and of what fits a searcher.
WEIGHTS = {"keyword_leg": 0.8, "local_leg": 1.0, "geo": 0.45, "located": 0.15, "cause": 0.3, "open": 0.05, "preselected": 0.12, "stale": 0.2, "few_grantees": 0.2, "size": 0.1}
#: Candidates of each leg, and how many of the merged list go on.
LEG_LIMITS = {"meaning": 60, "keywords": 30, "local": 15, "givers": 30, "features": 40}
#: Words without a topic of their own.
GENERIC = frozenset(
    """a an and the of for to in on our we us with who that this is are grant grants funding fund funds funder funders support supporting program programs service services nonprofit nonprofits
    organization organizations general operating help helping provide providing need needs local work looking projects project""".split()
)
_FUNDER = re.compile(r"\b(foundation|fund|trust|charit\w*|endowment|philanthrop\w*)s?\b", re.I)
_ASKS = re.compile(r"\b(grants?(?!\s+(?:family\s+)?(?:foundation|fund|trust|endowment)s?\b)|funding|funders?|funds\b|support for|who fund|looking for|programs?|services?)\b", re.I)
_BY_NAME = sorted(((n.lower(), c) for n, c in STATES.items()), key=lambda x: -len(x[0]))


@dataclass(frozen=True)
class Understanding:
    state: str | None
    city: str | None
    topic: str
    navigational: bool


def _without(q: str, a: int, b: int) -> str:
    before = re.sub(r"\b(?:in|across|throughout|around|near|within|serving)\s*$", "", q[:a], flags=re.I).rstrip(" ,")
    return " ".join(f"{before} {q[b:].lstrip(' ,.')}".split())


def find_place(q: str, cities: dict[str, str] | None = None) -> tuple[str, str | None, str] | None:
    """HYB-10: (state code, city or None, the rest): a state's name, a known city, or a capital code after ``in``, ``across`` or a comma."""
    for name, code in _BY_NAME:
        m = re.search(rf"\b{re.escape(name)}\b", q, re.I)
        if m and not re.match(r"\s+city\b", q[m.end() :], re.I) and not (code == "WA" and re.search(r"\bwashington,?\s*d\.?\s*c\.?", q, re.I)):
            return code, None, _without(q, m.start(), m.end())
    for city, code in sorted((cities or {}).items(), key=lambda x: -len(x[0])):
        m = re.search(rf"\b{re.escape(city)}(?:,\s*{code}\b)?(?!\w)", q, re.I)
        if m:
            return code, q[m.start() : m.start() + len(city)], _without(q, m.start(), m.end())
    m = re.search(r"(?:\bin|\bacross|,)\s+([A-Z]{2})\b", q)
    if m and m[1] in STATES.values():
        return m[1], None, _without(q, m.start(1), m.end(1))
    return None


def is_funder_name(q: str, cities: dict[str, str] | None = None) -> bool:
    """HYB-10: A few words with a funder's word and no request; a place behind that word makes it a topic."""
    words = q.split()
    if not words or len(words) > 6 or not _FUNDER.search(q) or _ASKS.search(q):
        return False
    return find_place(q, cities) is None or bool(_FUNDER.search(words[-1]))


def understand(q: str | None, cities: dict[str, str] | None = None) -> Understanding:
    text = " ".join((q or "").split())
    found = find_place(text, cities) if text else None
    return Understanding(found[0] if found else None, found[1] if found else None, (found[2] if found else "") or text, bool(text) and is_funder_name(text, cities))


def content_words(topic: str, most: int = 12) -> list[str]:
    """HYB-10: The words that carry a topic, in order and once each."""
    words = (w.strip("'-") for w in re.sub(r"[^a-z0-9\s'-]", " ", topic.lower()).split())
    return list(dict.fromkeys(w for w in words if len(w) >= 3 and w not in GENERIC))[:most]


def phrase_query(q: str) -> str:
    """STR-23: Several words without operators are one phrase."""
    t = q.strip()
    return t if re.search(r'["]|(^|\s)OR(\s|$)|(^|\s)-\S', t) or not re.search(r"\s", t) else f'"{t}"'


def normal_name(name: str) -> str:
    return " ".join(re.sub(r"[^\w\s&-]", " ", name.upper()).split())


def name_variants(name: str, least: int = 3) -> list[str]:
    """STR-23: The name, and its spelling without apostrophes where that differs."""
    bare = re.sub("['’]", "", name)
    return [name, bare] if bare != name and len(bare.strip()) >= least else [name]


def name_tokens(normal: str, generic=frozenset({"THE", "FOUNDATION", "FUND", "TRUST", "INC", "CHARITABLE", "FAMILY", "AND"})) -> list[str]:
    """The words that tell a name apart, the longest first, three at most."""
    return sorted(dict.fromkeys(t for t in normal.split(" ") if len(t) >= 3 and t not in generic), key=lambda t: -len(t))[:3]


def resolve_context(url: dict, understood: Understanding, profile: dict) -> dict:
    """HYB-11: Place, cause and budget: what the address says before what the words say before what the profile says; and where each came from."""
    out = {}
    for key, said in (("state", understood.state), ("cause", None), ("budget", None)):
        for source, value in (("url", url.get(key)), ("query", said), ("profile", profile.get(key))):
            if value:
                out[key], out[f"{key}_from"] = value, source
                break
    return out


def choose_mode(q: str | None, understood: Understanding, asked: str | None = None) -> tuple[str, list[str]]:
    """HYB-09: (mode, notices): a number, a name, a topic, or browsing without words."""
    digits = re.sub(r"\D", "", q or "")
    if asked in ("name", "topic", "browse", "ein"):
        return asked, []
    if not (q or "").strip():
        return "browse", []
    if re.fullmatch(r"\s*\d{2}-?\d{7}\s*", q) and len(digits) == 9:
        return "ein", []
    return ("name", ["name_search"]) if understood.navigational else ("topic", ["place_from_words"] if understood.state else [])


def next_mode(mode: str, found: int, timed_out: bool = False) -> str | None:
    """HYB-12: Where a search goes on that found nothing or took too long; None where it ends."""
    if mode == "name" and not found:
        return "topic"
    if mode == "topic" and timed_out:
        return "keyword"
    return None


def filter_to_params(current: dict, change: dict, known=("state", "min_assets", "posture", "sort", "cause", "gives_in")) -> dict:
    """WS-27: Search parameters with a filter applied: None takes a parameter away, unknown ones and a page number go."""
    out = {k: v for k, v in current.items() if k != "page"}
    for k, v in change.items():
        if k in known:
            out.pop(k, None) if v is None else out.__setitem__(k, v)
    return out
