"""License scans: ordered signature rules over the words of a text, in Spark expressions only.

Method: each license of the table has hand-written patterns of its name; five
forms (tag, grant, address, title, mention) make a regular expression of each, a
few hundred in all, ordered by priority.  A text is looked at further only if it
holds one of a few marks, and a rule only if the text holds its keyword.  Every
match becomes an interval of words; an interval that lies inside one of the same
or a better priority is suppressed, so the most specific reading stands.

All of it is one projection: no Python on executors, no shuffle, and what a row
needs depends on its own text alone.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, unused

_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_V = "(?: version| v)? ?"


@dataclass(frozen=True)
class License:
    label: str
    keyword: str  # the beginning of a word that each of its patterns holds, in every alternative
    name: str  # pattern of its name, without a closing "license"
    tag: str  # its identifier's words
    address: str = ""  # pattern of the words of its address


#: Names, identifiers and addresses of public licenses, as words.
LICENSES = (
    License("mit", "mit", "mit", "mit", "opensource org licenses mit(?: license)?(?: php)?"),
    License("apache-1.1", "apache", f"apache(?: software)?(?: license)?{_V}1 1", "apache 1 1", "apache org licenses license 1 1"),
    License("apache-2", "apache", f"apache(?: software)?(?: license)?{_V}2(?: 0)?", "apache 2 0", "apache org licenses license 2 0"),
    License("gpl-1", "gpl", f"gpl{_V}1(?: 0)?", "gpl 1 0(?: only| or later)?", "gnu org licenses old licenses gpl 1 0"),
    License("gpl-2", "gpl", f"(?:gnu )?gpl{_V}2(?: 0)?", "gpl 2 0(?: only| or later)?", "gnu org licenses (?:old licenses )?gpl 2 0"),
    License("gpl-2", "gnu", f"gnu general public license{_V}2(?: 0)?", "gnu gpl 2 0", "gnu org licenses gpl2"),
    License("gpl-3", "gpl", f"(?:gnu )?gpl{_V}3(?: 0)?", "gpl 3 0(?: only| or later)?", "gnu org licenses gpl 3 0"),
    License("gpl-3", "gnu", f"gnu general public license{_V}3(?: 0)?", "gnu gpl 3 0", "gnu org licenses gpl3"),
    License("lgpl-2", "lgpl", f"(?:gnu )?lgpl{_V}2(?: 0)?", "lgpl 2 0(?: only| or later)?", "gnu org licenses old licenses lgpl 2 0"),
    License("lgpl-2.1", "lgpl", f"(?:gnu )?lgpl{_V}2 1", "lgpl 2 1(?: only| or later)?", "gnu org licenses (?:old licenses )?lgpl 2 1"),
    License("lgpl-2.1", "lesser", f"(?:gnu )?lesser general public license{_V}2 1", "gnu lesser 2 1"),
    License("lgpl-3", "lgpl", f"(?:gnu )?lgpl{_V}3(?: 0)?", "lgpl 3 0(?: only| or later)?", "gnu org licenses lgpl 3 0"),
    License("lgpl-3", "lesser", f"(?:gnu )?lesser general public license{_V}3(?: 0)?", "gnu lesser 3 0"),
    License("agpl-3", "agpl", f"(?:gnu )?agpl{_V}3(?: 0)?", "agpl 3 0(?: only| or later)?", "gnu org licenses agpl 3 0"),
    License("agpl-3", "affero", f"(?:gnu )?affero general public license(?:{_V}3(?: 0)?)?", "gnu affero 3 0"),
    License("bsd-2", "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    License("bsd-2", "freebsd", "freebsd", "bsd 2 clause freebsd"),
    License("bsd-3", "bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    License("bsd-4", "bsd", "(?:original bsd|old bsd|bsd 4 clause|4 clause bsd|four clause bsd)", "bsd 4 clause"),
    License("0bsd", "0bsd", "(?:0bsd|zero clause bsd 0bsd)", "0bsd", "opensource org licenses 0bsd"),
    License("bsd", "bsd", "bsd(?: style)?", "bsd", "opensource org licenses bsd license"),
    License("isc", "isc", "isc", "isc", "opensource org licenses isc(?: license)?"),
    License("zlib", "zlib", "zlib(?: libpng)?", "zlib", "opensource org licenses zlib"),
    License("mpl-1.1", "mpl", f"mpl{_V}1 1", "mpl 1 1", "mozilla org mpl mpl 1 1"),
    License("mpl-2", "mpl", f"mpl{_V}2(?: 0)?", "mpl 2 0", "mozilla org (?:en us )?mpl 2 0"),
    License("mpl-2", "mozilla", f"mozilla public license{_V}2(?: 0)?", "mozilla 2 0"),
    License("epl-1", "epl", f"epl{_V}1(?: 0)?", "epl 1 0", "eclipse org (?:legal|org documents) epl v10"),
    License("epl-1", "eclipse", f"eclipse public license{_V}1(?: 0)?", "eclipse 1 0"),
    License("epl-2", "epl", f"epl{_V}2(?: 0)?", "epl 2 0", "eclipse org legal epl (?:2 0|v20)"),
    License("epl-2", "eclipse", f"eclipse public license{_V}2(?: 0)?", "eclipse 2 0"),
    License("cddl-1", "cddl", f"cddl(?:{_V}1(?: [01])?)?", "cddl 1 [01]", "opensource org licenses cddl1"),
    License("cpl-1", "cpl", f"cpl{_V}1(?: 0)?", "cpl 1 0", "eclipse org legal cpl v10"),
    License("artistic-1", "artistic", f"artistic license{_V}1(?: 0)?", "artistic 1 0", "perlfoundation org artistic license 1 0"),
    License("artistic-2", "artistic", f"artistic license{_V}2(?: 0)?", "artistic 2 0", "perlfoundation org artistic license 2 0"),
    License("boost-1", "boost", f"boost software license(?:{_V}1(?: 0)?)?", "bsl 1 0", "boost org license 1 0"),
    License("unlicense", "unlicense", "unlicense", "unlicense", "unlicense org"),
    License("wtfpl", "wtfpl", f"wtfpl(?:{_V}2(?: 0)?)?", "wtfpl", "wtfpl net"),
    License("postgresql", "postgresql", "postgresql", "postgresql", "opensource org licenses postgresql"),
    License("python-2", "python", f"python(?: software foundation)?(?: license)?{_V}2(?: 0)?", "python 2 0", "docs python org 3 license"),
    License("php-3", "php", f"php license{_V}3(?: 01?)?", "php 3 01?", "php net license 3 01"),
    License("ruby", "ruby", "ruby", "ruby", "ruby lang org en about license"),
    License("openssl", "openssl", "openssl", "openssl", "openssl org source license"),
    License("x11", "x11", "x11", "x11", "xfree86 org 3 3 6 copyright2"),
    License("eupl-1.2", "eupl", f"eupl{_V}1 2", "eupl 1 2", "eur lex europa eu eupl 1 2"),
    License("ms-pl", "microsoft", "microsoft public", "ms pl", "opensource org licenses ms pl"),
    License("ofl-1.1", "ofl", f"(?:sil )?ofl(?:{_V}1 1)?", "ofl 1 1", "scripts sil org ofl"),
    License("gfdl-1.3", "gfdl", f"(?:gnu )?gfdl(?:{_V}1 3)?", "gfdl 1 3", "gnu org licenses fdl 1 3"),
    License("gfdl-1.3", "documentation", f"gnu free documentation license(?:{_V}1 3)?", "gnu fdl 1 3"),
    License("odbl-1", "odbl", f"odbl(?:{_V}1(?: 0)?)?", "odbl 1 0", "opendatacommons org licenses odbl 1 0"),
    License("cc0", "cc0", "cc0(?: 1 0)?", "cc0 1 0", "creativecommons org publicdomain zero 1 0"),
    License("cc-by", "cc", "cc by(?: [1-4] 0)?", "cc by [1-4] 0", "creativecommons org licenses by [1-4] 0"),
    License("cc-by-sa", "cc", "cc by sa(?: [1-4] 0)?", "cc by sa [1-4] 0", "creativecommons org licenses by sa [1-4] 0"),
    License("cc-by-nd", "cc", "cc by nd(?: [1-4] 0)?", "cc by nd [1-4] 0", "creativecommons org licenses by nd [1-4] 0"),
    License("cc-by-nc", "cc", "cc by nc(?: [1-4] 0)?", "cc by nc [1-4] 0", "creativecommons org licenses by nc [1-4] 0"),
    License("cc-by-nc-sa", "cc", "cc by nc sa(?: [1-4] 0)?", "cc by nc sa [1-4] 0", "creativecommons org licenses by nc sa [1-4] 0"),
    License("cc-by-nc-nd", "cc", "cc by nc nd(?: [1-4] 0)?", "cc by nc nd [1-4] 0", "creativecommons org licenses by nc nd [1-4] 0"),
    License("cc-by", "creative", "creative commons attribution(?: [1-4] 0)?(?: international)?", "creative by"),
    License("cc-by-sa", "creative", "creative commons attribution share ?alike(?: [1-4] 0)?(?: international)?", "creative by sa"),
    License("cc-by-nc", "creative", "creative commons attribution non ?commercial(?: [1-4] 0)?(?: international)?", "creative by nc"),
    License("cc-by-nc-sa", "creative", "creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?(?: international)?", "creative by nc sa"),
    License("cc-by-nc-nd", "creative", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] 0)?(?: international)?", "creative by nc nd"),
)

#: The phrases whose places are always counted.
BASE = (("mit", "the mit license", "mit"), ("apache-2", "apache license version 2", "apache"), ("cc-by-nc", "cc by nc", "cc"))

#: Marks that a text must hold to be looked at (or ``cc`` as a word): every rule matches only texts with one of them.
MARKS = ("licen", "mozilla", "eclipse", "wtfpl", "creative", "scripts", "europa", "xfree86")
_GRANT = "(?:released|distributed|available|published|provided|offered|covered)"
_UNDER = "(?:under|by) (?:the )?(?:terms of )?(?:the )?"


@dataclass(frozen=True)
class Rule:
    number: int
    priority: int
    label: str
    keyword: str
    pattern: str
    weight: float


def build_rules() -> list[Rule]:
    """Base phrases first, then every license in the forms from the most to the least specific."""
    out = [Rule(i, 0, label, kw, phrase, 0.9) for i, (label, phrase, kw) in enumerate(BASE)]
    forms = (
        (1, 1.0, lambda x: f"spdx license identifier {x.tag}"),
        (1, 0.95, lambda x: f"licen[cs]e (?:is |name |id |type )?{x.tag}" if x.tag != x.label else f"licen[cs]e {x.tag}"),
        (2, 0.95, lambda x: f"licen[cs]ed {_UNDER}{x.name}(?: licen[cs]e)?"),
        (2, 0.95, lambda x: f"{_GRANT} {_UNDER}{x.name} licen[cs]e"),
        (3, 0.9, lambda x: f"(?:www )?{x.address}" if x.address else None),
        (4, 0.8, lambda x: f"(?:the )?{x.name} licen[cs]es?"),
        (5, 0.6, lambda x: f"licen[cs]es? (?:of |and |or |under )?(?:the )?{x.name}"),
    )
    for priority, weight, form in forms:
        for x in LICENSES:
            pattern = form(x)
            if pattern:
                kw = x.keyword
                if priority in (1, 3) and kw not in pattern.replace("?", " ").replace("(", " ").replace(":", " ").split():
                    kw = "license" if priority == 1 and pattern.startswith("spdx") else ""
                out.append(Rule(len(out), priority, x.label, kw, pattern, weight))
    return out


RULES = build_rules()
PRIORITIES = max(r.priority for r in RULES) + 1
_HIT = "struct<start:int,back:int,priority:int,number:int,end:int,label:string,weight:double>"


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.translate(x, " ", ""))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(items: Column, state: Column, step, chunk: int = 256) -> Column:
    """All hits that ``step(state, item)``, the next state and an array of hits, gives from the first item to the last.

    Hits are gathered in chunks: an array that grows by one hit a step is copied
    each time, which a text with very many places would pay for with their square.
    """
    empty = lambda s: F.struct(s.alias("state"), F.array().cast(f"array<{_HIT}>").alias("hits"))

    def add(acc: Column, item: Column) -> Column:
        after, hits = step(acc["state"], item)
        return F.struct(after.alias("state"), F.concat(acc["hits"], hits).alias("hits"))

    def walk(xs: Column) -> Column:
        part = lambda acc, i: F.concat(acc, F.array(F.aggregate(F.slice(xs, i * chunk + 1, chunk), empty(F.element_at(acc, -1)["state"]), add)))
        chunks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(xs) - 1, F.lit(0)) / chunk).cast("int"))
        return F.flatten(F.transform(F.aggregate(chunks, F.array(empty(state)), part), lambda p: p["hits"]))

    return _let(items, walk)


def _places(norm: Column, rule: Column) -> Column:
    """Every match of a rule as an interval of words."""
    pattern = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))

    def walk(found: Column) -> Column:
        gaps = F.slice(F.split(norm, pattern, -1), 1, F.size(found))
        items = F.zip_with(gaps, found, lambda gap, match: F.struct(_spaces(gap).alias("gap"), _spaces(match).alias("match")))

        def step(at: Column, x: Column) -> Column:
            start = at + x["gap"] - 1
            end = start + x["match"] + 1
            hit = F.struct(
                start.alias("start"), (-end).alias("back"), rule["priority"].alias("priority"), rule["number"].alias("number"),
                end.alias("end"), rule["label"].alias("label"), rule["weight"].alias("weight"),
            )
            return end, F.array(hit)

        return F.when(F.size(found) > 0, _running(items, F.lit(0), step)).otherwise(F.array().cast(f"array<{_HIT}>"))

    return _let(F.regexp_extract_all(norm, pattern, F.lit(0)), walk)


def _standing(hits: Column) -> Column:
    """Hits that lie in no other of the same or a better priority; of equal ones the first rule's stands.

    In order of start, longest first, an earlier hit that ends no sooner contains a later one.
    """

    def step(ends: Column, h: Column) -> Column:
        inside = F.exists(F.slice(ends, 1, h["priority"] + 1), lambda e: e >= h["end"])
        after = F.transform(ends, lambda e, i: F.when(i == h["priority"], F.greatest(e, h["end"])).otherwise(e))
        return after, F.when(inside, F.array().cast(f"array<{_HIT}>")).otherwise(F.array(h))

    return _running(F.sort_array(hits), F.array(*[F.lit(-1)] * PRIORITIES), step)


def _labels(hits: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")


def license_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words, n_base, first_word, last_word, base_labels, labels, score, detections`` to the rows.

    Words are runs of ASCII letters and digits and of all other than ASCII
    characters; A-Z count as a-z.  ``n_base`` counts the places of the base
    phrases, ``first_word`` and ``last_word`` are the smallest and the largest
    start of one (from 0).  ``detections`` holds the intervals that stand, with
    label, rule and weight; ``score`` is the largest weight.

    Every input column stays; one of the same name as an output is replaced.
    Null, empty and wordless texts have no words: counts 0, empty labels, score 0,
    null places.  Repeated rows are judged each on its own.  Texts of any length are
    read whole.  Of hits that cover the same words the one of the first rule stands.
    An empty table stays empty.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    low_, norm_, hits_, base_, stand_ = unused(docs, "low", "norm", "hits", "base", "stand")
    low = F.col(low_)
    gate = F.rlike(t, F.lit(f"(?i)(?<!{_WORD})cc(?!{_WORD})"))
    for mark in MARKS:
        gate = gate | F.contains(low, F.lit(mark))
    norm = F.concat(F.lit(" "), F.btrim(F.translate(F.regexp_replace(t, _GAP, " "), _UPPER, _LOWER), F.lit(" ")), F.lit(" "))
    table = json.dumps([{**asdict(r), "keyword": f" {r.keyword}"} for r in RULES])
    rules = F.from_json(F.lit(table), "array<struct<number:int,priority:int,label:string,keyword:string,pattern:string,weight:double>>")
    df = docs.withColumn(low_, F.lower(t)).withColumns({norm_: F.when(gate, norm), "n_words": F.regexp_count(t, F.lit(_WORD + "+")).cast("long")})
    n = F.col(norm_)
    fired = F.filter(rules, lambda r: F.contains(n, r["keyword"]))
    hits = F.flatten(F.transform(fired, lambda r: _places(n, r)))
    df = df.withColumn(hits_, F.when(n.isNotNull(), hits)).withColumn(base_, F.filter(hits_, lambda h: h["priority"] == 0))
    df = df.withColumn(stand_, _standing(F.col(hits_)))
    starts = F.transform(base_, lambda h: h["start"])
    none = F.array().cast(f"array<{_HIT}>")
    stand, base = F.coalesce(stand_, none), F.coalesce(base_, none)
    shown = F.transform(stand, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["label"].alias("label"), h["number"].alias("rule"), h["weight"].alias("weight")))
    df = df.withColumns(
        {
            "n_base": F.size(base).cast("long"),
            "first_word": F.array_min(starts).cast("long"),
            "last_word": F.array_max(starts).cast("long"),
            "base_labels": _labels(base),
            "labels": _labels(F.concat(base, stand)),
            "score": F.coalesce(F.array_max(F.transform(stand, lambda h: h["weight"])), F.lit(0.0)),
            "detections": shown,
        }
    ).drop(low_, norm_, hits_, base_, stand_)
    return settle(df, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")


def query(docs: DataFrame) -> DataFrame:
    out = license_scan(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
