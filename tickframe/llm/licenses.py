"""License scans: ordered signature rules behind a keyword prefilter.

Everything here is built of SQL functions; no Python runs on the executors.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .signatures import SIGNATURES
from .spans import matches, once, running

#: Phrases that always give their label.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Licences: SPDX-like label, then the ways their names are written as lower-case words (regexes).
NAMES: tuple[tuple[str, str], ...] = (
    ("mit", "mit|expat|x11"),
    ("mit-0", "mit no attribution|mit 0"),
    ("apache-1", "apache(?: software)?(?: license)? (?:version |v ?)?1(?: [01])?"),
    ("apache-2", "apache(?: software)?(?: license)? (?:version |v ?)?2(?: 0)?|asl ?2(?: 0)?"),
    ("gpl-1", "(?:gnu )?(?:gpl|general public license) ?(?:version |v ?)?1(?: 0)?"),
    ("gpl-2", "(?:gnu )?(?:gpl|general public license) ?(?:version |v ?)?2(?: 0)?"),
    ("gpl-3", "(?:gnu )?(?:gpl|general public license) ?(?:version |v ?)?3(?: 0)?"),
    ("lgpl-2", "(?:gnu )?(?:lgpl|(?:library|lesser) general public license) ?(?:version |v ?)?2(?: 0)?"),
    ("lgpl-2.1", "(?:gnu )?(?:lgpl|lesser general public license) ?(?:version |v ?)?2 1"),
    ("lgpl-3", "(?:gnu )?(?:lgpl|lesser general public license) ?(?:version |v ?)?3(?: 0)?"),
    ("agpl-3", "(?:gnu )?(?:agpl|affero general public license) ?(?:version |v ?)?3(?: 0)?"),
    ("gfdl", "(?:gnu )?(?:gfdl|free documentation license)"),
    ("bsd-0", "(?:bsd 0(?: clause)?|0 ?bsd|zero clause bsd)"),
    ("bsd-2", "(?:bsd 2(?: clause)?|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3", "(?:bsd 3(?: clause)?|3 clause bsd|(?:new|modified|revised) bsd)"),
    ("bsd-4", "(?:bsd 4(?: clause)?|4 clause bsd|(?:original|old) bsd)"),
    ("bsd", "bsd(?: style)?"),
    ("mpl-1", "(?:mpl|mozilla public license) ?(?:version |v ?)?1(?: [01])?"),
    ("mpl-2", "(?:mpl|mozilla public license) ?(?:version |v ?)?2(?: 0)?"),
    ("epl-1", "(?:epl|eclipse public license) ?(?:version |v ?)?1(?: 0)?"),
    ("epl-2", "(?:epl|eclipse public license) ?(?:version |v ?)?2(?: 0)?"),
    ("cddl", "(?:cddl|common development and distribution license)(?: 1 [01])?"),
    ("cpl", "(?:cpl|common public license)(?: 1 0)?"),
    ("isc", "isc"),
    ("zlib", "zlib(?: libpng)?"),
    ("boost", "boost(?: software)?(?: license)?(?: (?:version )?1 0)?"),
    ("unlicense", "unlicense"),
    ("wtfpl", "wtfpl|do what the f\\w+ you want to public license"),
    ("artistic-1", "artistic(?: license)? (?:version |v ?)?1(?: 0)?"),
    ("artistic-2", "artistic(?: license)? (?:version |v ?)?2(?: 0)?"),
    ("eupl", "(?:eupl|european union public licence)(?: (?:version |v ?)?1 [012])?"),
    ("cecill", "cecill(?: [abc]| 2(?: [01])?)?"),
    ("openssl", "openssl"),
    ("php", "php(?: license)?(?: (?:version )?3(?: 01?)?)?"),
    ("python", "(?:psf|python software foundation)(?: 2(?: 0)?)?"),
    ("postgresql", "postgresql"),
    ("ruby", "ruby"),
    ("vim", "vim"),
    ("ofl", "(?:ofl|sil open font license)(?: 1 [01])?"),
    ("odbl", "(?:odbl|open (?:data commons )?database license)(?: 1 0)?"),
    ("odc-by", "(?:odc by|open data commons attribution license)(?: 1 0)?"),
    ("pddl", "(?:pddl|public domain dedication and license)(?: 1 0)?"),
    ("ms-pl", "(?:ms pl|microsoft public license)"),
    ("ms-rl", "(?:ms rl|microsoft reciprocal license)"),
    ("osl-3", "(?:osl|open software license) ?(?:version |v ?)?3(?: 0)?"),
    ("afl-3", "(?:afl|academic free license) ?(?:version |v ?)?3(?: 0)?"),
    ("upl", "(?:upl|universal permissive license)(?: 1 0)?"),
    ("ncsa", "(?:ncsa|university of illinois)"),
    ("unicode", "unicode(?: dfs 2016| v3)?"),
    ("bsl", "(?:busl|business source license)(?: 1 1)?"),
    ("sspl", "(?:sspl|server side public license)(?: 1)?"),
    ("elastic", "elastic(?: license)?(?: 2(?: 0)?)?"),
    ("cc0", "(?:cc0|cc zero|creative commons zero)(?: 1 0)?"),
    ("cc-by", "(?:cc by|creative commons attribution)(?: [1234] 0)?"),
    ("cc-by-sa", "(?:cc by sa|creative commons attribution share ?alike)(?: [1234] 0)?"),
    ("cc-by-nd", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: [1234] 0)?"),
    ("cc-by-nc", "(?:cc by nc|creative commons attribution non ?commercial)(?: [1234] 0)?"),
    ("cc-by-nc-sa", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1234] 0)?"),
    ("cc-by-nc-nd", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: [1234] 0)?"),
)

#: Parts of words, of which each way to write a licence's name holds one; a label not named here stands for itself up to its first hyphen.
PARTS: dict[str, tuple[str, ...]] = {
    "mit": ("mit", "expat", "x11"),
    "apache-2": ("apache", "asl"),
    **{x: ("gpl", "general public") for x in ("gpl-1", "gpl-2", "gpl-3", "lgpl-2", "lgpl-2.1", "lgpl-3", "agpl-3")},
    "gfdl": ("gfdl", "free documentation"),
    **{x: (x.split("-")[0], "public license") for x in ("mpl-1", "mpl-2", "epl-1", "epl-2", "cpl")},
    "cddl": ("cddl", "common development"),
    "wtfpl": ("wtfpl", "do what the"),
    "eupl": ("eupl", "european union"),
    "python": ("psf", "python software"),
    "ofl": ("ofl", "open font"),
    "odbl": ("odbl", "database license"),
    "odc-by": ("odc by", "attribution license"),
    "pddl": ("pddl", "public domain dedication"),
    "ms-pl": ("ms pl", "microsoft public"),
    "ms-rl": ("ms rl", "microsoft reciprocal"),
    "osl-3": ("osl", "open software"),
    "afl-3": ("afl", "academic free"),
    "upl": ("upl", "permissive license"),
    "ncsa": ("ncsa", "university of illinois"),
    "bsl": ("busl", "business source"),
    "sspl": ("sspl", "server side"),
    "cc0": ("cc0", "cc zero", "commons zero"),
    **{x: ("cc by", "commons attribution") for x in ("cc-by", "cc-by-sa", "cc-by-nd", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd")},
}

#: How a name is put: priority, a word that every match holds, and the frame around the name.
FRAMES: tuple[tuple[int, str, str], ...] = (
    (95, "spdx", "spdx license identifier (?:{})"),
    (80, "under", "(?:licensed|distributed|released|available|provided|published) under (?:the )?(?:terms of (?:the )?)?(?:{})(?: licen[cs]e)?"),
    (75, "licen", "licen[cs]e (?:is )?(?:the )?(?:{})"),
    (70, "licen", "(?:under )?(?:the )?(?:{}) licen[cs]e"),
)

def rules() -> list[tuple[str, int, str, str]]:
    """All rules (label, priority, keyword, regex): the signatures, and every name in every frame."""
    return list(SIGNATURES) + [(label, priority, keyword, frame.format(names)) for label, names in NAMES for priority, keyword, frame in FRAMES]


def name_parts(label: str) -> tuple[str, ...]:
    return PARTS.get(label, (label.split("-")[0],))


def _named() -> list[tuple[str, ...] | None]:
    """What a name's rules ask for besides their keyword, in the order of ``rules()``; None for signatures."""
    return [None] * len(SIGNATURES) + [name_parts(label) for label, _ in NAMES for _ in FRAMES]


def gates() -> list[tuple[str, ...]]:
    """What the prefilter asks for: a text must hold all parts of one entry, in any case.

    These are the words of the rules' keywords and of the base phrases, one by one, so that it does not matter
    what stands between two words; entries that a shorter one implies are left out.
    """
    every = sorted({tuple(k.split()) for _, _, k, _ in rules()} | {tuple(p.split()) for p, _ in BASE}, key=lambda g: (len(g), len("".join(g)), g))
    out: list[tuple[str, ...]] = []
    for gate in every:
        if not any(all(any(part in word for word in gate) for part in known) for known in out):
            out.append(gate)
    return out


def _spaces(part: Column) -> Column:
    return F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))


def _places(norm: Column, pattern: Column | str) -> Column:
    """Where a rule matches: ``array<struct<start, end>>`` in words, ends exclusive."""
    # Each word of ``norm`` has one space before it; a match begins after one and ends before another.
    return F.transform(matches(norm, pattern, 0, _spaces), lambda x: F.struct((x["start"] - 1).alias("start"), x["end"].alias("end")))


def _any_name(small: Column) -> Column:
    """Whether lower-case text, with anything between words, holds the words of some name's part."""
    parts = sorted({p for label, _ in NAMES for p in name_parts(label)})
    return F.rlike(small, F.lit("|".join(p.replace(" ", "[^0-9a-z]+") for p in parts)))


def _whole(regex: str) -> str:
    return f"(?<= )(?:{regex})(?= )"


def _live(norm: str) -> Column:
    """The numbers of the rules that match anywhere in a column.

    Patterns are literals, which Spark compiles once, and only those whose keyword is there are
    tried.  Built as one SQL text, as there are hundreds.
    """
    holds = lambda word: f"contains({norm}, '{word}')"
    by_keyword: dict[str, list[str]] = {}
    for n, ((_, _, keyword, regex), parts) in enumerate(zip(rules(), _named(), strict=True)):
        named = f"({' OR '.join(map(holds, parts))}) AND " if parts else ""
        by_keyword.setdefault(keyword, []).append(f"CASE WHEN {named}rlike({norm}, r'{_whole(regex)}') THEN {n} END")
    tried = (f"CASE WHEN {holds(k)} THEN array({', '.join(own)}) ELSE CAST(array() AS array<int>) END" for k, own in by_keyword.items())
    return F.expr(f"filter(flatten(array({', '.join(tried)})), n -> n IS NOT NULL)")


def _unsuppressed(found: Column) -> Column:
    """The detections that are not inside another of higher priority, nor of equal priority and more words; of equal ones the first rule's stays.

    ``found`` has ``start, back, rank, nth, label`` (``back`` and ``rank`` being the negative end
    and priority), and in its natural order whatever suppresses a detection stands before it.  So
    a running maximum of the ends of each priority or higher tells who is inside another.
    """

    def sift(sorted_: Column) -> Column:
        ranks = F.array_distinct(F.transform(sorted_, lambda x: x["rank"]))
        tops = F.transform(ranks, lambda r: F.struct(r.alias("rank"), running(F.transform(sorted_, lambda x: F.when(x["rank"] <= r, -x["back"]).otherwise(-1)), F.greatest).alias("tops")))

        def keep(tops: Column) -> Column:
            above = lambda x, i: F.filter(tops, lambda t: t["rank"] == x["rank"])[0]["tops"][i - 1]
            return F.filter(sorted_, lambda x, i: F.when(i == 0, True).otherwise(above(x, i) < -x["back"]))

        return once(tops, keep)

    return once(F.array_sort(found), sift)


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, detections, score``.

    Words are runs of ``[0-9a-z]`` and non-ASCII characters, A-Z in lower case, numbered from 0.
    Base phrases give ``n_base`` (all places), their smallest and largest start and their labels.
    The ordered rules run over texts that one of ``gates()`` lets through, each rule only if its own
    keyword is there, and a name's rules only if one of its ``PARTS`` is; every match holds these,
    so they change no result.  A detection inside another of higher priority, or of equal priority and
    more words, is suppressed (of equal ones the first rule stays); the rest are ``detections``,
    structs of start, end, priority and label, and ``labels`` are theirs and the base ones.
    ``score`` is the highest priority among them / 100, at least 0.8 with a base phrase, 0 with
    nothing.

    A pure projection: no shuffle, and every row for itself, so ties and repeated rows need no
    care.  Time grows with n log n of a text's matches.  Null and empty texts have no words.
    Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    small, gate = F.col("small"), F.lit(False)
    for parts in gates():
        held = reduce(and_, (F.contains(small, F.lit(p)) for p in parts))
        gate = gate | (held & _any_name(small) if parts == ("under",) else held)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    given = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    text = F.col("text")
    norm = F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.translate(text, upper, lower), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), F.lit(" ")), F.lit(" "))
    rows = given.select("doc_id", "text", F.lower("text").alias("small")).select(
        "doc_id",
        F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("n_words"),
        F.when(gate, norm).alias("norm"),
    )
    rows = rows.withColumn("live", F.when(F.col("norm").isNotNull(), _live("norm")))

    told = json.dumps([{"label": label, "rank": -p, "nth": n, "pattern": _whole(r)} for n, (label, p, _, r) in enumerate(rules())])
    table = F.from_json(F.lit(told), "array<struct<label:string,rank:int,nth:int,pattern:string>>")  # folded into a constant

    def detect(norm: Column) -> Column:
        of_rule = lambda r: F.transform(_places(norm, r["pattern"]), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), r["rank"].alias("rank"), r["nth"].alias("nth"), r["label"].alias("label")))
        return F.flatten(F.transform(F.transform("live", lambda n: table[n]), of_rule))

    def labelled(phrase: str, label: str) -> Column:
        return F.transform(_places(F.col("norm"), f"(?<= ){phrase}(?= )"), lambda x: F.struct(x["start"].alias("start"), F.lit(label).alias("label")))

    base = F.flatten(F.array(*(labelled(*x) for x in BASE)))
    kept = F.transform(_unsuppressed(detect(F.col("norm"))), lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), (-x["rank"]).alias("priority"), x["label"].alias("label")))
    here, hit = F.col("norm").isNotNull(), F.size("live") > 0
    rows = rows.select(
        "doc_id",
        "n_words",
        F.when(here, base).otherwise(F.array().cast("array<struct<start:int,label:string>>")).alias("base"),
        F.when(hit, kept).otherwise(F.array().cast("array<struct<start:int,end:int,priority:int,label:string>>")).alias("detections"),
    )
    starts, priorities = F.transform("base", lambda x: x["start"]), F.transform("detections", lambda x: x["priority"])
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("detections", lambda x: x["label"]))))
    best = F.greatest(F.coalesce(F.array_max(priorities), F.lit(0)), F.when(F.size("base") > 0, 80).otherwise(0))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        "detections",
        (best / F.lit(100.0)).alias("score"),
    )
