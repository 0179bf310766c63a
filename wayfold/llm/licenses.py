"""License scans: ordered signature rules behind keyword filters, resolved by interval containment and priority.

DataFrame functions only. All rules work on the text as lower-case words with one space around each."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Phrases whose every place counts, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_OTHER = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_START, _STOP = "\u0001", "\u0002"


@dataclass(frozen=True)
class Rule:
    """`needle` must occur in the text, at a word's start, before `pattern` is tried: every match has to contain it. Lower `priority` wins between equal intervals."""

    label: str
    priority: int
    confidence: float
    needle: str
    pattern: str


# (label stem, names in words, versions); a name may be a pattern, its needle is the part before the first bracket.
_VERSIONED = (
    ("gpl", ("gnu general public license", "gnu gpl", "gpl"), ("1.0", "2.0", "3.0")),
    ("lgpl", ("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"), ("2.0", "2.1", "3.0")),
    ("agpl", ("gnu affero general public license", "affero general public license", "gnu agpl", "agpl"), ("1.0", "3.0")),
    ("gfdl", ("gnu free documentation license", "gfdl"), ("1.1", "1.2", "1.3")),
    ("apache", ("apache software license", "apache license", "apache"), ("1.0", "1.1", "2.0")),
    ("mpl", ("mozilla public license", "mpl"), ("1.0", "1.1", "2.0")),
    ("epl", ("eclipse public license", "epl"), ("1.0", "2.0")),
    ("cddl", ("common development and distribution license", "cddl"), ("1.0", "1.1")),
    ("cpl", ("common public license",), ("1.0",)),
    ("eupl", ("european union public licence", "european union public license", "eupl"), ("1.0", "1.1", "1.2")),
    ("osl", ("open software license", "osl"), ("1.0", "2.0", "2.1", "3.0")),
    ("afl", ("academic free license", "afl"), ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("artistic", ("artistic license",), ("1.0", "2.0")),
    ("bsl", ("boost software license", "bsl"), ("1.0",)),
    ("lppl", ("latex project public license", "lppl"), ("1.0", "1.1", "1.2", "1.3")),
    ("ofl", ("sil open font license", "open font license"), ("1.0", "1.1")),
    ("odbl", ("open database license", "odbl"), ("1.0",)),
    ("cc-by", ("creative commons attribution", "cc by"), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-sa", ("creative commons attribution sharealike", "creative commons attribution share alike", "cc by sa"), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nd", ("creative commons attribution noderivatives", "creative commons attribution no derivatives", "cc by nd"), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc", ("creative commons attribution noncommercial", "creative commons attribution non commercial", "cc by nc"), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-sa", ("creative commons attribution noncommercial sharealike", "creative commons attribution non commercial share alike", "cc by nc sa"), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-nd", ("creative commons attribution noncommercial noderivatives", "creative commons attribution non commercial no derivatives", "cc by nc nd"), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc0", ("cc0", "creative commons zero"), ("1.0",)),
)
# (label, priority, confidence, needle, pattern): licenses that are known by their own words.
_WORDED = (
    ("mit", 20, 1.0, "spdx license identifier mit", "spdx license identifier mit"),
    ("mit", 30, 0.9, "mit license", "(?:the )?mit license"),
    ("mit", 30, 0.95, "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", 35, 0.8, "licen", "licen[cs]ed under (?:the )?mit"),
    ("mit-0", 19, 1.0, "mit 0", "spdx license identifier mit 0"),
    ("bsd-2-clause", 20, 1.0, "bsd 2 clause", "(?:spdx license identifier )?bsd 2 clause(?: license)?"),
    ("bsd-2-clause", 25, 0.9, "simplified bsd", "simplified bsd license"),
    ("bsd-3-clause", 20, 1.0, "bsd 3 clause", "(?:spdx license identifier )?bsd 3 clause(?: license)?"),
    ("bsd-3-clause", 25, 0.9, "bsd license", "(?:new|revised|modified) bsd license"),
    ("bsd-4-clause", 20, 1.0, "bsd 4 clause", "(?:spdx license identifier )?bsd 4 clause(?: license)?"),
    ("bsd", 40, 0.8, "bsd", "(?:the )?bsd (?:style )?license"),
    ("bsd", 45, 0.9, "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", 25, 0.9, "isc license", "(?:the )?isc license"),
    ("isc", 25, 0.9, "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose"),
    ("zlib", 25, 0.9, "zlib", "zlib(?: libpng)? license"),
    ("unlicense", 25, 0.9, "unlicense", "(?:the )?unlicense"),
    ("unlicense", 25, 0.9, "released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("public-domain", 60, 0.6, "public domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("wtfpl", 25, 0.9, "wtfpl", "wtfpl"),
    ("wtfpl", 25, 0.9, "do what the fuck", "do what the fuck you want to public license"),
    ("postgresql", 25, 0.9, "postgresql license", "(?:the )?postgresql license"),
    ("python", 25, 0.9, "python software foundation license", "python software foundation license(?: version 2)?"),
    ("php", 25, 0.9, "php license", "php license(?: version 3 0[01]?)?"),
    ("ruby", 25, 0.8, "ruby license", "ruby license"),
    ("openssl", 25, 0.9, "openssl license", "openssl license"),
    ("cc0", 25, 0.8, "no rights reserved", "no rights reserved"),
    ("proprietary", 70, 0.5, "all rights reserved", "all rights reserved"),
    ("proprietary", 65, 0.6, "proprietary", "proprietary (?:and confidential|license|software)"),
    ("unknown-license", 90, 0.3, "license agreement", "license agreement"),
    ("copyright", 95, 0.2, "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}"),
)


def rules() -> list[Rule]:
    """All rules in order: for every versioned license its names crossed with the ways of writing a version, its tag, its
    address, and each name alone; then the worded ones."""
    out = []
    for stem, names, versions in _VERSIONED:
        for version in versions:
            spaced = version.replace(".", " ")
            number = spaced.removesuffix(" 0") + "(?: 0)?" if spaced.endswith(" 0") else spaced
            tag = rf"{stem.replace('-', ' ')} {spaced}"
            out.append(Rule(f"{stem}-{version}", 5, 1.0, f"spdx license identifier {stem.replace('-', ' ')}", rf"spdx license identifier {tag}(?: only| or later)?"))
            for name in names:
                out.append(Rule(f"{stem}-{version}", 10, 0.95, name, rf"(?:the )?{name}(?: license| licence| international| unported| generic)*(?: version| ver| v)? ?v?{number}(?: license| international| unported| generic| only| or later| or any later version)*"))
        for name in names:
            if " " in name:
                out.append(Rule(stem, 50, 0.7, name, rf"(?:the )?{name}(?: license| licence)?"))
        if stem.startswith("cc-"):
            out += [Rule(f"{stem}-{v}", 8, 0.95, "creativecommons org licenses", rf"creativecommons org licenses {stem.removeprefix('cc-').replace('-', ' ')} {v.replace('.', ' ')}") for v in versions]
    out += [Rule(f"{s}-{v}", 8, 0.95, f"{host} org licenses", rf"{host} org licenses {path} {v.replace('.', ' ')}(?: html| txt)?") for s, host, path, vs in (
        ("apache", "apache", "license", ("1.0", "1.1", "2.0")), ("gpl", "gnu", "gpl", ("1.0", "2.0", "3.0")), ("lgpl", "gnu", "lgpl", ("2.1", "3.0")),
        ("agpl", "gnu", "agpl", ("3.0",)), ("mpl", "mozilla", "mpl", ("1.1", "2.0"))) for v in vs]
    return out + [Rule(*w) for w in _WORDED]


def _gate(extra: list[Rule] | None = None) -> str:
    """Any text with a base phrase or a rule's needle, those of `extra` included, matches this; each alternative is the start of one of their words,
    or a rarer pair of words where single words are common."""
    alone = ("licen", "gpl", "spdx", "copyright", "creativecommons", "apache", "unlicense", "wtfpl", "proprietary", "bsd", "mpl", "epl", "cddl", "eupl", "osl", "afl", "bsl", "lppl", "odbl", "gfdl", "lgpl", "agpl", "cc0", "zlib", "simplified bsd", "creative commons", "mozilla org", "gnu org", "gnu gpl", "gnu lgpl", "gnu agpl")
    pairs = ("cc by", "mit 0", "permission is", "permission to", "redistribution and", "public domain", "rights reserved", "do what", "released into", "sil open", "open font")
    gap = f"[{_OTHER}]+"
    own = [" ".join(map(re.escape, r.needle.split())) or f"[^{_OTHER}]" for r in extra or []]
    return f"(?i)(?<![^{_OTHER}])(?:" + "|".join(w.replace(" ", gap) for w in (*alone, *pairs, *own)) + ")"


def _words(text: Column) -> Column:
    """` word word ... `: A-Z lower-cased, other ASCII cut out."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, f"[{_OTHER}]+", " ")), F.lit(" "))


def n_words(text: Column) -> Column:
    """Number of words: every match takes one word and the other characters around it."""
    words = F.length(F.regexp_replace(text, f"[{_OTHER}]*[^{_OTHER}]+[{_OTHER}]*", "w"))
    return F.when(text.rlike(f"[^{_OTHER}]"), words).otherwise(0).cast("long")


def rule_rows(extra: list[Rule] | None = None) -> list[dict]:
    """Base phrases (priority 0, `base`) and all rules; a few hundred, whatever the corpus."""
    names = ("rule", "label", "priority", "confidence", "needle", "pattern", "base")
    rows = [(f"base-{i}", label, 0, 0.6, phrase, phrase, True) for i, (phrase, label) in enumerate(BASE.items())]
    rows += [(f"rule-{i}", r.label, r.priority, r.confidence, r.needle, r.pattern, False) for i, r in enumerate([*rules(), *(extra or [])])]
    return [dict(zip(names, r)) for r in rows]


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: list[Rule] | None = None) -> DataFrame:
    """`(doc_id, row, rule, label, priority, confidence, base, first, last)`: all matches, `first` and `last` word of each.

    Texts pass one gate expression; those that do meet only rules whose needle they hold (an array filter over the fixed
    rule table). A match is marked in the word string, and the marked words' numbers are its interval.
    Matches of one rule do not overlap."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.where(F.col("text").rlike(_gate(extra))).select("doc_id", F.xxhash64("text").alias("row"), _words(F.col("text")).alias("words"))
    listed = [r | {"needle": f" {r['needle']}"} for r in rule_rows(extra)]
    literal = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in r.items()]) for r in listed])
    held = F.filter(literal, lambda r: F.instr("words", r.needle) > 0)
    rows = texts.select("doc_id", "row", "words", F.explode(held).alias("r")).select("doc_id", "row", "words", "r.*")
    marked = F.regexp_replace("words", F.concat(F.lit("(?<= )(?:"), F.col("pattern"), F.lit(")(?= )")), F.lit(_START + "$0" + _STOP))
    rows = rows.withColumn("cut", marked).where(F.instr("cut", _START) > 0)
    places = F.transform(F.split(F.trim("cut"), " "), lambda w, i: F.struct(i.alias("at"), w.startswith(_START).alias("a"), w.endswith(_STOP).alias("z")))
    rows = rows.withColumn("places", F.filter(places, lambda p: p.a | p.z))
    pairs = F.arrays_zip(
        F.transform(F.filter("places", lambda p: p.a), lambda p: p.at).alias("first"), F.transform(F.filter("places", lambda p: p.z), lambda p: p.at).alias("last")
    )
    return rows.select("doc_id", "row", "rule", "label", "priority", "confidence", "base", F.explode(pairs).alias("pair")).select(
        "doc_id", "row", "rule", "label", "priority", "confidence", "base", F.col("pair.first").alias("first"), F.col("pair.last").alias("last")
    ).distinct()


def resolved(found: DataFrame) -> DataFrame:
    """Adds `suppressed`: the interval lies in one that comes before it, sorted by first word, longer first, then priority
    and rule. One window over each document's matches; intervals that only overlap both stand."""
    order = Window.partitionBy("doc_id", "row").orderBy("first", F.desc("last"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("suppressed", F.coalesce(F.max("last").over(order) >= F.col("last"), F.lit(False)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: list[Rule] | None = None) -> DataFrame:
    """`(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans)` for every row. `n_base` counts
    all places of base phrases, suppressed or not, `first_word` and `last_word` are their smallest and largest start;
    `labels` are the base labels and those of the matches that stand; `score` is the best confidence among them (0: none);
    `spans` lists the matches that stand.

    Null texts are empty. Repeated rows come back as often, each with the result of its text; null ids are kept, and
    rows without an id share nothing but equal texts. Extra columns are ignored."""
    found = resolved(detections(docs, id_col, text_col, extra))
    base, stands = F.col("base"), ~F.col("suppressed")
    named = lambda keep: F.array_join(F.array_sort(F.collect_set(F.when(keep, F.col("label")))), ",")
    per = found.groupBy("doc_id", "row").agg(
        F.sum(base.cast("long")).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"), named(base).alias("base_labels"), named(base | stands).alias("labels"),
        F.max(F.when(base | stands, F.col("confidence"))).alias("score"),
        F.array_sort(F.collect_set(F.when(stands, F.struct("first", "last", "label", "rule")))).alias("spans"),
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("row"), n_words(text).alias("n_words"))
    joined = every.alias("e").join(per.alias("p"), F.expr("e.row = p.row AND e.doc_id <=> p.doc_id"), "left")
    return joined.select(
        "e.doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("spans", F.array().cast("array<struct<first:int,last:int,label:string,rule:string>>")).alias("spans"),
    )
