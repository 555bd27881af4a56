"""License scans with ordered signature rules, in DataFrame functions only.

A rule is a regular expression over the text's words (A-Z lowered, one space between words), with a label,
a priority and a confidence, gated by a keyword: the expression runs only where the keyword stands in the
text. Texts without any keyword run no rule at all. Detections are word intervals. One that lies within the
interval of another of the same or a better priority is suppressed; of equal intervals the better priority,
then the earlier rule, stays. What remains gives the labels and the score.

Base phrases are found apart from the rules and always keep their labels.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows each get a row;
extra columns are ignored; long texts are scanned whole.
"""

from __future__ import annotations

import json
import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import let, running

#: Phrases whose every place counts, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keyword: str
    priority: int
    confidence: float


#: Families of licenses: label, keyword, expression of the license's name, expression of its short tag.
#: Names and tags are over lower-case words. An entry without a tag has no tag rules.
FAMILIES: list[tuple[str, str, str, str | tuple[str, ...] | None]] = [
    ("mit", "mit", "(the )?mit( x11)?( licen[cs]e)", "mit"),
    ("mit-0", "mit", "mit no attribution( licen[cs]e)?", "mit 0"),
    ("expat", "expat", "(the )?expat licen[cs]e", "expat"),
    ("x11", "x11", "(the )?x11 licen[cs]e", "x11"),
    ("isc", "isc", "(the )?isc licen[cs]e", "isc"),
    ("apache-1-1", "apache", "apache (software )?licen[cs]e (version |v )?1 1", "apache 1 1"),
    ("apache-2", "apache", "apache (software )?licen[cs]e( version| v)? ?2( 0)?", "apache 2( 0)?"),
    ("apache", "apache", "apache (software )?licen[cs]e", None),
    ("bsd-0", "bsd", "(zero|0) clause bsd( licen[cs]e)?", "0bsd"),
    ("bsd-2", "bsd", "(the )?(simplified|freebsd|2 clause|two clause) bsd( licen[cs]e)?", "bsd 2 clause"),
    ("bsd-3", "bsd", "(the )?(new|revised|modified|3 clause|three clause) bsd( licen[cs]e)?", "bsd 3 clause"),
    ("bsd-4", "bsd", "(the )?(original|4 clause|four clause) bsd( licen[cs]e)?", "bsd 4 clause"),
    ("bsd", "bsd", "(the )?bsd( style)? licen[cs]e", None),
    ("gpl-1", "general public", "(gnu )?general public licen[cs]e( version| v) ?1( 0)?", "gpl 1 0( only| or later)?"),
    ("gpl-2", "general public", "(gnu )?general public licen[cs]e( version| v) ?2( 0)?", "gpl 2 0( only| or later)?"),
    ("gpl-3", "general public", "(gnu )?general public licen[cs]e( version| v) ?3( 0)?", "gpl 3 0( only| or later)?"),
    ("gpl", "general public", "gnu general public licen[cs]e", "gpl"),
    ("lgpl-2", "general public", "(gnu )?library general public licen[cs]e( version| v)? ?2( 0)?", "lgpl 2 0( only| or later)?"),
    ("lgpl-2-1", "general public", "(gnu )?lesser general public licen[cs]e( version| v)? ?2 1", "lgpl 2 1( only| or later)?"),
    ("lgpl-3", "general public", "(gnu )?lesser general public licen[cs]e( version| v)? ?3( 0)?", "lgpl 3 0( only| or later)?"),
    ("lgpl", "general public", "(gnu )?(lesser|library) general public licen[cs]e", "lgpl"),
    ("agpl-3", "general public", "(gnu )?affero general public licen[cs]e( version| v) ?3( 0)?", "agpl 3 0( only| or later)?"),
    ("agpl", "general public", "(gnu )?affero general public licen[cs]e", "agpl"),
    ("gfdl-1-3", "documentation", "(gnu )?free documentation licen[cs]e( version| v)? ?1 3", "gfdl 1 3( only| or later)?"),
    ("gfdl", "documentation", "(gnu )?free documentation licen[cs]e", "gfdl"),
    ("mpl-1-1", "mozilla", "mozilla public licen[cs]e( version| v)? ?1 1", "mpl 1 1"),
    ("mpl-2", "mozilla", "mozilla public licen[cs]e( version| v)? ?2( 0)?", "mpl 2 0"),
    ("mpl", "mozilla", "mozilla public licen[cs]e", None),
    ("epl-1", "eclipse", "eclipse public licen[cs]e( version| v)? ?1( 0)?", "epl 1 0"),
    ("epl-2", "eclipse", "eclipse public licen[cs]e( version| v)? ?2( 0)?", "epl 2 0"),
    ("cddl-1", "distribution", "common development and distribution licen[cs]e( version| v)?( 1( 0)?)?", "cddl 1 0"),
    ("cpl-1", "common public", "common public licen[cs]e( version| v)?( 1( 0)?)?", "cpl 1 0"),
    ("eupl-1-2", "european union", "european union public licen[cs]e( version| v)?( 1 2)?", "eupl 1 2"),
    ("artistic-1", "artistic", "artistic licen[cs]e( version| v)? ?1( 0)?", "artistic 1 0"),
    ("artistic-2", "artistic", "artistic licen[cs]e( version| v)? ?2( 0)?", "artistic 2 0"),
    ("bsl-1", "boost", "boost software licen[cs]e( version| v)?( 1( 0)?)?", "bsl 1 0"),
    ("zlib", "zlib", "zlib( libpng)? licen[cs]e", "zlib"),
    ("unlicense", "unlicense", "the unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "(the )?wtfpl", "wtfpl"),
    ("psf-2", "python", "python software foundation licen[cs]e( version| v)?( 2( 0)?)?", ("psf 2 0", "python 2 0")),
    ("ruby", "ruby", "(the )?ruby licen[cs]e", "ruby"),
    ("php-3", "php", "(the )?php licen[cs]e( version| v)?( 3( 0| 01)?)?", "php 3 0|php 3 01"),
    ("postgresql", "postgresql", "(the )?postgresql licen[cs]e", "postgresql"),
    ("openssl", "openssl", "(the )?openssl licen[cs]e", "openssl"),
    ("ofl-1-1", "open font", "(sil )?open font licen[cs]e( version| v)?( 1 1)?", "ofl 1 1"),
    ("odbl-1", "database licen", "open (data commons open )?database licen[cs]e", "odbl 1 0"),
    ("odc-by-1", "data commons", "open data commons attribution licen[cs]e", "odc by 1 0"),
    ("pddl-1", "public domain", "public domain dedication and licen[cs]e", "pddl 1 0"),
    ("upl-1", "universal", "universal permissive licen[cs]e( version| v)?( 1 0)?", "upl 1 0"),
    ("ncsa", "illinois", "university of illinois( ncsa)? open source licen[cs]e", "ncsa"),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e", "ms rl"),
    ("busl-1-1", "business source", "business source licen[cs]e( version| v)?( 1 1)?", "busl 1 1"),
    ("sspl-1", "server side", "server side public licen[cs]e( version| v)?( 1)?", "sspl 1 0"),
    ("elastic-2", "elastic", "elastic licen[cs]e( version| v)?( 2( 0)?)?", "elastic 2 0"),
    ("openrail-m", "responsible ai", "(open )?responsible ai licen[cs]e", "openrail m?"),
    ("mulan-psl-2", "mulan", "mulan permissive software licen[cs]e( version| v)?( 2)?", "mulanpsl 2 0"),
    ("cc0", "cc0", "cc0( 1 0)?( universal)?", "cc0 1 0"),
]

#: Elements of Creative Commons licenses and how they are spelt out.
CC_ELEMENTS = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(ative)?s?( works)?", "sa": "share ?alike"}
CC_KINDS = ["by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"]
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]

#: Sentences that only license texts or notices have.
SENTENCES: list[tuple[str, str, str]] = [
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission to use", "permission to use copy modify and( or)? distribute this software for any purpose with or without fee"),
    ("apache-2", "licensed under the apache", "licensed under the apache license version 2 0 the license you may not use this file"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "neither the name", "neither the name of .{1,80} nor the names of its contributors may be used to endorse"),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu"),
    ("gpl-2", "free software foundation", "published by the free software foundation either version 2 of the license"),
    ("gpl-3", "free software foundation", "published by the free software foundation either version 3 of the license"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", "(released|dedicated|placed) (in|into|to) the public domain"),
    ("public-domain", "public domain", "(is|are) in the public domain"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    ("proprietary", "proprietary and confidential", "proprietary and confidential"),
    ("proprietary", "without the prior written", "without the prior written (permission|consent)"),
    ("proprietary", "unauthorized", "unauthorized (copying|reproduction|distribution)( or .{1,40})? is (strictly )?prohibited"),
    ("zlib", "provided as is", "this software is provided as is without any express or implied warranty in no event will the authors"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("wtfpl", "what the", "do what the fuck you want to( public license)?"),
    ("boost", "boost", "distributed under the boost software license version 1 0"),
    ("unknown", "see the licen", "see the licen[cs]e( file)? for (the )?(more )?(details|information)"),
    ("unknown", "see licen", "see licen[cs]e( md| txt)? (file )?for (details|information)"),
]

#: Web addresses, as words.
ADDRESSES: list[tuple[str, str, str]] = [
    ("apache-2", "apache", "apache org licenses license 2 0( html| txt)?"),
    ("gpl-3", "gnu", "gnu org licenses gpl 3 0( en)?( html)?"),
    ("gpl-2", "gnu", "gnu org licenses (old licenses )?gpl 2 0( en)?( html)?"),
    ("gpl", "gnu", "gnu org licenses gpl( html)?"),
    ("lgpl", "gnu", "gnu org licenses lgpl( html)?"),
    ("agpl", "gnu", "gnu org licenses agpl( html)?"),
    ("mit", "opensource", "opensource org licenses mit( license)?( php)?"),
    ("bsd-3", "opensource", "opensource org licenses bsd 3 clause"),
    ("bsd-2", "opensource", "opensource org licenses bsd 2 clause"),
    ("isc", "opensource", "opensource org licenses isc"),
    ("mpl-2", "mozilla", "mozilla org mpl 2 0"),
    ("epl-2", "eclipse", "eclipse org legal epl 2 0"),
    ("cc0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("ofl-1-1", "sil", "scripts sil org ofl"),
    ("bsl-1", "boost", "boost org license 1 0( txt)?"),
    ("odbl-1", "opendatacommons", "opendatacommons org licenses odbl"),
    ("unlicense", "unlicense", "unlicense org"),
]


def rules() -> list[Rule]:
    """All rules in order; every match of a rule holds its keyword. Priorities: 0 tags, 1 sentences and addresses, 2 notices, 3 names, 4 hints."""
    out: list[Rule] = []
    for label, _, _, tag in FAMILIES:
        for own in (tag,) if isinstance(tag, str) else tag or ():
            out.append(Rule(label, f"spdx license identifier ({own})", "spdx", 0, 1.0))
            out.append(Rule(label, f"(license|licence|licenses) ({own})", own.split()[0], 2, 0.8))
    for kind in CC_KINDS:
        parts = kind.split()
        name = " ".join(CC_ELEMENTS[p] for p in parts)
        plain = "cc-" + "-".join(parts)
        for version in CC_VERSIONS:
            label = f"{plain}-{version.replace(' 0', '').replace(' ', '-')}"
            out.append(Rule(label, f"cc {kind} {version}", f"cc {kind}", 2, 0.95))
            out.append(Rule(label, f"creative commons {kind} {version}", "creative commons", 2, 0.95))
            out.append(Rule(label, f"creativecommons org licenses {kind} {version}", "creativecommons", 1, 1.0))
            out.append(Rule(label, f"creative commons {name} {version}", "creative commons", 2, 0.95))
        out.append(Rule(plain, f"cc {kind}", f"cc {kind}", 3, 0.7))
        out.append(Rule(plain, f"creative commons {kind}", "creative commons", 3, 0.7))
        out.append(Rule(plain, f"creative commons {name}( licen[cs]e)?", "creative commons", 3, 0.8))
    out += [Rule(label, pattern, keyword, 1, 1.0) for label, keyword, pattern in SENTENCES]
    out += [Rule(label, pattern, keyword, 1, 0.95) for label, keyword, pattern in ADDRESSES]
    for label, keyword, name, _ in FAMILIES:
        out.append(Rule(label, f"(licensed|released|distributed|available|published|provided) under (the )?(terms of )?(the )?{name}", keyword, 2, 0.95))
        out.append(Rule(label, f"(under|with) (the )?{name}", keyword, 2, 0.85))
        out.append(Rule(label, name, keyword, 3, 0.6))
    out.append(Rule("unknown", "(licensed|released|distributed) under( the)?( [^ ]+){1,4} licen[cs]e", "licen", 4, 0.4))
    return out


#: What a text must have for any rule or phrase to match: every rule's matches and the base phrases hold one
#: of these, in lower-case words with one space around them.
HINTS = [
    "licens", "licenc", "spdx", " mit ", "apache", "general public", "creative commons", "creativecommons", " cc ", " cc0", "public domain", "rights reserved",
    "proprietary", "unauthori", "prior written", "permission", "redistribution", "unencumbered", " gnu ", "opensource", "mozilla", "eclipse", " sil org", "boost",
    "opendatacommons", "wtfpl", "free software", "what the fuck", "neither the name", "provided as", "source code form", "bsd", "affero", "openrail",
]


def words_column(text: Column) -> Column:
    """The text's words, case kept, one space between and around them; one space if it has none."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS, " ")
    return F.concat(F.lit(" "), F.trim(inner), F.lit(" "))


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _intervals(words: Column, pattern: Column) -> Column:
    """Word intervals (first, end) of a pattern's matches; words stand between single spaces."""
    bounded = F.concat(F.lit("(?<= )("), pattern, F.lit(")(?= )"))
    found = F.transform(F.regexp_extract_all(words, bounded, F.lit(0)), lambda m: _spaces(m) + 1)

    def spans(s: Column) -> Column:
        # The piece after a match begins with the space that separates its first word.
        ends = running(F.transform(s, lambda x: (x["b"] - 1 + x["m"]).cast("long")))
        return let(ends, lambda e: F.transform(s, lambda x, i: F.struct((F.get(e, i) - x["m"]).alias("first"), F.get(e, i).alias("end"))))

    def located(f: Column) -> Column:
        between = F.transform(F.split(words, bounded), _spaces)
        return let(F.filter(F.arrays_zip(between.alias("b"), f.alias("m")), lambda x: x["m"].isNotNull()), spans)

    # Most rules that pass their gate match nothing, and their text isn't split.
    none = F.expr("cast(array() as array<struct<first: bigint, end: bigint>>)")
    return let(found, lambda f: F.when(F.size(f) > 0, located(f)).otherwise(none))


DETECTION = "array<struct<first: bigint, upto: bigint, priority: int, rule: int, label: string, confidence: double>>"


def detections(words: Column, table: list[Rule]) -> Column:
    """All rules' matches, each rule run only where its keyword stands."""
    rows = [{"rule": i, "label": r.label, "pattern": r.pattern, "keyword": r.keyword, "priority": r.priority, "confidence": r.confidence} for i, r in enumerate(table)]
    # One literal that is folded when the plan is made; hundreds of them would take longer to plan than to run.
    literal = F.from_json(F.lit(json.dumps(rows)), "array<struct<rule: int, label: string, pattern: string, keyword: string, priority: int, confidence: double>>")
    hit = F.filter(literal, lambda r: F.contains(words, r["keyword"]))

    def of(r: Column) -> Column:
        return F.transform(
            _intervals(words, r["pattern"]),
            lambda s: F.struct(s["first"].alias("first"), s["end"].alias("upto"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"), r["confidence"].alias("confidence")),
        )

    return F.flatten(F.transform(hit, of))


def suppress(found: Column, priorities: int = 5) -> Column:
    """Drops detections within another's interval whose priority is the same or better.

    In the order of start, longer first, better first, an interval lies within an earlier one just if some
    earlier end of such a priority reaches its end; a running greatest end for each priority decides that.
    """
    rank = F.transform(found, lambda d: F.struct(d["first"].alias("first"), (-d["upto"]).alias("back"), d["priority"].alias("priority"), d["rule"].alias("rule"), d["label"].alias("label"), d["confidence"].alias("confidence")))
    ordered = F.array_sort(rank)

    def outer(o: Column) -> Column:
        def ends(least: int) -> Column:
            return F.transform(o, lambda d: F.when(d["priority"] <= least, -d["back"]).otherwise(-1))

        reach = F.array(*[running(ends(p), F.greatest) for p in range(priorities)])
        return let(reach, lambda r: F.filter(o, lambda d, i: F.coalesce(F.get(F.get(r, d["priority"]), i - 1) < -d["back"], F.lit(True))))

    kept = let(ordered, outer)
    return F.transform(kept, lambda d: F.struct(d["first"].alias("first"), (-d["back"]).alias("upto"), d["priority"].alias("priority"), d["rule"].alias("rule"), d["label"].alias("label"), d["confidence"].alias("confidence")))


def scan(docs: DataFrame, table: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, base, detections)``: base phrases' intervals with labels, and the rules' kept detections."""
    table = rules() if table is None else table
    rows = docs.select(F.col(id_col).alias("doc_id"), words_column(F.col(text_col)).alias("w"))
    n_words = F.when(F.col("w") == "  ", 0).otherwise(_spaces(F.col("w")) - 1)
    rows = rows.select("doc_id", n_words.cast("long").alias("n_words"), F.translate("w", string.ascii_uppercase, string.ascii_lowercase).alias("low"))
    hinted = reduce(lambda a, b: a | b, [F.contains("low", F.lit(h)) for h in HINTS])
    rows = rows.select("doc_id", "n_words", F.when(hinted, F.col("low")).alias("w"))
    w = F.col("w")

    def named(phrase: str, label: str) -> Column:
        return F.transform(_intervals(w, F.lit(phrase)), lambda s: F.struct(s["first"].alias("first"), s["end"].alias("upto"), F.lit(label).alias("label")))

    phrases = F.flatten(F.array(*[named(p, label) for p, label in BASE.items()]))
    none = "cast(array() as array<struct<first: bigint, upto: bigint, label: string>>)"
    return rows.select(
        "doc_id",
        "n_words",
        F.when(w.isNotNull(), phrases).otherwise(F.expr(none)).alias("base"),
        F.when(w.isNotNull(), suppress(detections(w, table))).otherwise(F.expr(f"cast(array() as {DETECTION})")).alias("detections"),
    )


def labelled(found: DataFrame) -> DataFrame:
    """The digest of :func:`scan`: places, labels and a score, the best confidence of a detection."""
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    base = F.transform("base", lambda b: b["label"])
    every = F.concat(base, F.transform("detections", lambda d: d["label"]))
    best = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)), F.when(F.size("base") > 0, 0.9).otherwise(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["first"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(every).alias("labels"),
        best.alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
