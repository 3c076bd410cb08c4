"""License detection by ordered signature rules with keyword gates. DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before that, and its complement.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Priorities: base phrases, names, versioned names and notices, machine-readable tags.
BASE, NAME, VERSION, TAG = range(4)


@dataclass(frozen=True)
class Rule:
    """A signature over tokens: each word of a text is written with a space on either side, so ` mit  license ` is two words.

    keyword: a word of the family's names. What a text must have for the rule to run is gate_word's.
    """

    label: str
    keyword: str
    pattern: str
    priority: int


def tokens(words: str) -> str:
    return "".join(f" {w} " for w in words.split())


def _any(*options: str) -> str:
    return options[0] if len(options) == 1 else "(?:" + "|".join(options) + ")"


def _version(version: str) -> str:
    """version 2.0, v2.0, 2.0 and, for .0, also version 2."""
    major, *minor = version.split(".")
    rest = "".join(f"(?: {m} )?" if m == "0" else f" {m} " for m in minor)
    return f"(?:(?: version | v |)(?: {major} )| v{major} ){rest}"


#: Base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Families: label, keyword, names, versions. A name has keyword among its words.
FAMILIES = (
    ("gpl", "gnu", ("gnu general public licen[cs]e", "gnu gpl"), ("1.0", "2.0", "3.0")),
    ("gpl", "gpl", ("gpl",), ("1.0", "2.0", "3.0")),
    ("lgpl", "lesser", ("(?:gnu  )?lesser general public licen[cs]e",), ("2.1", "3.0")),
    ("lgpl", "library", ("(?:gnu  )?library general public licen[cs]e",), ("2.0",)),
    ("lgpl", "lgpl", ("lgpl",), ("2.0", "2.1", "3.0")),
    ("agpl", "affero", ("(?:gnu  )?affero general public licen[cs]e",), ("1.0", "3.0")),
    ("agpl", "agpl", ("agpl",), ("1.0", "3.0")),
    ("gfdl", "documentation", ("gnu free documentation licen[cs]e",), ("1.1", "1.2", "1.3")),
    ("apache", "apache", ("apache(?:  software)? licen[cs]e", "apache"), ("1.0", "1.1", "2.0")),
    ("mpl", "mozilla", ("mozilla public licen[cs]e",), ("1.0", "1.1", "2.0")),
    ("mpl", "mpl", ("mpl",), ("1.0", "1.1", "2.0")),
    ("epl", "eclipse", ("eclipse public licen[cs]e",), ("1.0", "2.0")),
    ("cddl", "distribution", ("common development and distribution licen[cs]e",), ("1.0", "1.1")),
    ("cpl", "common", ("common public licen[cs]e",), ("1.0",)),
    ("eupl", "eupl", ("eupl",), ("1.0", "1.1", "1.2")),
    ("eupl", "european", ("european union public licen[cs]e",), ("1.0", "1.1", "1.2")),
    ("artistic", "artistic", ("artistic licen[cs]e",), ("1.0", "2.0")),
    ("bsl", "boost", ("boost software licen[cs]e",), ("1.0",)),
    ("afl", "academic", ("academic free licen[cs]e",), ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("osl", "open", ("open software licen[cs]e",), ("1.0", "1.1", "2.0", "2.1", "3.0")),
    ("ofl", "font", ("sil open font licen[cs]e", "open font licen[cs]e"), ("1.0", "1.1")),
    ("apsl", "apple", ("apple public source licen[cs]e",), ("1.0", "1.1", "1.2", "2.0")),
    ("cecill", "cecill", ("cecill",), ("1.0", "1.1", "2.0", "2.1")),
    ("lppl", "latex", ("latex project public licen[cs]e",), ("1.0", "1.1", "1.2", "1.3")),
    ("zpl", "zope", ("zope public licen[cs]e",), ("1.1", "2.0", "2.1")),
    ("php", "php", ("php licen[cs]e",), ("3.0", "3.01")),
    ("python", "python", ("python(?:  software  foundation)? licen[cs]e",), ("2.0",)),
    ("ecl", "educational", ("educational community licen[cs]e",), ("1.0", "2.0")),
    ("upl", "universal", ("universal permissive licen[cs]e",), ("1.0",)),
    ("mit", "mit", ("mit licen[cs]e", "mit"), ()),
    ("isc", "isc", ("isc licen[cs]e", "isc"), ()),
    ("zlib", "zlib", ("zlib(?:  libpng)? licen[cs]e", "zlib"), ()),
    ("ncsa", "ncsa", ("university of illinois ncsa open source licen[cs]e", "ncsa"), ()),
    ("unlicense", "unlicense", ("unlicense",), ()),
    ("wtfpl", "wtfpl", ("wtfpl",), ()),
    ("postgresql", "postgresql", ("postgresql licen[cs]e", "postgresql"), ()),
    ("openssl", "openssl", ("openssl licen[cs]e", "openssl"), ()),
    ("ms-pl", "microsoft", ("microsoft public licen[cs]e",), ()),
    ("ms-rl", "microsoft", ("microsoft reciprocal licen[cs]e",), ()),
    ("w3c", "w3c", ("w3c(?:  software)?(?:  notice  and)? licen[cs]e", "w3c"), ()),
    ("vim", "vim", ("vim licen[cs]e",), ()),
    ("sleepycat", "sleepycat", ("sleepycat licen[cs]e", "sleepycat"), ()),
    ("qpl", "q", ("q public licen[cs]e",), ("1.0",)),
)


#: Words of a name that a license's text leaves open.
SOMEONE = "(?: [^ ]+ ){1,10}"

#: Passages of the licenses' own texts and of the notices that they ask for: label, keyword, words, with ... for an open name.
PASSAGES = (
    ("apache-2.0", "compliance", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "january", "apache license version 2 0 january 2004"),
    ("apache", "agreed", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("mpl-2.0", "form", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "contents", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1.0", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cddl", "contents", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("bsl-1.0", "organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", "damages", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("mit", "substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "merchantability", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("isc", "disclaims", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("bsd-3-clause", "endorse", "neither the name of ... nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "acknowledgement", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "warranties", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("cc0", "waived", "to the extent possible under law ... has waived all copyright and related or neighboring rights"),
    ("cc0", "deed", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license version 1 1"),
    ("gpl-2.0", "june", "gnu general public license version 2 june 1991"),
    ("gpl-3.0", "june", "gnu general public license version 3 29 june 2007"),
    ("lgpl-2.1", "february", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3.0", "june", "gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3.0", "november", "gnu affero general public license version 3 19 november 2007"),
    ("gfdl", "copyleft", "this license is a kind of copyleft which means that derivative works of the document must themselves be free in the same sense"),
    ("artistic", "artistic", "the artistic license preamble the intent of this document is to state the conditions under which a package may be copied"),
    ("ncsa", "contributors", "neither the names of ... nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("openssl", "toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("php", "php", "this product includes php software freely available from"),
    ("ecl-2.0", "educational", "licensed under the educational community license version 2 0"),
    ("proprietary", "unauthorized", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "confidential", "this software is the confidential and proprietary information of"),
)

#: Licenses of one publisher that share a notice: label, keyword, name, versions.
PUBLISHED = (("gpl", "foundation", "gnu general public license", ("2", "3")), ("lgpl", "lesser", "gnu lesser general public license", ("2.1", "3")), ("lgpl", "library", "gnu library general public license", ("2",)), ("agpl", "affero", "gnu affero general public license", ("3",)))


def rules() -> list[Rule]:
    """The rules in order: base phrases first, then each family's names, versions, notices and tags, then passages of license texts."""
    out = [Rule(label, phrase.split()[0], tokens(phrase), BASE) for phrase, label in PHRASES]
    notice = tokens("(?:licensed|released|distributed|available)") + tokens("under") + "(?:" + tokens("the") + "|" + tokens("a") + "|)(?:" + tokens("terms") + tokens("of") + "(?:" + tokens("the") + "|)|)"
    tag = tokens("spdx license identifier")
    later = "(?:" + tokens("or") + "(?:" + tokens("at") + tokens("your") + tokens("option") + "|)(?:" + tokens("any") + "|)" + tokens("later") + "(?:" + tokens("version") + "|))"

    def family(label: str, keyword: str, named: str, plain: str | None, versions: tuple[str, ...], tag_name: str) -> None:
        if plain:
            out.append(Rule(label, keyword, plain, NAME))
        out.append(Rule(label, keyword, notice + named, VERSION))
        out.append(Rule(label, keyword, tag + tag_name, TAG))
        for v in versions:
            exact = f"{label}-{v}"
            out.append(Rule(exact, keyword, named + _version(v), VERSION))
            out.append(Rule(exact, keyword, tag + tag_name + _version(v) + "(?: only )?", TAG))
            if label.endswith("gpl"):
                out.append(Rule(f"{exact}-or-later", keyword, named + _version(v) + later, VERSION))
                out.append(Rule(f"{exact}-or-later", keyword, tag + tag_name + _version(v) + tokens("or later"), TAG))

    for label, keyword, names, versions in FAMILIES:
        named = _any(*(tokens(n) for n in names))
        # A bare word such as apache or mit is a name only with a version, notice or tag.
        plain = [tokens(n) for n in names if " " in n or n in ("gpl", "lgpl", "agpl", "mpl", "eupl", "cecill", "unlicense", "wtfpl")]
        family(label, keyword, named, _any(*plain) if plain else None, versions, tokens(names[-1]) if " " not in names[-1] else tokens(label.replace("-", " ")))
    for kind in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        long = kind.replace("by", "attribution").replace("sa", "(?:sharealike|share  alike)").replace("nc", "(?:noncommercial|non  commercial)").replace("nd", "(?:noderivs|noderivatives|no  derivatives)")
        label, versions = "cc-" + kind.replace(" ", "-"), ("1.0", "2.0", "2.5", "3.0", "4.0")
        family(label, "cc", tokens("cc " + kind), tokens("cc " + kind), versions, tokens("cc " + kind))
        family(label, "commons", tokens("creative commons " + long), tokens("creative commons " + long), versions, tokens("creative commons " + long))
    for n in range(5):
        clause = tokens(f"{n} clause")
        family(f"bsd-{n}-clause", "bsd", _any(tokens("bsd") + clause, tokens(f"{n} clause bsd")) + "(?: licen[cs]e )?", _any(tokens("bsd") + clause, clause + tokens("bsd")), (), tokens("bsd") + clause)
    out += [
        Rule("bsd", "bsd", tokens("bsd licen[cs]e"), NAME),
        Rule("cc0", "cc0", tokens("cc0") + "(?: 1  0 )?", NAME),
        Rule("cc0", "cc0", tag + tokens("cc0") + " 1  0 ", TAG),
        Rule("public-domain", "domain", tokens("public domain"), NAME),
        Rule("mit", "permission", tokens("permission is hereby granted free of charge to any person obtaining a copy"), VERSION),
        Rule("bsd", "redistribution", tokens("redistribution and use in source and binary forms with or without modification"), VERSION),
        Rule("isc", "permission", tokens("permission to use copy modify and or distribute this software for any purpose"), VERSION),
        Rule("proprietary", "rights", tokens("all rights reserved"), NAME),
    ]
    for label, keyword, words in PASSAGES:
        before, _, after = words.partition(" ... ")
        out.append(Rule(label, keyword, tokens(before) + (SOMEONE + tokens(after) if after else ""), VERSION))
    for label, keyword, name, versions in PUBLISHED:
        notice = tokens(f"redistribute it and or modify it under the terms of the {name} as published by the free software foundation")
        out.append(Rule(label, keyword, notice, NAME))
        for v in versions:
            exact = notice + "(?: either )?" + tokens("version " + v.replace(".", " ")) + "(?:" + tokens("of the license") + ")?"
            full = f"{label}-{v if '.' in v else v + '.0'}"
            out.append(Rule(full, keyword, exact, VERSION))
            out.append(Rule(f"{full}-or-later", keyword, exact + later, VERSION))
    return out


RULES = rules()
#: A text with none of these has no keyword's rules to run; each keyword's rules hold one of them.
GATES = ("licen", "gpl", "cc", "apache", "mozilla", "mpl", "eupl", "cecill", "bsd", "commons", "domain", "permission", "redistribution", "rights", "spdx", "wtfpl", "released", "distributed", "available", "provided", "liable", "origin", "copyright", "advertising", "neither", "unauthorized", "proprietary", "foundation", "product", "intent")


def gate_word(rule: Rule) -> str:
    """A word that every match of rule holds. A tag has the family's short label, which may lack the name's keyword."""
    return "spdx" if rule.priority == TAG else rule.keyword


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def license_scan(docs: DataFrame) -> DataFrame:
    """Finds license phrases and signatures in each whole text.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. Only texts with a gate
    word are split into tokens, and only rules whose gate_word they have are run on them. A detection is suppressed if its interval of words
    lies within one of higher priority, or of the same priority and longer (of equal ones the first rule's stays).
    labels are those of the detections that stay and of all base places; score is the best detection's confidence,
    a quarter for a base phrase up to 1 for a machine-readable tag, and 0 without any.

    Equal texts are resolved once. The text is not shuffled: what leaves the scan is a list of gaps and lengths
    for each rule that matched. Null text is empty: no words, no places, empty labels. Repeated rows give equal
    rows; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.translate(text, UPPER, LOWER)
    # Each word between two spaces of its own, so that signatures of words side by side don't share a space.
    marked = F.regexp_replace(F.concat(F.lit("-"), low, F.lit("-")), BETWEEN, "  ")
    rows = docs.select("doc_id", text.alias("text"), F.lower(text).alias("_low"))
    gate = F.lit(False)
    for g in GATES:
        gate = gate | F.contains("_low", F.lit(g))
    rows = rows.select("doc_id", F.regexp_count("text", F.lit(ANY_WORD)).cast("long").alias("n_words"), F.when(gate, F.struct(marked.alias("m"), F.md5("text").alias("key"))).alias("_m"))
    # A generator keeps the optimizer from computing the marked text again for every rule.
    rows = rows.select("doc_id", "n_words", F.explode(F.array("_m")).alias("_m")).select("doc_id", "n_words", F.col("_m.key").alias("key"), F.expr("substring(_m.m, 2, length(_m.m) - 2)").alias("norm"))
    by_keyword: dict[str, list[int]] = {}
    for i, r in enumerate(RULES):
        by_keyword.setdefault(gate_word(r), []).append(i)
    known = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*[F.struct(F.lit(i).alias("i"), F.lit(RULES[i].pattern).alias("p")) for i in ids]).alias("r")) for k, ids in by_keyword.items()])
    usable = F.flatten(F.transform(F.filter(known, lambda k: F.contains(F.col("norm"), F.concat(F.lit(" "), k["k"], F.lit(" ")))), lambda k: k["r"]))
    matching = F.filter(usable, lambda r: F.rlike("norm", r["p"]))
    gaps = lambda r: F.transform(F.split(F.col("norm"), r["p"], -1), lambda x: (_spaces(x) / 2).cast("int"))
    lengths = lambda r: F.transform(F.regexp_extract_all("norm", r["p"], F.lit(0)), lambda x: (_spaces(x) / 2).cast("int"))
    rows = rows.withColumn("hits", F.when(F.col("norm").isNotNull(), F.transform(matching, lambda r: F.struct(r["i"].alias("rule"), gaps(r).alias("gaps"), lengths(r).alias("lengths")))))
    scanned = written(rows.select("doc_id", "n_words", "key", "hits"), "scanned")
    found = scanned.filter(F.size("hits") > 0).groupBy("key").agg(F.any_value("hits").alias("hits"))
    found = found.select("key", F.explode("hits").alias("h")).select("key", "h.rule", F.posexplode(F.arrays_zip(F.col("h.gaps").alias("gap"), F.col("h.lengths").alias("len"))).alias("no", "x"))
    found = found.filter("x.len is not null").select("key", "rule", "no", F.col("x.gap").alias("gap"), F.col("x.len").alias("len"))
    before = Window.partitionBy("key", "rule").orderBy("no")
    found = found.withColumn("start", (F.sum("gap").over(before) + F.sum("len").over(before) - F.col("len")).cast("long")).withColumn("end", F.col("start") + F.col("len"))
    of_rule = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("rule") + 1)
    found = found.withColumn("label", of_rule([r.label for r in RULES])).withColumn("priority", of_rule([r.priority for r in RULES]))
    ahead = Window.partitionBy("key").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.element_at(F.array(*[F.max(F.when(F.col("priority") >= p, F.col("end"))).over(ahead) for p in range(TAG + 1)]), F.col("priority") + 1)
    found = found.withColumn("kept", F.coalesce(reach < F.col("end"), F.lit(True)))
    base = F.col("priority") == BASE
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per = found.groupBy("key").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.when(base | F.col("kept"), F.col("label"))).alias("labels"), F.max(F.when(F.col("kept"), (F.col("priority") + 1) / (TAG + 1))).alias("score"),
    )
    # Texts without a hit, most of them, stay out of the join; per is written, so that a text with many copies can be split there.
    n_hits = F.coalesce(F.size("hits"), F.lit(0))
    per = written(per, "found")
    out = scanned.filter(n_hits > 0).select("doc_id", "n_words", "key").join(per, "key")
    none = [F.lit(None).cast(kind).alias(c) for c, kind in per.dtypes if c != "key"]
    out = out.drop("key").unionByName(scanned.filter(n_hits <= 0).select("doc_id", "n_words", *none))
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def oracle() -> str:
    """The same in DuckDB's SQL: every rule on every text, without gates, then windows."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(r.label)}, {quoted(r.pattern)}, {r.priority})" for i, r in enumerate(RULES))
    spaces = lambda x: f"((length({x}) - length(replace({x}, ' ', ''))) // 2)"
    reach = " ".join(f"when {p} then max(case when priority >= {p} then stop end) over ahead" for p in range(TAG + 1))
    return rf"""
with rules(rule, label, pattern, priority) as (values {values}),
texts as (select distinct coalesce(text, '') as text from documents),
marked as (select text, norm[2:length(norm) - 1] as norm from (select text, regexp_replace('-' || translate(text, '{UPPER}', '{LOWER}') || '-', '{BETWEEN}', '  ', 'g') as norm from texts)),
hits as (select text, rule, label, priority, list_transform(string_split_regex(norm, pattern), lambda x: {spaces("x")}) as gaps, list_transform(regexp_extract_all(norm, pattern, 0), lambda x: {spaces("x")}) as lens
  from marked, rules where regexp_matches(norm, pattern)),
places as (select text, rule, label, priority, unnest(range(1, len(lens) + 1)) as no, gaps, lens from hits),
found as (select text, rule, label, priority, gap_sum + len_sum - len as start, gap_sum + len_sum as stop from (
  select text, rule, label, priority, lens[no] as len, sum(gaps[no]) over w as gap_sum, sum(lens[no]) over w as len_sum from places window w as (partition by text, rule order by no))),
judged as (select *, coalesce(case priority {reach} end < stop, true) as kept from found
  window ahead as (partition by text order by start, stop desc, priority desc, rule rows between unbounded preceding and 1 preceding)),
per as (select text, count(*) filter (priority = 0) as n_base, min(start) filter (priority = 0) as first_word, max(start) filter (priority = 0) as last_word,
  array_to_string(list_sort(list_distinct(list(label) filter (priority = 0))), ',') as base_labels, array_to_string(list_sort(list_distinct(list(label) filter (priority = 0 or kept))), ',') as labels,
  max((priority + 1) / 4.0) filter (kept) as score from judged group by text)
select doc_id, cast(len(regexp_extract_all(coalesce(d.text, ''), '{ANY_WORD}')) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(cast(score as double), 0.0::double) as score
from documents d left join per on coalesce(d.text, '') = per.text"""
