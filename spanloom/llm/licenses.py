"""License scans: ordered signature rules behind keyword gates, with containment suppression.

Everything is Column expressions. A text is brought to a line of lower-case words, two blanks
between words and one at either end, so that every pattern owns one blank on each side and
neighbouring matches never share a character. A rule's regular expression runs only where its
keyword, a stem that all its matches hold, occurs. Each match is a detection with an interval of words; a detection that lies in the
interval of one of higher priority is suppressed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm._base import table

#: Bytes between words, once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


#: Starts of words that tell a license text from other prose, most telling first.
_TELLING = (
    "spdx", "creativecommons", "unlicense", "licen", "copyright", "redistribut", "unauthorized", "endorse", "reproduced", "proprietary", "warrant",
    "permission", "reserved", "domain", "creative", "gpl", "cddl", "wtfpl", "cc0", "bsd", "lppl", "cc  by",
)


def _anchors(pattern: str) -> list[str]:
    """Starts of words that every match of `pattern` holds, most telling first; groups count as unknown."""
    if pattern.startswith("(?:") and pattern.index(")") == len(pattern) - 1:
        first, *rest = (_anchors(x) for x in pattern[3:-1].split("|"))
        return [a for a in first if all(a in r for r in rest)]
    plain = pattern
    while (inner := re.sub(r"\(\?:[^()]*\)[?*]?", " @ ", plain)) != plain:
        plain = inner
    words = [w for w in (re.split(r"[\[\].{?*]", w)[0] for w in plain.split()) if w != "@"]
    text = " " + "  ".join(words)
    return [a for a in _TELLING if " " + a in text] + sorted((w for w in words if len(w) > 5), key=len, reverse=True)


def _literal_run(pattern: str) -> str:
    """Longest run of plain words that every match of `pattern` holds, as in a normalized text; empty for alternatives."""
    plain = pattern
    while (inner := re.sub(r"\(\?:[^()]*\)[?*]?", " @ ", plain)) != plain:
        plain = inner
    runs = [[]]
    for w in plain.split():
        start = re.split(r"[\[\].{?*@]", w)[0]
        if start:
            runs[-1].append(start)
        if start != w:
            runs.append([])
    return max(("  ".join(r) for r in runs), key=len)


@dataclass(frozen=True)
class Rule:
    """`pattern` is written with one blank between words; higher `priority` suppresses lower.

    A rule is tried on texts that hold a word starting with `anchor`, and the words `literal`.
    """

    label: str
    pattern: str
    priority: int
    weight: float
    anchor: str
    literal: str

    @property
    def regex(self) -> str:
        return " " + self.pattern.replace(" ", "  ") + " "


# Label, name, short identifier, address; all in words as the scan sees them.
_LICENSES = """
mit | mit license | mit | opensource org licenses mit
mit-0 | mit no attribution(?: license)? | mit 0 | opensource org licenses mit 0
apache-1.1 | apache(?: software)? license(?: version)? 1 1 | apache 1 1 | apache org licenses license 1 1
apache-2.0 | apache(?: software)? license(?: version| v)? 2(?: 0)? | apache 2 0 | apache org licenses license 2 0
gpl-1.0 | gpl(?: version)? 1 | gpl 1 0(?: only| or later)? | gnu org licenses old licenses gpl 1 0
gpl-2.0 | (?:gnu )?general public license(?: version| v)? 2(?: 0)? | gpl 2 0(?: only| or later)? | gnu org licenses old licenses gpl 2 0
gpl-3.0 | (?:gnu )?general public license(?: version| v)? 3(?: 0)? | gpl 3 0(?: only| or later)? | gnu org licenses gpl 3 0
lgpl-2.0 | (?:gnu )?library general public license(?: version)?(?: 2(?: 0)?)? | lgpl 2 0(?: only| or later)? | gnu org licenses old licenses lgpl 2 0
lgpl-2.1 | (?:gnu )?lesser general public license(?: version| v)? 2 1 | lgpl 2 1(?: only| or later)? | gnu org licenses old licenses lgpl 2 1
lgpl-3.0 | (?:gnu )?lesser general public license(?: version| v)? 3(?: 0)? | lgpl 3 0(?: only| or later)? | gnu org licenses lgpl 3 0
agpl-3.0 | (?:gnu )?affero general public license(?: version| v)?(?: 3(?: 0)?)? | agpl 3 0(?: only| or later)? | gnu org licenses agpl 3 0
gfdl-1.1 | (?:gnu )?free documentation license version 1 1 | gfdl 1 1(?: only| or later)? | gnu org licenses old licenses fdl 1 1
gfdl-1.2 | (?:gnu )?free documentation license version 1 2 | gfdl 1 2(?: only| or later)? | gnu org licenses old licenses fdl 1 2
gfdl-1.3 | (?:gnu )?free documentation license(?: version 1 3)? | gfdl 1 3(?: only| or later)? | gnu org licenses fdl 1 3
bsd-1-clause | bsd 1 clause license | bsd 1 clause | spdx org licenses bsd 1 clause
bsd-2-clause | (?:simplified bsd license|bsd 2 clause license|freebsd license) | bsd 2 clause | opensource org licenses bsd 2 clause
bsd-3-clause | (?:modified bsd license|new bsd license|bsd 3 clause license|revised bsd license) | bsd 3 clause | opensource org licenses bsd 3 clause
bsd-4-clause | (?:original bsd license|bsd 4 clause license) | bsd 4 clause | spdx org licenses bsd 4 clause
isc | isc license | isc | opensource org licenses isc
zlib | zlib(?: libpng)? license | zlib | opensource org licenses zlib
bsl-1.0 | boost software license(?: version)?(?: 1 0)? | bsl 1 0 | boost org license 1 0
mpl-1.1 | mozilla public license(?: version| v)? 1 1 | mpl 1 1 | mozilla org mpl 1 1
mpl-2.0 | mozilla public license(?: version| v)?(?: 2(?: 0)?)? | mpl 2 0 | mozilla org mpl 2 0
epl-1.0 | eclipse public license(?: version| v)? 1(?: 0)? | epl 1 0 | eclipse org legal epl v10
epl-2.0 | eclipse public license(?: version| v)?(?: 2(?: 0)?)? | epl 2 0 | eclipse org legal epl 2 0
cddl-1.0 | cddl(?: version)? 1 0 | cddl 1 0 | opensource org licenses cddl 1 0
cddl-1.1 | common development and distribution license(?: version)?(?: 1 [01])? | cddl 1 1 | spdx org licenses cddl 1 1
cpl-1.0 | common public license(?: version)?(?: 1 0)? | cpl 1 0 | opensource org licenses cpl 1 0
eupl-1.1 | european union public licen[cs]e(?: version| v)? 1 1 | eupl 1 1 | spdx org licenses eupl 1 1
eupl-1.2 | european union public licen[cs]e(?: version| v)?(?: 1 2)? | eupl 1 2 | spdx org licenses eupl 1 2
artistic-1.0 | artistic license 1 0 | artistic 1 0 | opensource org licenses artistic 1 0
artistic-2.0 | artistic license(?: 2 0)? | artistic 2 0 | opensource org licenses artistic 2 0
python-2.0 | python software foundation license(?: version 2)? | psf 2 0 | docs python org license
php-3.01 | php license(?: version)?(?: 3 01?)? | php 3 01 | php net license 3 01
ruby | ruby license | ruby | ruby lang org license
openssl | openssl license | openssl | openssl org source license
postgresql | postgresql licen[cs]e | postgresql | opensource org licenses postgresql
ncsa | university of illinois(?: ncsa)? open source license | ncsa | opensource org licenses ncsa
ofl-1.1 | sil open font license(?: version)?(?: 1 1)? | ofl 1 1 | scripts sil org ofl
unlicense | (?:the )?unlicense | unlicense | unlicense org
wtfpl | wtfpl(?: version)?(?: 2)? | wtfpl | wtfpl net
0bsd | (?:zero clause bsd|bsd zero clause license) | 0bsd | opensource org licenses 0bsd
ms-pl | microsoft public license | ms pl | opensource org licenses ms pl
ms-rl | microsoft reciprocal license | ms rl | opensource org licenses ms rl
cc0-1.0 | cc0(?: version)?(?: 1 0)?(?: universal)? | cc0 1 0 | creativecommons org publicdomain zero 1 0
odbl-1.0 | open (?:data commons open )?database license(?: odbl)?(?: 1 0)? | odbl 1 0 | opendatacommons org licenses odbl
pddl-1.0 | open data commons public domain dedication(?: and)? license | pddl 1 0 | opendatacommons org licenses pddl
lppl-1.3c | latex project public license(?: version)?(?: 1 3c)? | lppl 1 3c | latex project org lppl
osl-3.0 | open software license(?: version)?(?: 3 0)? | osl 3 0 | opensource org licenses osl 3 0
busl-1.1 | business source license(?: 1 1)? | busl 1 1 | mariadb com bsl11
sspl-1.0 | server side public license(?: version)?(?: 1)? | sspl 1 0 | mongodb com licensing server side public license
elastic-2.0 | elastic license(?: 2 0)? | elastic 2 0 | elastic co licensing elastic license
"""

# Label, pattern, priority, weight of signatures that are phrases of license texts.
_PHRASES = """
mit | permission is hereby granted free of charge to any person obtaining a copy | 5 | 1
isc | permission to use copy modify and or distribute this software for any purpose | 5 | 1
bsd | redistribution and use in source and binary forms with or without modification | 5 | 0.9
bsd | redistributions of source code must retain the above copyright notice | 4 | 0.8
bsd-3-clause | may be used to endorse or promote products derived from this software | 4 | 0.8
gpl | you can redistribute it and or modify it under the terms of the gnu general public license | 5 | 1
gpl | (?:gnu )?general public license | 2 | 0.8
gpl-2.0 | (?:gnu )?gplv2 | 3 | 0.8
gpl-3.0 | (?:gnu )?gplv3 | 3 | 0.8
lgpl | (?:gnu )?lesser general public license | 3 | 0.8
mit | mit license | 2 | 0.9
apache | apache license | 2 | 0.8
bsd | bsd(?: style)? license | 2 | 0.7
unlicense | this is free and unencumbered software released into the public domain | 5 | 1
public-domain | (?:released|dedicated|placed) (?:in|into|to) the public domain | 4 | 0.9
public-domain | (?:is|are|work in) (?:in )?the public domain | 3 | 0.8
public-domain | public domain | 2 | 0.5
proprietary | all rights reserved | 3 | 0.7
proprietary | proprietary and confidential | 4 | 0.9
proprietary | proprietary license | 3 | 0.8
proprietary | unauthorized (?:copying|use|distribution) of this (?:file|document|work).{0,40} confidential | 4 | 0.8
proprietary | no part of this (?:publication|work|book|document) may be reproduced | 4 | 0.8
proprietary | may not be (?:copied|reproduced|distributed) without (?:prior |written |express )*permission | 4 | 0.8
copyright | copyright(?: c)? (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])* | 1 | 0.3
copyright | copyright(?: c)? by | 1 | 0.3
cc | creative commons(?: license)? | 1 | 0.5
cc | licensed under a creative commons license | 3 | 0.7
disclaimer | without warranty of any kind express or implied | 1 | 0.4
disclaimer | without warranties or conditions of any kind | 1 | 0.4
disclaimer | provided as is without (?:any )?warranty | 1 | 0.4
commercial | commercial license(?: agreement)? | 2 | 0.5
commercial | for noncommercial (?:use|purposes) only | 2 | 0.6
commercial | for non commercial (?:use|purposes) only | 2 | 0.6
eula | end user license agreement | 3 | 0.8
freeware | this (?:software|program) is freeware | 3 | 0.7
shareware | this (?:software|program) is shareware | 3 | 0.7
"""

_GRANT = "(?:licensed|released|distributed|available|published|provided|offered|covered|shared)(?: for use| by us)? under(?: the)?(?: terms of)?(?: the)?"
_CC_PARTS = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:s|atives|ative works)", "sa": "share ?alike"}


def _rows(text: str) -> list[list[str]]:
    """Fields of the tables above; a bar with blanks around it parts them, one in a pattern has none."""
    return [[x.strip() for x in line.split(" | ")] for line in text.strip().splitlines()]


def _built() -> list[Rule]:
    out = []

    def add(label: str, pattern: str, priority: int, weight: float, held: str = "") -> None:
        out.append(Rule(label, pattern, priority, weight, _anchors(held or pattern)[0], _literal_run(held or pattern)))

    for label, name, short, address in _rows(_LICENSES):
        add(label, f"{_GRANT} {name}", 4, 1.0, name)
        add(label, name, 3, 0.9)
        add(label, f"spdx license identifier {short}", 5, 1.0)
        add(label, address, 4, 0.95)
        add(label, f"licen[cs]e {short}", 3, 0.8)
        add(label, f"{short} licen[cs]e", 3, 0.8)
    for parts in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"):
        long = " ".join(_CC_PARTS[p] for p in parts.split(" "))
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"cc-{parts.replace(' ', '-')}-{version.replace(' ', '.')}"
            add(label, f"{_GRANT} cc {parts} {version}", 5, 1.0, f"cc {parts}")
            add(label, f"cc {parts} {version}", 4, 0.9)
            add(label, f"creative commons {long} {version}", 4, 0.95)
            add(label, f"creativecommons org licenses {parts} {version}", 5, 1.0)
    for label, pattern, priority, weight in _rows(_PHRASES):
        add(label, pattern, int(priority), float(weight))
    return out


RULES = _built()
ANCHORS = sorted({r.anchor for r in RULES})
#: Rules by the keyword that gates them.
GATED = {a: list(x) for a, x in groupby(sorted(enumerate(RULES), key=lambda r: (r[1].anchor, r[0])), lambda r: r[1].anchor)}
PRIORITIES = sorted({r.priority for r in RULES})


def _literal(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rules_sql() -> str:
    """Array of (anchor, its rules): keywords are tried once each, not once a rule."""
    one = lambda i, r: f"struct({i}, {_literal(r.label)}, {_literal(r.literal)}, {_literal(r.regex)}, {r.priority}, {r.weight}D)"
    rows = ", ".join(f"struct({_literal(' ' + a)}, array({', '.join(one(i, r) for i, r in rules)}))" for a, rules in GATED.items())
    return f"cast(array({rows}) AS array<struct<anchor:string, rules:array<struct<rule:int, label:string, literal:string, regex:string, priority:int, weight:double>>>>)"


def gate(lower: Column) -> Column:
    """Whether a text in lower case holds a keyword. Plain searches, each stopping at its first hit; a pair of words takes an expression."""
    out = F.lit(False)
    for a in ANCHORS:
        first, _, second = a.partition("  ")
        found = F.contains(lower, F.lit(first))
        out |= found & lower.rlike(first + SEPARATORS + second) if second else found
    return out


def normalized(text: Column) -> Column:
    """The words of a text, lower case, two blanks between them, one at either end."""
    words = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SEPARATORS, "  ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


_WORDS = "CAST((length({0}) - length(replace({0}, ' ', ''))) DIV 2 AS INT)"

#: Detections of one rule r in `norm`: words before each match from the parts between matches.
_SPANS = f"""
aggregate(
  zip_with(slice(split(norm, r.regex, -1), 1, size(regexp_extract_all(norm, r.regex, 0))), regexp_extract_all(norm, r.regex, 0),
           (p, m) -> named_struct('gap', {_WORDS.format("p")}, 'n', {_WORDS.format("m")})),
  named_struct('at', 0, 'out', cast(array() AS array<struct<first:int, last:int, priority:int, rule:int, label:string, weight:double>>)),
  (s, x) -> named_struct('at', s.at + x.gap + x.n, 'out', concat(s.out, array(named_struct(
      'first', s.at + x.gap, 'last', s.at + x.gap + x.n - 1, 'priority', r.priority, 'rule', r.rule, 'label', r.label, 'weight', r.weight)))),
  s -> s.out)
"""

_DETECTIONS = "flatten(transform(filter(flatten(transform(filter({rules}, g -> contains(norm, g.anchor)), g -> g.rules)), r -> contains(norm, r.literal) AND norm RLIKE r.regex), r -> " + _SPANS + "))"


def _surviving() -> str:
    """Sorted by start, longest first, a detection lies in a higher one exactly where a higher one so far ends no earlier."""
    tops = ", ".join("-1" for _ in PRIORITIES)
    return f"""
aggregate(
  array_sort(detections, (a, b) -> CASE WHEN a.first <> b.first THEN a.first - b.first WHEN a.last <> b.last THEN b.last - a.last
                                        WHEN a.priority <> b.priority THEN b.priority - a.priority ELSE a.rule - b.rule END),
  named_struct('tops', array({tops}), 'out', slice(detections, 1, 0)),
  (s, d) -> named_struct(
    'tops', transform(s.tops, (t, i) -> IF(i + {PRIORITIES[0]} = d.priority, greatest(t, d.last), t)),
    'out', IF(exists(transform(s.tops, (t, i) -> i + {PRIORITIES[0]} > d.priority AND t >= d.last), x -> x), s.out, concat(s.out, array(d)))),
  s -> s.out)
"""


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, detections, spans, base) of every row, without a shuffle.

    detections: all matches of all rules as structs (first and last word, priority, rule, label,
    weight); spans: those that no containing detection of higher priority suppresses; base: for
    each base phrase its label, number of places, first and last place. A null text is empty;
    null and repeated ids are rows like others; of equal intervals the higher priority, then the earlier rule wins; an empty table gives no rows; other columns are
    ignored. Whole texts of any length are scanned.
    """
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Full lower case can only add keywords to a text, never hide one.
    d = d.withColumn("lower", F.lower("text"))
    d = d.select("id", F.regexp_count("text", F.lit(_RAW_WORD)).cast("long").alias("n_words"), F.when(gate(F.col("lower")), normalized(F.col("text"))).alias("norm"))
    none = "cast(array() AS array<struct<first:int, last:int, priority:int, rule:int, label:string, weight:double>>)"
    d = d.withColumn("detections", F.expr(f"coalesce({_DETECTIONS.format(rules=_rules_sql())}, {none})"))
    d = d.withColumn("spans", F.expr(f"IF(size(detections) = 0, detections, {_surviving()})"))
    base = []
    for phrase, label in BASE:
        regex, n = _literal(" " + phrase.replace(" ", "  ") + " "), len(phrase.split(" "))
        parts = f"split(norm, {regex}, -1)"
        base.append(f"""IF(contains(norm, {regex}), named_struct('label', {_literal(label)}, 'n', CAST(size({parts}) - 1 AS BIGINT),
            'first', CAST({_WORDS.format(f"element_at({parts}, 1)")} AS BIGINT),
            'last', n_words - {n} - {_WORDS.format(f"element_at({parts}, -1)")}), NULL)""")
    return d.withColumn("base", F.expr(f"filter(array({', '.join(base)}), b -> b IS NOT NULL)")).drop("norm")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, base places, labels and a score of every document; null texts are empty, rows of no words have null places and no labels.

    Repeated and null ids are rows like others, equal places of one label count once; an empty table gives no rows. See `scan`.
    """
    d = scan(table(spark, sf_dir, "documents"))
    return d.selectExpr(
        "id AS doc_id", "n_words", "aggregate(base, 0L, (s, b) -> s + b.n) AS n_base",
        "array_min(transform(base, b -> b.first)) AS first_word", "array_max(transform(base, b -> b.last)) AS last_word",
        "array_join(array_sort(array_distinct(transform(base, b -> b.label))), ',') AS base_labels",
        "array_join(array_sort(array_distinct(concat(transform(base, b -> b.label), transform(spans, d -> d.label)))), ',') AS labels",
        "coalesce(array_max(transform(spans, d -> d.weight)), 0D) AS score",
        "CAST(size(detections) AS BIGINT) AS n_detections", "CAST(size(spans) AS BIGINT) AS n_spans",
    )


def _duck(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _duck_words(x: str) -> str:
    return f"((length({x}) - length(replace({x}, ' ', ''))) // 2)"


def op1_sql() -> str:
    rules = ",\n".join(f"({i}, {_duck(r.label)}, {_duck(' ' + r.anchor)}, {_duck(r.regex)}, {r.priority}, CAST({r.weight} AS DOUBLE))" for i, r in enumerate(RULES))
    phrases = ", ".join(f"({_duck(label)}, {_duck(' ' + p.replace(' ', '  ') + ' ')}, {len(p.split(' '))})" for p, label in BASE)
    return f"""
WITH rules(rule, label, keyword, regex, priority, weight) AS (VALUES {rules}),
base(label, phrase, n) AS (VALUES {phrases}),
d AS (
  SELECT doc_id, ' ' || trim(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{SEPARATORS}', '  ', 'g'), ' ') || ' ' AS norm FROM documents
), w AS (SELECT doc_id, norm, CASE WHEN norm = '  ' THEN 0 ELSE {_duck_words("norm")} END AS n_words FROM d),
b AS (
  SELECT doc_id, label, len(string_split(norm, phrase)) - 1 AS places, {_duck_words("string_split(norm, phrase)[1]")} AS first,
    n_words - n - {_duck_words("string_split(norm, phrase)[-1]")} AS last
  FROM w JOIN base ON contains(norm, phrase)
), bs AS (SELECT doc_id, sum(places) AS n_base, min(first) AS first_word, max(last) AS last_word, string_agg(label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
m AS (
  SELECT doc_id, rule, label, priority, weight, string_split_regex(norm, regex) AS parts, regexp_extract_all(norm, regex) AS found
  FROM w JOIN rules ON contains(norm, keyword) AND regexp_matches(norm, regex)
), s AS (
  SELECT doc_id, rule, label, priority, weight, found[i] AS hit,
    list_sum([{_duck_words("x")} FOR x IN parts[1:i]]) + coalesce(list_sum([{_duck_words("x")} FOR x IN found[1:i - 1]]), 0) AS first
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m)
), t AS (SELECT *, first + {_duck_words("hit")} - 1 AS last FROM s),
k AS (
  SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM t h WHERE h.doc_id = t.doc_id AND h.priority > t.priority AND h.first <= t.first AND h.last >= t.last)
), ts AS (SELECT doc_id, count(*) AS n_detections FROM t GROUP BY doc_id),
ks AS (SELECT doc_id, count(*) AS n_spans, max(weight) AS score FROM k GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM k UNION SELECT doc_id, label FROM b) GROUP BY doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, CAST(0 AS DOUBLE)) AS score,
  CAST(coalesce(n_detections, 0) AS BIGINT) AS n_detections, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans
FROM w LEFT JOIN bs USING (doc_id) LEFT JOIN ts USING (doc_id) LEFT JOIN ks USING (doc_id) LEFT JOIN l USING (doc_id)
"""


OP1_SQL = op1_sql()
