"""Licence texts by a positional index of their rare words.

The base is exact: places where the words of a short phrase stand consecutively.
On top of it, ``TEMPLATES`` are indexed as postings (word, template, position)
without their function words. Document frequencies of the index words over the
corpus order the places of a template by IDF, and only the rarest are looked up:
so many that whatever share ``COVERAGE`` of a template's places a document holds,
one of them is among these (with s places, s - ceil(COVERAGE * s) + 1), whatever
else the document holds. Each hit gives an alignment of document and template;
the template's other postings are then intersected by relative position, and an
alignment that holds ``COVERAGE`` of them counts if the template's mandatory phrase
stands at its place. Everything is SQL expressions on a document's own row.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import bound

#: Phrases of the base and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Label, wording, mandatory phrase within the wording.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license as published"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "software distributed under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
        to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
        copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of
        any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no
        event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise
        arising from out of or in connection with the software or the use or other dealings in the software""", "the rights to use copy modify merge publish distribute sublicense"),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright
        notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this
        software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or
        consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious
        action arising out of or in connection with the use or performance of this software""", "the author disclaims all warranties with regard to this software"),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary
        form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided
        with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not
        limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or
        contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of
        substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract
        strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such
        damage""", "redistributions of source code must retain the above copyright notice"),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the
        use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and
        redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the
        original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered
        source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered
        from any source distribution""", "the origin of this software must not be misrepresented"),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this
        software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize
        copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this
        dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of
        relinquishment in perpetuity of all present and future rights to this software under copyright law""", "free and unencumbered software released into the public domain"),
    ("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free
        software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful
        but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for
        more details you should have received a copy of the gnu general public license along with this program""", "you should have received a copy of the gnu general public license"),
    ("apache", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of
        the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is
        distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing
        permissions and limitations under the license""", "you may not use this file except in compliance with the license"),
)
FUNCTION_WORDS = frozenset("a an and any are as at be by for from in is it of on or that the this to was with you 0 2 3 4".split())
#: Least share of a template's index places that an alignment must hold.
COVERAGE = 0.6

#: Words and what parts them, in a text whose capitals A-Z are still there.
_WORD, _GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text with A-Z in lower case."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(f"{_WORD}+"), F.lit(0))


def _any_of(words: list[str]) -> str:
    """A pattern of whole words, as a tree of their letters; only ASCII letters differ in case."""

    def tree(rest: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for w in rest:
            heads.setdefault(w[:1], []).append(w[1:])
        some = [h + tree(t) for h, t in sorted(heads.items()) if h]
        out = some[0] if len(some) == 1 and "" not in heads else f"(?:{'|'.join(some)})" if some else ""
        return f"(?:{out})?+" if "" in heads and some else out

    return f"(?i)(?<!{_WORD}){tree(sorted(set(words)))}(?!{_WORD})" if words else "(?!)"


#: The base phrases as one pattern: none begins within another, so matches never overlap.
_PHRASE = f"(?i)(?<!{_WORD})(?:{'|'.join(p.replace(' ', _GAP) for p, _ in PHRASES)})(?!{_WORD})"


def _templates() -> list[dict]:
    """Label, mandatory phrase and its place, and the places of the index words, of each template."""
    out = []
    for label, text, phrase in TEMPLATES:
        words, need = text.split(), phrase.split()
        off = next(i for i in range(len(words)) if words[i : i + len(need)] == need)
        out.append({"label": label, "off": off, "phrase": need, "places": [{"p": p, "w": w} for p, w in enumerate(words) if w not in FUNCTION_WORDS]})
    return out


def document_frequencies(docs: DataFrame) -> dict[str, int]:
    """Index word -> documents of the whole corpus with it; a fixed number of words."""
    index = _any_of([x["w"] for t in _templates() for x in t["places"]])
    found = docs.select(F.explode(F.array_distinct(F.expr(f"transform(regexp_extract_all(text, r'{index}', 0), w -> lower(w))"))).alias("word"))
    return {r["word"]: r["count"] for r in found.groupBy("word").count().collect()}


def anchors(frequency: dict[str, int]) -> list[tuple[str, int, int]]:
    """(word, template, place) of the places that are looked up: the rarest of each template."""
    out = []
    for t, template in enumerate(_templates()):
        places = sorted(template["places"], key=lambda x: (frequency.get(x["w"], 0), x["w"], x["p"]))
        out += [(x["w"], t, x["p"]) for x in places[: len(places) - math.ceil(COVERAGE * len(places)) + 1]]
    return out


def _base(text: str) -> str:
    """SQL of struct<n, first, last, labels>: the places of the base phrases."""
    parts = f"arrays_zip(split({text}, r'{_PHRASE}', -1), regexp_extract_all({text}, r'{_PHRASE}', 0))"
    begins = lambda p: f"startswith(lower(x.`1`), '{p.split()[0]}')"
    label = f"CASE {' '.join(f'WHEN {begins(p)} THEN {chr(39)}{x}{chr(39)}' for p, x in PHRASES)} END"
    size = f"CASE {' '.join(f'WHEN {begins(p)} THEN {len(p.split())}' for p, x in PHRASES)} END"
    at = f"(acc.at + regexp_count(x.`0`, r'{_WORD}+'))"
    step = f"named_struct('at', {at} + {size}, 'first', coalesce(acc.first, {at}), 'last', {at})"
    places = f"aggregate(found, named_struct('at', 0, 'first', CAST(NULL AS INT), 'last', CAST(NULL AS INT)), (acc, x) -> {step})"
    made = f"named_struct('n', size(found), 'first', ({places}).first, 'last', ({places}).last, 'labels', array_distinct(transform(found, x -> {label})))"
    return bound(f"filter({parts}, x -> x.`1` IS NOT NULL)", "found", made)


def _more(words: str, looked_up: list[tuple[str, int, int]]) -> str:
    """SQL of array<struct<label, share, good>>: the alignments of the array ``words`` with templates."""
    quoted = lambda value, kind: f"from_json(r'{json.dumps(value)}', '{kind}')"
    templates = quoted(_templates(), "array<struct<label:string,off:int,phrase:array<string>,places:array<struct<p:int,w:string>>>>")
    by_word: dict[str, list] = {}
    for w, t, p in looked_up:
        by_word.setdefault(w, []).append({"t": t, "p": p})
    postings = quoted(by_word, "map<string,array<struct<t:int,p:int>>>")
    known = quoted(sorted(by_word), "array<string>")
    # an alignment is one number: the template, and the place of its first word in the document
    hits = f"filter(transform({words}, (w, i) -> named_struct('w', w, 'i', i)), x -> array_contains({known}, x.w))"
    alignments = f"array_distinct(flatten(transform({hits}, x -> transform({postings}[x.w], q -> CAST(q.t AS BIGINT) * 1099511627776 + (x.i - q.p) + 1048576))))"
    share = f"size(filter(t.places, x -> get({words}, start + x.p) = x.w)) / size(t.places)"
    good = f"forall(sequence(0, size(t.phrase) - 1), k -> coalesce(get({words}, start + t.off + k) = get(t.phrase, k), false))"
    one = bound(f"get({templates}, CAST(a DIV 1099511627776 AS INT))", "t", bound("CAST(a % 1099511627776 - 1048576 AS INT)", "start", f"named_struct('label', t.label, 'share', {share}, 'good', {good})"))
    return f"filter(transform({alignments}, a -> {one}), x -> x.share >= {COVERAGE})"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, candidates) for every row of ``docs``.

    Needs doc_id and text. A null text has no words. ``score`` is 1 with a base
    phrase, else the best share of a verified template's index places, else 0;
    ``candidates`` counts alignments before verification. Null ids and repeated
    rows are rows of their own; an empty table gives none. Texts of any length
    are read whole.
    """
    looked_up = anchors(document_frequencies(docs.select("text")))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = "named_struct('n', 0, 'first', CAST(NULL AS INT), 'last', CAST(NULL AS INT), 'labels', CAST(array() AS array<string>))"
    anchor = _any_of([w for w, _, _ in looked_up])
    words = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), r'{_WORD}+', 0)"
    found = bound(words, "ws", _more("ws", looked_up))
    empty = "CAST(array() AS array<struct<label:string,share:double,good:boolean>>)"
    one = bound(f"IF(text RLIKE r'(?i)license|cc', {_base('text')}, {none})", "b", bound(f"IF(text RLIKE r'{anchor}', {found}, {empty})", "m", "named_struct('b', b, 'm', m, 'extra', filter(m, x -> x.good))"))
    out = rows.select("doc_id", F.regexp_count("text", F.lit(f"{_WORD}+")).cast("long").alias("n_words"), F.expr(one).alias("x"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.expr(a))), ",")
    return out.select(
        "doc_id", "n_words", F.col("x.b.n").cast("long").alias("n_base"), F.col("x.b.first").cast("long").alias("first_word"), F.col("x.b.last").cast("long").alias("last_word"),
        joined("x.b.labels").alias("base_labels"), joined("concat(x.b.labels, transform(x.extra, e -> e.label))").alias("labels"),
        F.when(F.col("x.b.n") > 0, 1.0).otherwise(F.coalesce(F.expr("array_max(transform(x.extra, e -> e.share))"), F.lit(0.0))).alias("score"), F.size("x.m").cast("long").alias("candidates"),
    )
