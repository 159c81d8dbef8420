"""License scan with a positional rare-token index, in DataFrame expressions only.

The index is made of templates: phrases that name licences, and the headers and paragraphs that open
them. A word's weight is its inverse document frequency over the templates; words at or above RARE
are rare. A template's anchors are the ANCHORS rarest words of its mandatory key phrases. For each text
the places of anchor words are looked up; a template all of whose anchors the text has is a candidate,
and the postings of its anchors, each place less the anchor's position in the template, are
intersected: what is left are the starts at which all of them agree. A start is accepted if the words
that agree in place carry SHARE of the template's weight and each mandatory key phrase stands
whole in its place. A base template is itself its key phrase. As key phrases must stand whole, every
accepted start has all anchors in place: nothing is missed, however many rare words a text has.

Everything happens within a row: no join and no shuffle.

Cases: a null or empty text has no word, null places, empty labels and score 0; a text of any
length is scanned whole; a null doc_id is kept; repeated rows are scanned each; equal weights of
anchors go to the earlier word; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomlake.llm.common import ASCII_LOWER, ASCII_UPPER


class Template(NamedTuple):
    label: str
    text: str
    #: Phrases of the text that must stand in place; none: the whole text must.
    keys: tuple[str, ...] = ()
    base: bool = False


#: Phrases that name public licences, their headers and opening paragraphs.
TEMPLATES = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge", "person obtaining a copy")),
    Template("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ("without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies",)),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("permission notice shall be included in all copies or substantial portions",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain",)),
    Template("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form must reproduce",)),
    Template("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", ("provided by the copyright holders and contributors as is",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    Template("isc", "provided that the above copyright notice and this permission notice appear in all copies", ("this permission notice appear in all copies",)),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("you may not use this file except in compliance with the license",)),
    Template("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("unless required by applicable law or agreed to in writing",)),
    Template("gpl", "gnu general public license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("program is free software", "gnu general public license")),
    Template("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("distributed in the hope that it will be useful", "gnu general public license")),
    Template("lgpl", "gnu lesser general public license"),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("library is free software", "gnu lesser general public license")),
    Template("agpl", "gnu affero general public license"),
    Template("mpl-2", "mozilla public license version 2 0"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("source code form is subject to the terms of the mozilla public license",)),
    Template("epl-2", "eclipse public license version 2 0"),
    Template("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("accompanying materials are made available under the terms of the eclipse public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    Template("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("anyone is free to copy modify publish use compile sell or distribute",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable for any damages arising",)),
    Template("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("to alter it and redistribute it freely",)),
    Template("bsl-1", "boost software license version 1 0"),
    Template("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("person or organization obtaining a copy",)),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-sa", "creative commons attribution sharealike"),
    Template("cc-by-nc", "creative commons attribution noncommercial"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international license",)),
    Template("cc0", "cc0 1 0 universal"),
    Template("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", ("dedicated the work to the public domain by waiving",)),
    Template("artistic-2", "the artistic license 2 0"),
    Template("eupl", "licensed under the eupl"),
    Template("all-rights-reserved", "all rights reserved"),
)
RARE, SHARE, ANCHORS = 1.75, 0.8, 3
#: Function words of the templates, never looked up whatever their weight.
STOP = frozenset("a and any are by for following in into is of or that the this to under use with without".split())
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Index:
    """Templates as word lists with weights, key places and anchors (word, position), rarest first."""

    def __init__(self, templates=TEMPLATES, rare: float = RARE, anchors: int = ANCHORS):
        self.words = [t.text.split() for t in templates]
        df = Counter(w for words in self.words for w in set(words))
        self.idf = {w: round(math.log((1 + len(templates)) / n), 6) for w, n in df.items()}
        self.labels, self.base = [t.label for t in templates], [t.base for t in templates]
        self.keys = [sorted({i + j for key in t.keys or (t.text,) for i in self._places(words, key.split()) for j in range(len(key.split()))}) for t, words in zip(templates, self.words, strict=True)]
        self.anchors: list[list[tuple[str, int]]] = []
        for words, keys in zip(self.words, self.keys, strict=True):
            first = {words[p]: p for p in reversed(keys) if self.idf[words[p]] >= rare and words[p] not in STOP}
            self.anchors.append(sorted(first.items(), key=lambda x: (-self.idf[x[0]], x[1]))[:anchors])
            if not first:
                raise ValueError(f"no rare word in a key phrase of {' '.join(words)!r}")

    @staticmethod
    def _places(words: list[str], key: list[str]) -> list[int]:
        found = [i for i in range(len(words) - len(key) + 1) if words[i : i + len(key)] == key]
        if not found:
            raise ValueError(f"{key} is not in its template")
        return found


def _array(values, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def lowered(word: Column) -> Column:
    return F.translate(word, ASCII_UPPER, ASCII_LOWER)


def scanned(docs: DataFrame, index: Index | None = None, share: float = SHARE) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: (start, length, label, base, weight share) of every accepted template, by start.
    """
    index = index or Index()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0)).alias("words"))
    # Places of anchor words: the cheap test of every word, in either case, then the exact word of the few that pass.
    rare = sorted({w for anchors in index.anchors for w, _ in anchors})
    either = F.array_compact(F.transform(F.col("words"), lambda w, i: F.when(F.lower(w).isin(rare), i)))
    rows = rows.select("doc_id", "words", either.alias("places"))
    rows = rows.select("doc_id", "words", F.transform("places", lambda i: F.struct(lowered(F.get(F.col("words"), i)).alias("w"), i.alias("i"))).alias("hits"))
    template = F.array(*[
        F.struct(
            F.array(*[F.struct(F.lit(w).alias("w"), F.lit(p).alias("p")) for w, p in anchors]).alias("anchors"), _array(words, "string").alias("words"), _array([index.idf[w] for w in words], "double").alias("idf"),
            _array([i in keys for i in range(len(words))], "boolean").alias("key"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(round(sum(index.idf[w] for w in words), 6)).alias("total"),
        )
        for anchors, words, keys, label, base in zip(index.anchors, index.words, index.keys, index.labels, index.base, strict=True)
    ])
    present = F.array_distinct(F.transform("hits", lambda h: h["w"]))
    rows = rows.select("doc_id", "words", "hits", F.when(F.size("hits") > 0, present).alias("present"))
    candidates = F.filter(template, lambda t: F.forall(t["anchors"], lambda a: F.array_contains(F.col("present"), a["w"])))
    rows = rows.select("doc_id", "words", "hits", F.when(F.col("present").isNotNull(), candidates).alias("candidates"))

    def starts(t: Column) -> Column:
        """The starts at which all anchors of a template agree."""
        posted = lambda a: F.transform(F.filter("hits", lambda h: h["w"] == a["w"]), lambda h: h["i"] - a["p"])
        agreed = F.aggregate(F.slice(t["anchors"], 2, max(1, max(map(len, index.anchors)))), posted(F.get(t["anchors"], F.lit(0))), lambda kept, a: F.array_intersect(kept, posted(a)))
        return F.filter(agreed, lambda start: start >= 0)

    def judged(t: Column, start: Column) -> Column:
        seen = F.transform(t["words"], lambda w, j: F.coalesce(lowered(F.get(F.col("words"), start + j)) == w, F.lit(False)))
        weight = F.aggregate(F.zip_with(seen, t["idf"], lambda s, v: F.when(s, v).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)
        whole = F.forall(F.zip_with(seen, t["key"], lambda s, k: s | ~k), lambda ok: ok)
        return F.struct(start.cast("long").alias("start"), F.size(t["words"]).alias("length"), t["label"].alias("label"), t["base"].alias("base"), F.when(whole, F.round(weight / t["total"], 6)).alias("share"))

    judgements = F.flatten(F.transform(F.col("candidates"), lambda t: F.transform(starts(t), lambda start: judged(t, start))))
    spans = F.array_sort(F.filter(judgements, lambda s: s["share"] >= share))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.coalesce(spans, F.array().cast("array<struct<start:bigint,length:int,label:string,base:boolean,share:double>>")).alias("spans"))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda part: F.array_join(F.array_sort(F.array_distinct(F.transform(part, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    return rows.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"), "spans",
    )


def oracle(index: Index | None = None, share: float = SHARE) -> str:
    """The scan as DuckDB SQL that tries every template at every place, without the rare words."""
    index = index or Index()
    values = ", ".join(f"({t}, {p}, '{w}', {index.idf[w]}, {p in index.keys[t]}, '{index.labels[t]}', {index.base[t]})" for t, words in enumerate(index.words) for p, w in enumerate(words))
    return f"""
    WITH words AS (
      SELECT doc_id, rowid AS r, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
      FROM (SELECT *, row_number() OVER () AS rowid FROM documents)
    ), placed AS (
      SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM words
    ), t(t, p, w, idf, k, label, base) AS (VALUES {values}
    ), total AS (SELECT t, sum(idf) AS total, count(*) FILTER (k) AS nk, any_value(label) AS label, any_value(base) AS base FROM t GROUP BY t
    ), tried AS (
      SELECT r, t.t, i - p AS s, sum(idf) AS got, count(*) FILTER (k) AS nk FROM placed JOIN t USING (w) WHERE i >= p GROUP BY r, t.t, i - p
    ), spans AS (
      SELECT r, s, label, base, round(got / total, 6) AS part FROM tried JOIN total USING (t) WHERE tried.nk = total.nk AND round(got / total, 6) >= {share}
    ), found AS (
      SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(part) AS score
      FROM spans GROUP BY r
    )
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
      CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
    FROM words LEFT JOIN found USING (r)"""
