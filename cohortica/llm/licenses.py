"""Licence scan by a positional rare-token index, in DataFrame functions only.

Words are lower-cased runs of letters, digits and characters beyond ASCII.

1. Each text is cut once; a table keeps, for every row, its number of words, the
   licence words it holds and, if these can make a licence, its words with all
   others blanked, so that every place is still known.
2. That table gives the document frequency of every licence word.  The index has
   the postings (template, position) of each template's ``ANCHORS`` rarest words.
3. A file's rare licence words are looked up there; every posting implies a start
   of its template, and starts that two different words imply are candidates.
4. At a candidate the mandatory key phrase must stand word for word.  The share
   of the template's words that stand in place is the score.

Base phrases are counted wherever their words stand in a row, independently of
the index.

Nulls and edge cases: a null or wordless text has no words, labels "" and score
0; repeated rows are scanned each; an empty table gives an empty result.  Only
id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

import json
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortica.llm import common

ANCHORS = 3
#: Least share of a template's words in place.
COVER = 0.7
#: Score of a file that holds a base phrase but no template.
BASE_SCORE = 0.5

# Phrases and labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Label, notice as public licences word it, mandatory key phrase.
TEMPLATES = (
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     "redistribution and use in source and binary forms"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0", "cc0 1 0"),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "permission to use copy modify and or distribute this software"),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
     "apache license version 2 0"),
    ("agpl-3.0", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
     "gnu affero general public license as published by the free software foundation"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
     "this software is provided by the copyright holders and contributors as is"),
    ("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license version 1 0"),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0"),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0"),
    ("gpl-2.0", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
     "gnu general public license as published by the free software foundation either version 2"),
    ("gpl-3.0", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
     "gnu general public license as published by the free software foundation either version 3"),
    ("lgpl-2.1", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
     "gnu lesser general public license as published by the free software foundation either version 2 1"),
    ("lgpl-3.0", "it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
     "gnu lesser general public license as published by the free software foundation either version 3"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
     "to deal in the software without restriction"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
     "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
)


def _vocabulary(templates) -> list[str]:
    return sorted({w for _, notice, _ in templates for w in notice.split()} | {w for p, _ in BASE for w in p.split()})


def _facts(texts: DataFrame, templates) -> DataFrame:
    """doc_id, n_words, held (licence words, each once), words (all places, null where no licence word stands) of every row."""
    words = common.once(texts, "words", common.plain_words(F.col("text"))).select("doc_id", "words")
    vocabulary = _vocabulary(templates)
    held = common.once(words, "held", F.array_intersect(common.string_array(vocabulary), F.col("words")))
    blanked = F.transform("words", lambda w: F.when(w.isin(vocabulary), w))
    alone = any(len(notice.split()) == 1 for _, notice, _ in templates)
    return common.materialize(
        held.select("doc_id", F.size("words").cast("long").alias("n_words"), "held", F.when(F.size("held") >= (1 if alone else 2), blanked).alias("words")), "licence-facts"
    )


def frequencies(facts: DataFrame) -> tuple[int, dict[str, int]]:
    """Documents, and documents that hold each word of the templates; one row a word reaches the driver."""
    seen = facts.select(F.explode("held").alias("word")).groupBy("word").count().collect()
    return facts.count(), {x.word: x["count"] for x in seen}


def _phrase_places(phrase: str) -> Column:
    parts = phrase.split()
    there = lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.get("words", i + j) == w, F.lit(False)) for j, w in enumerate(parts)])
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0))), there)
    return F.when(F.size(F.array_intersect("held", common.string_array(sorted(set(parts))))) == len(set(parts)), places)


def _fixed(value, kind: str) -> Column:
    """A constant of any size as one literal."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _index(templates, rank: dict[str, tuple]) -> tuple[dict[str, list[dict]], list[dict]]:
    """Postings of the anchors by word, and the templates with their anchors' number, key phrase and its place."""
    postings: dict[str, list[dict]] = {}
    table = []
    for t, (label, notice, key) in enumerate(templates):
        words, phrase = notice.split(), key.split()
        anchors = sorted(set(words), key=rank.__getitem__)[:ANCHORS]
        for a in anchors:
            postings.setdefault(a, []).extend({"t": t, "p": p, "w": a} for p, w in enumerate(words) if w == a)
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        table.append({"label": label, "need": min(2, len(anchors)), "at": at, "words": words, "phrase": phrase})
    return postings, table


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    facts = _facts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), templates)
    total, df = frequencies(facts)
    rank = {w: (-log((total + 1) / (df.get(w, 0) + 1)), w) for w in _vocabulary(templates)}
    postings, table = _index(templates, rank)
    index = _fixed(postings, "map<string,array<struct<t:int,p:int,w:string>>>")
    of = lambda t: F.get(_fixed(table, "array<struct<label:string,need:int,at:int,words:array<string>,phrase:array<string>>>"), t)
    places = F.array(*[F.struct(F.lit(label).alias("label"), _phrase_places(phrase).alias("at")) for phrase, label in BASE])
    # Places of anchors, the starts their postings imply, sorted so that the words of one start are neighbours.
    hits = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(sorted(postings)))
    implied = F.flatten(F.transform(hits, lambda i: F.transform(F.element_at(index, F.get("words", i)), lambda x: F.struct(x["t"].alias("t"), (i - x["p"]).alias("s"), x["w"].alias("w")))))
    rare = F.size(F.array_intersect("held", common.string_array(sorted(postings)))) >= min(x["need"] for x in table)
    looked = common.once(facts, "implied", F.when(rare & (F.size("words") > 0), F.array_sort(F.array_distinct(implied))))
    agree = lambda x, k: (of(x["t"])["need"] == 1) | F.coalesce((F.get("implied", k + 1)["t"] == x["t"]) & (F.get("implied", k + 1)["s"] == x["s"]), F.lit(False))
    there = lambda s, word, j: F.get("words", s + j) == word
    found = F.filter("implied", agree)
    holds = lambda x: F.size(F.filter(of(x["t"])["phrase"], lambda w, j: there(x["s"] + of(x["t"])["at"], w, j))) == F.size(of(x["t"])["phrase"])
    share = lambda x: F.size(F.filter(of(x["t"])["words"], lambda w, j: there(x["s"], w, j))) / F.size(of(x["t"])["words"])
    covers = F.transform(F.filter(found, holds), lambda x: F.struct(of(x["t"])["label"].alias("label"), share(x).alias("cover")))
    scored = looked.select("doc_id", "n_words", F.filter(places, lambda p: F.coalesce(F.size(p["at"]), F.lit(0)) > 0).alias("places"), F.filter(covers, lambda c: c["cover"] >= COVER).alias("covers"))
    at = F.flatten(F.transform("places", lambda p: p["at"]))
    base = F.transform("places", lambda p: p["label"])
    own = F.coalesce(F.transform("covers", lambda c: c["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("covers", lambda c: c["cover"])), F.lit(0.0))
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scored.select(
        "doc_id", "n_words", F.size(at).cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"), join(base).alias("base_labels"), join(F.concat(base, own)).alias("labels"),
        F.greatest(best, F.when(F.size(at) > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0))).alias("score"),
    )
