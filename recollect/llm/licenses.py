"""License scans by diagonal voting.

All rolling word k-gram hashes of the texts are joined with the k-grams of license templates. A hit
votes for the diagonal of its offset, the place in the text less the place in the template. Diagonals
next to each other, up to a share of the template's length for words put in or left out, are one span. A span is verified by the longest
chain of its hits that goes on in the text and in the template: its words must be enough of the template's (all of a short one's), in not many more
words of the text. Of spans of several labels over the same words the one that explains more of them, less the words between and those of the template that are not there, stays.
Templates are whole short licenses, the notices of long ones, passages of both, and SPDX identifiers; other templates are a parameter. Beside that, fixed phrases give base labels.

A null or empty text has no words and no labels. A very long text is one row of hits for each template; its words are exploded. Rows with
equal doc_id and text get equal results. An empty table gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Public licenses, their notices and passages, by the label that they speak for.
GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
NOTICE = "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
BINARY = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
RETAIN = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
REPRODUCE = "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
ENDORSE = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
HOLDERS = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
APPLICABLE = "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
FREE = "is free software you can redistribute it and or modify it under the terms of the gnu {} general public license as published by the free software foundation"
NO_WARRANTY = "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {} general public license for more details"
TEMPLATES = (
    ("mit", f"{GRANT} and to permit persons to whom the software is furnished to do so subject to the following conditions {NOTICE} {AS_IS}"),
    ("mit", GRANT),
    ("mit", NOTICE),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the terms of the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "licensed under mit"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", f"{BINARY} 1 {RETAIN} 2 {REPRODUCE} {HOLDERS}"),
    ("bsd", f"{BINARY} 1 {RETAIN} 2 {REPRODUCE} 3 {ENDORSE} {HOLDERS}"),
    ("bsd", BINARY),
    ("bsd", RETAIN),
    ("bsd", ENDORSE),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("apache-2", f"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 {APPLICABLE} see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", APPLICABLE),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("gpl", f"this program {FREE.format('').replace('  ', ' ')} either version 3 of the license or at your option any later version this program {NO_WARRANTY.format('').replace('  ', ' ')}"),
    ("gpl", f"this program {FREE.format('').replace('  ', ' ')}"),
    ("lgpl", f"this library {FREE.format('lesser')} either version 2 1 of the license or at your option any later version this library {NO_WARRANTY.format('lesser')}"),
    ("agpl", f"this program {FREE.format('affero')} either version 3 of the license or at your option any later version this program {NO_WARRANTY.format('affero')}"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "this work is licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
)
#: Identifiers after "SPDX-License-Identifier:", as words.
SPDX = (
    ("mit", "mit"), ("isc", "isc"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"), ("zlib", "zlib"), ("unlicense", "unlicense"), ("apache-2", "apache 2 0"), ("mpl-2", "mpl 2 0"), ("gpl", "gpl 2 0"), ("gpl", "gpl 3 0"),
    ("lgpl", "lgpl 2 1"), ("lgpl", "lgpl 3 0"), ("agpl", "agpl 3 0"), ("cc-by", "cc by 4 0"), ("cc-by-sa", "cc by sa 4 0"), ("cc-by-nc", "cc by nc 4 0"), ("cc0", "cc0 1 0"),
)
TEMPLATES += tuple((label, f"spdx license identifier {name}") for label, name in SPDX)
GRAM = 3
#: Share of a template's words that must be there; all words of a template shorter than WHOLE. Diagonals are neighbours up to APART words or this share of the template apart.
COVERED, WHOLE, NEIGHBOURS, APART = 0.75, 16, 0.25, 10
#: A span gives way to a better one of another label that overlaps this share of it.
OVERLAP = 0.5


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _grams(own: Column, k: int) -> Column:
    """(place, hash, words) of each run of k words."""
    last = F.size(own) - k
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("at"), F.xxhash64(*[F.get(own, i + j) for j in range(k)]).alias("gram"), F.get(own, i).alias("word")))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<struct<at:int,gram:bigint,word:string>>"))


def template_grams(spark: SparkSession, templates=TEMPLATES, k: int = GRAM) -> DataFrame:
    """One row per k-gram of a template; as small as the fixed list of templates."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, body string")
    own = rows.select("template", "label", words(F.col("body")).alias("own"))
    return own.select("template", "label", F.size("own").alias("long"), F.explode(_grams(F.col("own"), k)).alias("g")).select("template", "label", "long", F.col("g.at").alias("place"), F.col("g.gram").alias("gram"), F.col("g.word").alias("template_word"))


def _needed(long: int, covered: float) -> int:
    """Words of a template that must be there."""
    return long if long < WHOLE else math.ceil(covered * long)


def _chain(at: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The longest chain of hits that go on in the text and in the template, as their numbers; hits come by text place."""
    tails: list[int] = []
    ends: list[int] = []
    before = np.full(len(at), -1)
    # Of hits at one place of the text only one can stand in a chain, so the later places of the template go first.
    order = np.lexsort((-place, at))
    for i in order.tolist():
        k = bisect.bisect_left(tails, int(place[i]))
        before[i] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(int(place[i]))
            ends.append(i)
        else:
            tails[k], ends[k] = int(place[i]), i
    chain, i = [], ends[-1] if ends else -1
    while i >= 0:
        chain.append(i)
        i = int(before[i])
    return np.array(chain[::-1], np.int64)


def _covered(starts: np.ndarray, k: int) -> int:
    """Words in runs of k words from the starts, which are in order."""
    return int(np.minimum(np.diff(starts), k).sum() + k) if len(starts) else 0


def template_spans(at: np.ndarray, place: np.ndarray, long: int, k: int, covered: float) -> list[tuple[int, int, int, int, int]]:
    """(start, end, words of the template that are there, those that are not and other words of the text between them, hits) of the spans of one template in one text.

    Diagonals vote; a diagonal whose neighbours together have votes enough is in a span, and those next to each other are one span. The longest chain of its hits verifies it."""
    needed, apart = _needed(long, covered), max(APART, int(NEIGHBOURS * long))
    diagonal = at - place
    values, votes = np.unique(diagonal, return_counts=True)
    sums = np.concatenate(([0], np.cumsum(votes)))
    around = sums[np.searchsorted(values, values + apart, "right")] - sums[np.searchsorted(values, values - apart, "left")]
    # A word stands in k runs at most.
    strong = values[around * k >= needed]
    found = []
    for group in np.split(strong, np.flatnonzero(np.diff(strong) > apart) + 1) if len(strong) else []:
        near = (diagonal >= group[0] - apart) & (diagonal <= group[-1] + apart)
        found += _verified(at[near], place[near], long, k, needed)
    return found


def _verified(at: np.ndarray, place: np.ndarray, long: int, k: int, needed: int) -> list[tuple[int, int, int, int, int]]:
    """The best chain of the hits within the length of one template, then those of what lies before and after it."""
    out, todo = [], [np.ones(len(at), bool)]
    while todo:
        among = np.flatnonzero(todo.pop())
        if len(among) * k < needed:
            continue
        # Repeated templates give longer stretches of text than one has; each is looked for from its own first words on.
        reach = int(long * 1.5) + APART
        best: tuple[int, np.ndarray] = (0, among[:0])
        for first in np.unique(at[among][place[among] <= max(long - needed, 0)])[:: max(1, long // 8)].tolist() or [int(at[among].min())]:
            window = among[(at[among] >= first - long // 8) & (at[among] < first + reach)]
            chain = window[_chain(at[window], place[window])]
            there = _covered(place[chain], k)
            if there > best[0]:
                best = (there, chain)
        there, chain = best
        if there < needed:
            continue
        start, end = int(at[chain[0]]), int(at[chain[-1]]) + k
        if end - start <= reach:
            out.append((start, end, there, end - start - _covered(at[chain], k) + long - there, len(chain)))
        for side in (at[among] + k <= start, at[among] >= end):
            mask = np.zeros(len(at), bool)
            mask[among[side]] = True
            todo.append(mask)
    return out


def _best_labels(spans: list[dict]) -> list[dict]:
    """Without the spans that lie for a good part under a better one of another label."""
    rows = sorted(spans, key=lambda s: s["start"])
    kept, active = [True] * len(rows), []
    for i, s in enumerate(rows):
        active = [j for j in active if rows[j]["end"] > s["start"]]
        for j in active:
            o = rows[j]
            if o["label"] != s["label"]:
                shared = min(o["end"], s["end"]) - s["start"]
                worse, w = (i, s) if s["value"] < o["value"] else (j, o)
                if s["value"] != o["value"] and shared >= OVERLAP * (w["end"] - w["start"]):
                    kept[worse] = False
        active.append(i)
    return [s for s, k in zip(rows, kept, strict=True) if k]


def spans(docs: DataFrame, templates=TEMPLATES, k: int = GRAM, covered: float = COVERED) -> DataFrame:
    """doc_id, text_hash, label, start, end and cover of each verified span, in words; where templates overlap, the one that explains more words stays."""
    text = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("own"))
    grams = text.select("doc_id", "text_hash", F.explode(_grams(F.col("own"), k)).alias("g")).select("doc_id", "text_hash", F.col("g.at").alias("at"), F.col("g.gram").alias("gram"), F.col("g.word").alias("word"))
    known = template_grams(docs.sparkSession, templates, k)
    hits = grams.join(F.broadcast(known), "gram").where("word = template_word")
    # All hits of a text and a template are in one task already, and are put together before they travel.
    votes = hits.groupBy("doc_id", "text_hash", "template", "label", "long").agg(F.collect_list("at").alias("ats"), F.collect_list("place").alias("places"))
    least = F.when(F.col("long") < WHOLE, F.col("long")).otherwise(F.ceil(F.col("long") * covered))
    votes = votes.where(F.size("ats") * k >= least)

    @F.pandas_udf("array<struct<label:string,start:int,end:int,value:int,cover:double>>")
    def found(label: pd.Series, long: pd.Series, ats: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for name, n, a, p in zip(label, long, ats, places, strict=True):
            pairs = np.unique(np.stack([a, p], 1).astype(np.int64), axis=0)
            out.append([{"label": name, "start": s, "end": e, "value": there - other, "cover": hits / (n - k + 1)} for s, e, there, other, hits in template_spans(pairs[:, 0], pairs[:, 1], int(n), k, covered)])
        return pd.Series(out)

    @F.pandas_udf("array<struct<label:string,start:int,end:int,value:int,cover:double>>")
    def best(lists: pd.Series) -> pd.Series:
        return lists.map(lambda rows: _best_labels(list(rows)))

    rows = votes.select("doc_id", "text_hash", F.explode(found("label", "long", "ats", "places")).alias("s"))
    rows = rows.groupBy("doc_id", "text_hash").agg(F.collect_list("s").alias("all"))
    rows = rows.select("doc_id", "text_hash", F.explode(best("all")).alias("s"))
    return rows.select("doc_id", "text_hash", "s.label", "s.start", "s.end", F.least(F.col("s.cover"), F.lit(1.0)).alias("cover"))


def base(own: Column, phrase: str) -> Column:
    """Places where the words of the phrase stand one after the other."""
    parts = phrase.split(" ")
    at = F.sequence(F.lit(0), F.greatest(F.size(own) - 1, F.lit(0)))
    here = F.filter(at, lambda i: F.aggregate(F.array(*[F.lit(j) for j in range(len(parts))]), F.lit(True), lambda so, j: so & F.coalesce(F.get(own, i + j) == F.get(F.array(*[F.lit(p) for p in parts]), j), F.lit(False))))
    return F.when(F.arrays_overlap(own, F.array(F.lit(min(parts, key=lambda p: (p in ("the", "by", "under", "version", "2"), p))))), here).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score, the highest cover (1 for a base phrase)."""
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("own"))
    own = own.withColumns({f"p{i}": base(F.col("own"), phrase) for i, (phrase, _) in enumerate(BASE)})
    places = F.concat(*[F.col(f"p{i}") for i in range(len(BASE))])
    own = own.select(
        "doc_id", "text_hash", F.size("own").cast("long").alias("n_words"), F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_sort(F.filter(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]), lambda x: x.isNotNull())).alias("base_found"),
    )
    more = spans(docs).groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))
    both = own.join(more, own["doc_id"].eqNullSafe(more["id"]) & (own["text_hash"] == more["hash"]), "left")
    labels = F.array_sort(F.array_distinct(F.concat("base_found", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.least(F.coalesce("cover", F.lit(0.0)), F.lit(1.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_found", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
