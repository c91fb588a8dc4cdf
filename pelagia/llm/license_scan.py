"""License scans: sparse TF-IDF cosine of headers to templates, then inheritance from the nearest ancestor directory.

DataFrame functions only. Every line of every whole text that has a cue word is a header. Equal lines are counted first,
so a line that a third of all documents share is one row. Terms are weighted by tf * (ln((1 + N) / (1 + df)) + 1), N and
df counted over all headers and the templates; a header's licence is the template of the highest cosine, if that is at
least ``LEAST``; ties go to the licence first in order. A document's own licence is that of its best header.

Units of more than a line are scored besides, if they have a cue word: the whole text (a licence file), each paragraph, and
each two to four lines in a row (a header wrapped over lines), against whole licence texts and notices (``licence_texts``) and
the one-line templates. Every template has a cue word itself. Their weights are (1 + ln tf) * idf with idf over the templates
alone, so a unit's score does not depend on other documents. Units with a cue word are left out only if they share so few of
each template's words that none can reach ``LEAST`` (``signals``). A whole licence text or notice in a document decides
before its single lines (a BSD text has a line 'All rights reserved.'); of a header wrapped over lines and a single line the
higher cosine decides.

A directory has the licence of the least doc_id among the licensed files directly in it (a null doc_id is larger than any;
of several files under one doc_id the first licence in order). A file without its own takes
the licence of the nearest ancestor directory that has one; this joins distinct directories' paths, not files'.

``documents`` has no paths: ``path_of`` lays the table out as a tree (source, language, thousands, fifties), with round
ids higher up; a table with a path column passes its own.

Defined results: a null text has no headers; a null part of a path is ``_``; repeated rows repeat; a file in no licensed
directory and without its own licence has a null licence, found ``none``; rows of one doc_id with different texts are judged
apart; the input's other columns are not passed on, so none can clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from pelagia.llm import keys, licence_texts
from pelagia.session import table, written

LEAST = 0.6
#: Templates of fewer terms are notices and short licences, which runs of lines are scored for.
FEW_TERMS = 150
#: Part of a template's squared norm that its most common words may have beside its signal words.
SHARED = 0.2
#: Words that mark a header line.
CUES = r"(?i)licen[cs]e|copyright|spdx|rights reserved|public domain|warrant"
#: The same over several lines.
UNIT_CUES = r"(?i)licen[cs]e|copyright|spdx|rights\W+reserved|public\W+domain|warrant"
TERM = r"[^a-z0-9.+-]+"
#: Licences and phrases of their headers.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
)


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TERM), lambda t: F.length(t) > 0)


def scored_lines(lines: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(line, licence, cosine) of the distinct lines (line, n) that reach LEAST."""
    spark = lines.sparkSession
    known = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(i).alias("t"), F.lit(a).alias("licence"), F.lit(b).alias("line")) for i, (a, b) in enumerate(templates)))))
    every = lines.select("line", "n").unionByName(known.select("line", F.lit(1).cast("long").alias("n")))
    df = every.select("n", F.explode(F.array_distinct(terms(F.col("line")))).alias("term")).groupBy("term").agg(F.sum("n").alias("df"))
    idf = df.join(F.broadcast(every.agg(F.sum("n").alias("total")))).select("term", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))

    def weighted(rows: DataFrame, key: str) -> DataFrame:
        tf = rows.select(key, F.explode(terms(F.col("line"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
        return tf.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("x"))

    def normed(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))

    a, b = weighted(lines, "line"), weighted(known, "t")
    # the templates' terms: as many rows as their words
    side = F.broadcast(b.join(normed(b, "t"), "t").select("t", "term", (F.col("x") / F.col("norm")).alias("y")))
    dots = a.join(side, "term").groupBy("line", "t").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("norm"), 6)
    near = dots.join(normed(a, "line"), "line").select("line", "t", cosine.alias("cosine")).where(F.col("cosine") >= LEAST)
    best = near.join(F.broadcast(known.select("t", "licence")), "t").groupBy("line").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "licence")).alias("b"))
    return best.select("line", F.col("b.licence").alias("licence"), (-F.col("b.minus")).alias("cosine"))


def _vectors(templates) -> tuple[dict[str, float], list[dict[str, float]]]:
    """idf of the templates' terms and their unit vectors."""
    bags = [Counter(t for t in re.split(TERM, text.lower()) if t) for _, text in templates]
    df = Counter(t for bag in bags for t in bag)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in df.items()}
    raw = [{t: (1 + math.log(n)) * idf[t] for t, n in bag.items()} for bag in bags]
    return idf, [{t: x / math.sqrt(sum(v * v for v in one.values())) for t, x in one.items()} for one in raw]


def signals(idf: dict[str, float], vectors: list[dict[str, float]]) -> list[tuple[list[str], int, list[str]]]:
    """For each vector: words, how many of them at least, and words one of which, at least, a unit that reaches LEAST has. By
    Cauchy-Schwarz the squared weights of the terms that it shares sum to LEAST ** 2 or more; the terms that most templates
    have and those of at most three characters are left out first."""
    least, out = (LEAST - 0.001) ** 2, []
    for one in vectors:
        words, rare = sorted(one, key=lambda t: (len(t) > 3, idf[t], t)), []
        left, many = 0.0, []
        for t in words:
            left += one[t] ** 2
            if left > SHARED:
                many.append(t)
            if left >= least:
                rare.append(t)
        gap, need = least - sum(one[t] ** 2 for t in one.keys() - set(many)), 0
        for x in sorted((one[t] ** 2 for t in many), reverse=True):
            if gap <= 0:
                break
            gap, need = gap - x, need + 1
        out.append((many, need, rare))
    return out


def may_reach(text: Column, found: list[tuple[list[str], int, list[str]]]) -> Column:
    """Whether ``text`` has enough of some vector's words."""
    literal = lambda ws: F.split(F.lit(" ".join(sorted(ws))), " ")
    hits = F.array_intersect(F.split(F.lower(text), TERM), literal({w for many, _, rare in found for w in (*many, *rare)}))
    sets = F.array(*(F.struct(F.lit(need).alias("need"), literal(many).alias("many"), literal(rare).alias("rare")) for many, need, rare in found))
    one = lambda h, s: (F.size(h) >= s.need) & F.arrays_overlap(h, s.rare) & (F.size(F.array_intersect(h, s.many)) >= s.need)
    return F.exists(F.array(hits), lambda h: F.exists(sets, lambda s: one(h, s)))


def scored_units(files: DataFrame) -> DataFrame:
    """(doc_id, _h, kind, licence, cosine) of the rows (doc_id, _h, text) with a unit that reaches LEAST; kind: 0 whole licence
    texts and notices, 1 one-line templates. Equal units are scored once."""
    spark = files.sparkSession
    long = licence_texts.templates()
    every = [(0, *t) for t in long] + [(1, *t) for t in TEMPLATES]
    idf, vectors = _vectors([t[1:] for t in every])
    rare = math.log(1 + len(every)) + 1
    words = signals(idf, vectors)
    few = [x for x, one in zip(words, vectors, strict=True) if len(one) < FEW_TERMS]
    names = spark.createDataFrame([(i, kind, licence) for i, (kind, licence, _) in enumerate(every)], "t int, kind int, licence string")
    weights = spark.createDataFrame(list(idf.items()), "term string, idf double")
    # one row for a term of the templates: idf and (template, weight)
    of: dict[str, list] = {t: [] for t in idf}
    for i, one in enumerate(vectors):
        for t, x in one.items():
            of[t].append((i, x))
    side = spark.createDataFrame(list(of.items()), "term string, at array<struct<t:int,y:double>>")
    docs = files.where(F.col("text").rlike(UNIT_CUES)).select("doc_id", "_h", "text")
    lines = F.split(F.col("text"), r"\r\n|\n|\r")
    runs = [F.transform(F.sequence(F.lit(1), F.size(lines) - k + 1), lambda i, k=k: F.array_join(F.slice(F.col("lines"), i, k), "\n")) for k in (2, 3, 4)]
    runs = [F.when(F.size("lines") >= k, run).otherwise(F.array().cast("array<string>")) for k, run in zip((2, 3, 4), runs, strict=True)]
    # comment marks are blank: a paragraph ends at a line without letters or digits
    units = F.concat(F.array("text"), F.split(F.col("text"), r"(?:\r\n|\n|\r)[^\p{L}\p{N}\r\n]*(?=\r|\n)"))
    # the longest templates are whole files: runs of lines are not scored for them
    docs = docs.withColumn("lines", lines)
    runs_or_all = F.concat(F.transform(units, lambda x: F.struct(F.lit(True).alias("whole"), x.alias("unit"))), F.transform(F.concat(*runs), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit"))))
    each = docs.select("doc_id", "_h", F.inline(F.filter(runs_or_all, lambda x: x.unit.rlike(UNIT_CUES))))
    each = each.where((F.col("whole") & may_reach(F.col("unit"), words)) | may_reach(F.col("unit"), few))
    found = written(each.select("doc_id", "_h", F.xxhash64("unit").alias("u"), "unit"))
    tf = found.dropDuplicates(["u"]).select("u", F.explode(terms(F.col("unit"))).alias("term")).groupBy("u", "term").agg((F.log(F.count("*")) + 1).alias("tf"))
    x = written(tf.join(F.broadcast(weights), "term", "left").select("u", "term", (F.col("tf") * F.coalesce("idf", F.lit(rare))).alias("x")))
    norms = x.groupBy("u").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = x.join(F.broadcast(side), "term").select("u", "x", F.inline("at")).groupBy("u", "t").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    near = dots.join(norms, "u").select("u", "t", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")).where(F.col("cosine") >= LEAST)
    best = near.join(F.broadcast(names), "t").groupBy("u", "kind").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "licence")).alias("b"))
    best = found.select("doc_id", "_h", "u").join(best, "u").groupBy("doc_id", "_h", "kind").agg(F.min("b").alias("b"))
    return best.select("doc_id", "_h", "kind", F.col("b.licence").alias("licence"), (-F.col("b.minus")).alias("cosine"))


def path_of() -> Column:
    """The directory of a row of ``documents``."""
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    part = lambda c: F.coalesce(F.col(c), F.lit("_"))
    top = F.concat_ws("/", part("source"), part("lang"))
    thousands = F.concat_ws("/", top, F.concat(F.lit("d"), F.floor(d / 1000).cast("string")))
    fifties = F.concat_ws("/", thousands, F.concat(F.lit("d"), F.floor(d / 50).cast("string")))
    return F.when(d % 1000 == 0, top).when(d % 100 == 0, thousands).otherwise(fifties)


def scan(docs: DataFrame, directory: Column | None = None) -> DataFrame:
    """doc_id, dir, own_licence, cosine, licence, found (header, inherited, none), licence_dir of every row."""
    place = directory if directory is not None else path_of()
    rows = docs.select("doc_id", place.alias("dir"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_h"), "text")
    heads = F.when(F.col("text").rlike(CUES), F.filter(F.split(F.col("text"), r"\r\n|\n|\r"), lambda x: x.rlike(CUES)))
    files = written(rows.select("doc_id", "dir", "_h", F.coalesce(heads, F.array().cast("array<string>")).alias("lines")))
    lines = files.select(F.explode("lines").alias("line")).groupBy("line").agg(F.count("*").alias("n"))
    scored = written(scored_lines(written(lines)))
    heads = files.where(F.size("lines") > 0).select("doc_id", "_h", F.explode("lines").alias("line"))
    single = heads.join(scored, "line").select("doc_id", "_h", F.lit(1).alias("kind"), "licence", "cosine")
    every = single.unionByName(scored_units(rows.select("doc_id", "_h", "text")))
    own = every.groupBy("doc_id", "_h").agg(F.min(F.struct("kind", (-F.col("cosine")).alias("minus"), "licence")).alias("b"))
    own = own.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_g"), F.col("b.licence").alias("own_licence"), (-F.col("b.minus")).alias("cosine"))
    judged = written(files.drop("lines").join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g")), "left").drop("_id", "_g", "_h"))
    order = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(keys.LAST)).alias("d"), "own_licence")
    licensed = judged.where("own_licence is not null").groupBy("dir").agg(F.min(order).alias("f")).select(F.col("dir").alias("up"), F.col("f.own_licence").alias("licence_up"))
    # each distinct directory with its ancestors, itself included
    parts = F.split(F.col("dir"), "/")
    ups = judged.select("dir").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("up"))
    nearest = ups.join(licensed, "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("deep"), "up", "licence_up")).alias("f"))
    nearest = nearest.select("dir", F.col("f.up").alias("licence_dir"), F.col("f.licence_up").alias("licence_up"))
    all_ = judged.join(nearest, "dir", "left")
    found = F.when(F.col("own_licence").isNotNull(), "header").when(F.col("licence_up").isNotNull(), "inherited").otherwise("none")
    return all_.select("doc_id", "dir", "own_licence", "cosine", F.coalesce("own_licence", "licence_up").alias("licence"), found.alias("found"), F.when(F.col("own_licence").isNull(), F.col("licence_dir")).alias("licence_dir"))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def sql() -> str:
    known = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(TEMPLATES))
    return rf"""
with known(t, licence, line) as (values {known}),
files as (select doc_id, coalesce(text, '') as text, case when d % 1000 = 0 then top when d % 100 = 0 then top || '/d' || floor(d / 1000.0)::bigint
    else top || '/d' || floor(d / 1000.0)::bigint || '/d' || floor(d / 50.0)::bigint end as dir
  from (select doc_id, text, coalesce(doc_id, -1) as d, coalesce(source, '_') || '/' || coalesce(lang, '_') as top from documents)),
heads as (select doc_id, text, unnest(list_filter(regexp_split_to_array(text, '\r\n|\n|\r'), lambda x: regexp_matches(x, '{CUES}'))) as line from files),
lines as (select line, count(*) as n from heads group by line),
every as (select line, n from lines union all select line, 1 from known),
words as (select line, list_filter(regexp_split_to_array(lower(line), '{TERM}'), lambda x: length(x) > 0) as ws from (select distinct line from every)),
df as (select term, sum(n) as df from (select n, unnest(list_distinct(ws)) as term from every join words using (line)) group by term),
idf as (select term, ln((1 + (select sum(n) from every)) / (1 + df)) + 1 as idf from df),
tf as (select line, term, count(*) as tf from (select line, unnest(ws) as term from words) group by line, term),
x as (select line, term, tf * idf as x from tf join idf using (term)),
norm as (select line, sqrt(sum(x * x)) as norm from x group by line),
y as (select t, term, x / norm as y from known join x using (line) join norm using (line)),
near as (select line, licence, round(dot / norm, 6) as cosine from (select line, t, sum(x * y) as dot from x join y using (term) group by line, t) join norm using (line) join known k using (t)),
fine as (select line, licence, cosine from (select n.line, n.licence, n.cosine, row_number() over (partition by n.line order by cosine desc, licence) as r from near n) where cosine >= {LEAST} and r = 1),
own as (select doc_id, text, licence as own_licence, cosine from (select doc_id, text, licence, cosine, row_number() over (partition by doc_id, text order by cosine desc, licence) as r from heads join fine using (line)) where r = 1),
judged as (select f.doc_id, dir, own_licence, cosine from files f left join own o on f.doc_id is not distinct from o.doc_id and f.text = o.text),
licensed as (select dir as up, own_licence as licence_up from judged where own_licence is not null
  qualify row_number() over (partition by dir order by coalesce(doc_id, 9223372036854775807), own_licence) = 1),
ups as (select dir, unnest(list_transform(range(1, len(string_split(dir, '/')) + 1), lambda k: array_to_string(string_split(dir, '/')[1:k], '/'))) as up from (select distinct dir from judged)),
nearest as (select dir, arg_max(up, length(up)) as licence_dir, arg_max(licence_up, length(up)) as licence_up from ups join licensed using (up) group by dir)
select doc_id, j.dir, own_licence, cosine, coalesce(own_licence, licence_up) as licence,
  case when own_licence is not null then 'header' when licence_up is not null then 'inherited' else 'none' end as found,
  case when own_licence is null then licence_dir end as licence_dir
from judged j left join nearest n on j.dir = n.dir
"""
