"""License scans with DataFrame functions only.

Templates and texts are compared on five-word shingles. A template of n words
is looked for in windows of ``n + 2 * stride`` words that begin at every
multiple of its stride, a quarter of n: a notice with up to a quarter of
further words put in lies whole within one of them. Each window has a MinHash
signature of ``BANDS`` bands; equal bands retrieve templates; exact
containment of the template's shingles in the window, at least ``LEAST``,
verifies.

A window that holds three quarters of its template has a similarity of a third
or more, so with ``BANDS`` bands of one row it is retrieved with a probability
over 0.99999. A band's value is the least of its window's salted hashes: a
window can only share a template's band if it holds the very shingle that is
the template's least there. So only windows over such a shingle are built, and
they alone leave their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlex.llm.decontaminate import _hashes, _with_hashes, words_of
from driftlex.llm.nativetext import window_hash

WIDTH, LEAST = 5, 0.75
BANDS = 32
#: Least shingles of templates that one pass looks for (8 bytes each in the plan); more are looked for in several.
MOST_SENT = 200_000
#: Templates whose bands (32 rows, each with the template's shingles) may be broadcast; more are joined.
MOST_BROADCAST = 2000

# Wording of common license notices and of whole short licenses.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-3.0", "Distributed under the terms of the GNU General Public License v3."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
    ),
    (
        "bsd-3-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO "
        "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
]


def _salted(i: int):
    return lambda x: F.xxhash64(x, F.lit(i))


def _signature(shingles) -> Column:
    """Band values of an array of shingle hashes."""
    return F.array(*[F.array_min(F.transform(shingles, _salted(b))) for b in range(BANDS)])


def stride_of(length: int) -> int:
    return max(1, length // 4)


def _least_of(marks: Column) -> Column:
    """The shingles that are the least in some band."""
    return F.array_distinct(F.array(*[F.array_min(F.transform(marks, lambda x, b=b: F.struct(F.xxhash64(x, F.lit(b)).alias("v"), x.alias("x"))))["x"] for b in range(BANDS)]))


def templates(spark: SparkSession, rows: list[tuple[str, str]] | None = None) -> DataFrame:
    """(template, license, length, marks, least): distinct shingle hashes, and those that are least in a band.

    Texts shorter than a shingle, and null ones, are none.
    """
    made = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(TEMPLATES if rows is None else rows)], "template int, license string, text string")
    df = made.withColumn("words", words_of(F.col("text"))).where(F.size("words") >= WIDTH)
    df = _with_hashes(df, [WIDTH])
    marks = F.array_distinct(F.slice(window_hash(_hashes([WIDTH]), WIDTH), F.lit(1), F.size("words") - WIDTH + 1))
    df = df.select("template", "license", F.size("words").alias("length"), marks.alias("marks"))
    return df.withColumn("least", _least_of(F.col("marks")))


def _among(values: list[int]):
    return lambda x: x.isin(values)


def find_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """A row for each document: ``doc_id, n_licenses, licenses, spans``.

    ``licenses`` lists what was found, sorted; ``spans`` gives license:first:end in words for each run of
    verified windows. Null and empty texts hold none, nor do those of fewer words than a shingle; texts of any
    length are taken whole. Repeated rows are judged each by itself; other columns, whatever their names, are
    ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    known = templates(spark) if known is None else known
    # lengths, and the least shingles by length: BANDS for a template at most
    wanted: dict[int, set[int]] = {}
    for r in known.select("length", "least").toLocalIterator():
        wanted.setdefault(r["length"], set()).update(r["least"])
    passes: list[dict[int, list[int]]] = [{}]
    room = MOST_SENT
    for length, values in sorted(wanted.items()):
        values = sorted(values)
        while values:
            if not room:
                passes.append({})
                room = MOST_SENT
            passes[-1].setdefault(length, []).extend(values[:room])
            values, room = values[room:], room - len(values[:room])
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows go by what they hold, in one lineage: row numbers would differ from one reading of the input to the next
    own = own.select("doc_id", F.xxhash64("doc_id", "text").alias("one"), F.xxhash64(F.lit("two"), "text", "doc_id").alias("two"), words_of(F.col("text")).alias("words"))
    own = _with_hashes(own, [WIDTH]).withColumn("sh", F.slice(window_hash(_hashes([WIDTH]), WIDTH), F.lit(1), F.greatest(F.size("words") - WIDTH + 1, F.lit(0))))
    own = own.select("doc_id", "one", "two", "sh")
    for i, part in enumerate(passes):
        own = own.withColumn(f"met{i}", _met(part))
    row = F.array(F.struct(F.lit(-1).alias("start"), F.lit(0).alias("length"), F.array().cast("array<bigint>").alias("part")))
    near = F.concat(row, *[F.when(F.size(f"met{i}") > 0, F.concat(*[_near(f"met{i}", n, values) for n, values in part.items()])).otherwise(_none()) for i, part in enumerate(passes) if part])
    # the first window of each row is none, and stands for the row; it has no band and meets nothing
    each = own.select("doc_id", "one", "two", F.explode_outer(near).alias("w")).select("doc_id", "one", "two", "w.start", "w.length", F.array_distinct("w.part").alias("part"))
    bands = F.when(F.col("start") >= 0, _signature(F.col("part")))
    banded = each.select("doc_id", "one", "two", "start", "length", "part", F.posexplode_outer(bands).alias("band", "value"))
    banded = banded.withColumn("band", F.coalesce("band", F.lit(-1))).withColumn("value", F.coalesce("value", "one"))
    index = known.select("license", "length", "marks", F.posexplode(_signature(F.col("marks"))).alias("band", "value"))
    index = F.broadcast(index) if known.count() <= MOST_BROADCAST else index
    met = banded.join(index, ["length", "band", "value"], "left")
    held = F.size(F.array_intersect("part", "marks")) >= LEAST * F.size("marks")
    span = F.struct("license", "start", (F.col("start") + F.size("part") + WIDTH - 1).alias("end"))
    out = met.groupBy("doc_id", "one", "two").agg(F.count(F.when(F.col("start") < 0, 1)).alias("copies"), F.array_sort(F.collect_set(F.when(F.col("license").isNotNull() & held, span))).alias("found"))
    out = out.select("doc_id", "found", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda f: f["license"])))
    return out.select("doc_id", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.array_join(F.transform(_merged("found"), lambda f: F.concat_ws(":", f["license"], f["start"].cast("string"), f["end"].cast("string"))), ",").alias("spans"))


def _none() -> Column:
    return F.array().cast("array<struct<start:int,length:int,part:array<bigint>>>")


def _met(wanted: dict[int, list[int]]) -> Column:
    """Places of the shingles that some template wants."""
    none = F.array().cast("array<struct<x:bigint,i:int>>")
    every = sorted({v for values in wanted.values() for v in values})
    if not every:
        return none
    at = F.filter(F.transform("sh", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"].isin(every))
    return F.when(F.exists("sh", _among(every)), at).otherwise(none)


def _near(met: str, n: int, values: list[int]) -> Column:
    """Windows for templates of n words over the shingles met; at the text's end they are shorter."""
    stride = stride_of(n)
    width = n + 2 * stride - WIDTH + 1
    hits = F.filter(met, lambda m: m["x"].isin(values))
    first = lambda m: F.ceil(F.greatest(m["i"] - width + 1, F.lit(0)) / stride).cast("int")
    last = lambda m: F.floor(m["i"] / stride).cast("int")
    starts = F.array_distinct(F.flatten(F.transform(hits, lambda m: F.when(first(m) <= last(m), F.sequence(first(m), F.greatest(first(m), last(m)))).otherwise(F.array().cast("array<int>")))))
    return F.transform(starts, lambda s: F.struct((s * stride).alias("start"), F.lit(n).alias("length"), F.slice(F.col("sh"), s * stride + 1, F.lit(width)).alias("part")))


def _merged(found: str):
    """Overlapping windows of a license as one."""
    none = F.array().cast("array<struct<license:string,start:int,end:int>>")

    def step(acc, f):
        joins = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["license"] == f["license"]) & (F.try_element_at(acc, F.lit(-1))["end"] >= f["start"])
        grown = F.struct(f["license"].alias("license"), F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], f["end"]).alias("end"))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(f)))

    return F.aggregate(found, none, step)


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    return find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_licenses", "licenses")


_WORDS = r"regexp_extract_all(translate(coalesce(%s, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
with t as (select row_number() over () as template, * from (values {", ".join("('%s', '%s')" % (n, x.replace("'", "''")) for n, x in TEMPLATES)}) v(license, text)),
tw as (select template, license, {_WORDS % "text"} as words from t),
ts as (select distinct template, license, n, greatest(n // 4, 1) as stride, array_to_string(words[i:i + {WIDTH - 1}], ' ') as sh from (select template, license, words, len(words) as n, unnest(range(1, len(words) - {WIDTH} + 2)) as i from tw)),
need as (select template, license, count(*) as k from ts group by all),
d as (select row_number() over () as rid, doc_id, {_WORDS % "text"} as words from documents),
ds as (select rid, i, array_to_string(words[i + 1:i + {WIDTH}], ' ') as sh from (select rid, words, unnest(range(0, len(words) - {WIDTH} + 1)) as i from d where len(words) >= {WIDTH})),
hit as (select rid, i, template, n, stride, ds.sh from ds join ts on ds.sh = ts.sh),
win as (select rid, template, sh, unnest(range(cast(ceil(greatest(i + {WIDTH} - n - 2 * stride, 0) / stride) as bigint), i // stride + 1)) as s from hit),
ok as (select distinct w.rid, license from (select rid, template, s, count(distinct sh) as c from win group by all) w join need using (template) where c >= {LEAST} * k),
l as (select rid, count(*) as n_licenses, string_agg(license, ',' order by license) as licenses from ok group by rid)
select doc_id, coalesce(n_licenses, 0) as n_licenses, coalesce(licenses, '') as licenses from d left join l using (rid)
"""
