"""JSON values one after another, in any layout, from texts or from files of any size.

A scan knows strings and brackets only: it follows the depth of nesting, and a
value is what lies between two places of depth 0. JSON strings hold no line
breaks, so at the begin of a line the depth is all there is to know. Files are
read in ranges, as lines: each range first tells by how much it changes the
depth; sums over the ranges before give each its depth at the begin; then each
cuts out its values, and pieces of those that reach over ranges are joined.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlex.sources.shared import stored

_MARK = re.compile(r'"(?:[^"\\\n]|\\.)*"|[{\[]|[}\]]|"|[^\s﻿{}\[\]"]+')
#: Ranges whose depths (a few numbers each) may be broadcast; more are joined.
MOST_BROADCAST = 100_000


def _steps(text: str) -> Iterator[tuple[int, int, int]]:
    """(begin, end, change of depth) of each bracket, string and run of other signs."""
    for m in _MARK.finditer(text):
        first = text[m.start()]
        yield m.start(), m.end(), 1 if first in "{[" else -1 if first in "}]" else 0


def spans(text: str) -> Iterator[tuple[int, int]]:
    """Begin and end of each value of a text; what isn't closed, or closes nothing, has one too."""
    depth = begin = 0
    for a, b, change in _steps(text):
        if not depth:
            begin = a
        depth = max(0, depth + change)
        if not depth:
            yield begin, b
    if depth:
        yield begin, len(text)


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def json_values(rows: DataFrame, text: str, strict: bool = False) -> DataFrame:
    """A row for each JSON value in ``text``, one after another in any layout: other columns, ``index``, and ``json``, the value's text.

    Reading of a text ends at what is no JSON, as a record that is still being written; if ``strict``, that is an error.
    """
    kept = [f for f in rows.schema.fields if f.name != text]
    names = [f.name for f in kept]

    def values(cell: str) -> Iterator[str]:
        for a, b in spans(cell):
            if not _is_json(cell[a:b]):
                if strict:
                    raise ValueError(f"no JSON at position {a}")
                return
            yield cell[a:b]

    def run(batches):
        for batch in batches:
            found = [list(values(cell.as_py() or "")) for cell in batch.column(batch.num_columns - 1)]
            own = batch.take(pa.array([i for i, v in enumerate(found) for _ in v], pa.int64()))
            index = pa.array([n for v in found for n in range(len(v))], pa.int32())
            yield pa.RecordBatch.from_arrays([*own.columns[:-1], index, pa.array([x for v in found for x in v], pa.string())], names=[*names, "index", "json"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "index int, json string"
    return rows.select(*[F.col(f"`{c}`") for c in names], F.col(text).cast("string")).mapInArrow(run, schema)


def _ranges(batches) -> Iterator[tuple[str, int, Iterator[str]]]:
    """(file, range, its lines in order), from the rows of a task: (file, range, line)."""
    from itertools import groupby

    def rows():
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)

    for (file, part), own in groupby(rows(), key=lambda r: (r[0], r[1])):
        yield file, part, (r[2] for r in own)


def _changes(batches):
    """Of each range by how much it changes the depth."""
    for file, part, lines in _ranges(batches):
        change = sum(c for line in lines for _, _, c in _steps(line))
        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([part], pa.int64()), pa.array([change], pa.int64())], names=["file", "part", "change"])


def _pieces(depths: dict):
    """Values and pieces of values of each range: kind ``whole``, ``end`` (of one begun before; with ``closed``) or ``begin``."""

    def run(batches):
        for file, part, lines in _ranges(batches):
            depth = depths.get((file, part), 0)
            inherited, n, open_ = depth > 0, 0, []
            out: list[tuple[str, int, bool, str]] = []
            held = 0
            for line in lines:
                begin = 0
                for a, b, change in _steps(line):
                    if not depth and not open_:
                        begin = a
                    depth = max(0, depth + change)
                    if not depth:
                        text = "\n".join([*open_, line[begin:b]])
                        out.append(("end", -1, True, text) if inherited else ("whole", n, True, text))
                        n, inherited, open_, begin = n + (not inherited), False, [], b
                        held += len(text)
                if depth:
                    open_.append(line[begin:])
                if held > 4 << 20:
                    yield _batch(file, part, out)
                    out, held = [], 0
            if depth:
                out.append(("end", -1, False, "\n".join(open_)) if inherited else ("begin", n, False, "\n".join(open_)))
            if out:
                yield _batch(file, part, out)

    return run


def _batch(file: str, part: int, rows: list[tuple]) -> pa.RecordBatch:
    kind, n, closed, text = zip(*rows, strict=True)
    k = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([file] * k), pa.array([part] * k, pa.int64()), pa.array(kind), pa.array(n, pa.int64()), pa.array(closed), pa.array(text, pa.string())], names=["file", "part", "kind", "n", "closed", "json"])


def file_values(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(file, modified, index, json): the values of each file, read in ranges of ``spark.sql.files.maxPartitionBytes``.

    Reading of a file ends at what is no JSON; if ``strict``, that is an error. A task holds a line, or a value, at a time.
    """
    source = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("part"), "value", F.col("_metadata.file_modification_time").alias("modified"))
    lines = source.select("file", "part", "value")
    stamps = source.groupBy("file").agg(F.max("modified").alias("modified"))
    along = Window.partitionBy("file").orderBy("part")  # a row for each range of a file
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    changes = lines.mapInArrow(_changes, "file string, part long, change long")
    depths = changes.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    begins = {(r["file"], r["part"]): r["depth"] for r in depths.where("depth > 0").toLocalIterator()}  # ranges that begin within a value
    if len(begins) > MOST_BROADCAST:
        raise ValueError("more ranges than can be told to each task: raise spark.sql.files.maxPartitionBytes")
    cut = stored(lines.mapInArrow(_pieces(begins), "file string, part long, kind string, n long, closed boolean, json string"))
    # a value's owner is the range that it begins in
    each = cut.groupBy("file", "part").agg(F.max(F.when(F.col("kind") == "begin", F.col("n"))).alias("begun"))
    owner = F.last(F.when(F.col("begun").isNotNull(), F.struct("part", "begun")), ignorenulls=True).over(before)
    owners = each.withColumn("owner", owner).select("file", "part", "owner.part", "owner.begun").toDF("file", "part", "owner", "begun")
    ends = cut.where("kind = 'end'").join(owners, ["file", "part"]).select("file", F.coalesce("owner", "part").alias("owner"), F.coalesce("begun", F.lit(-1)).alias("n"), "part", "json")
    starts = cut.where("kind = 'begin'").select("file", F.col("part").alias("owner"), "n", "part", "json")
    joined = starts.unionByName(ends).groupBy("file", "owner", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "json"))), lambda x: x["json"]), "\n").alias("json"))
    every = cut.where("kind = 'whole'").select("file", "part", "n", "json").unionByName(joined.withColumnRenamed("owner", "part"))
    every = stored(every.withColumn("ok", _valid(F.col("json"))))
    bad = every.where("not ok").groupBy("file").agg(F.min(F.struct("part", "n")).alias("bad"))
    if strict and (first := bad.orderBy("file").first()):
        raise ValueError(f"no JSON in {first['file']}, in the range at {first['bad']['part']}")
    good = every.join(bad, "file", "left").where(F.col("bad").isNull() | (F.struct("part", "n") < F.col("bad")))
    sizes = good.groupBy("file", "part").agg(F.count("*").alias("here"))
    offset = sizes.withColumn("offset", F.coalesce(F.sum("here").over(before), F.lit(0))).select("file", "part", "offset")
    out = good.join(offset, ["file", "part"]).join(stamps, "file")
    return out.select("file", "modified", (F.col("offset") + F.col("n")).cast("int").alias("index"), "json")


def _valid(text: Column) -> Column:
    return F.arrow_udf(lambda t: pa.array([_is_json(x.as_py()) for x in t]), "boolean")(text)
