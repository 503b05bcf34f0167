"""N-gram Jaccard self-join of documents and its connected components.

Method: rare-first prefix filtering. Texts become sets of 64-bit shingle
hashes; equal sets collapse into a class, of which one row goes on. A shingle
of one class only can lie in no intersection, so classes keep their *shared*
shingles, ordered by rising document frequency, and are matched on their
prefixes under length, positional and suffix filters. Each surviving pair is
verified once, on whole sets.

Scale. Rows are dealt in blocks of some megabytes of text. A block sends each
hash range its shingles as 5 bytes and 2 bytes for the row within the block,
and gets back the shared ones with their frequency, to be put together block
by block: what a shingle costs doesn't grow with the number of ranges or rows.
Shingles that a large share of a task's documents hold are found first by
lossy counting and travel apart, so no hash range grows with one passage. A
shingle's token, the bits that name its range and 40 more, is at least 45 bits
wide and widens with the input; two shingles with one token are taken for
shared, and two texts of a thousand shingles each meet in a false one with a
probability of about 1 in 30 million.

A prefix group of n classes yields n pairs with its centre, not n^2; what the
centres have joined needs no more pairs, and only groups that still span
several components are compared in full, across components: small ones by a
join, large ones in packed blocks, each class outside the main component
against the rest, once. That loses no link that could join two components.
A class is known by its least document id first, so the least vertex of a
component is the component's id and no join gathers a component's classes.

Links are counted once components are known: classes of one component that
share a prefix shingle are dealt in chunks, and a chunk meets each class that
shares one with any of its own once, in blocks bounded by shingles. Counts of
rows come back, not pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlex.llm.components import components, forest
from driftlex.llm.npwords import SPACE, Words, release_memory, shingle_sets, text_chunks
from driftlex.llm.rowflags import row_key, settle, surplus
from driftlex.llm.scratch import bounded_batches, discard, materialise

#: A shingle is common if it lies in more than this share of the documents that a task has seen.
COMMON_SHARE = 1 / 1000
#: Most common shingles sent to all tasks: 16 MB of hashes and counts. The rest take the ordinary way.
MOST_COMMON = 1 << 20
#: Shingles of documents that one hash range should hold; text bytes and rows of a block.
RANGE_SHINGLES, BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 8 << 20, 1 << 16
#: Ranks of common shingles begin here; the others have eight times the binary logarithm of their frequency.
COMMON_RANK = 1024
BUCKETS = 16
#: Entries up to which a prefix group is simply joined with itself; chunk and block sizes for larger ones.
LARGE, CHUNK, BLOCK = 1024, 512, 4096
#: Shingles of a chunk or block of classes whose links are counted: 8 MB, or one class.
PACK = 1 << 20


def _least_overlap(n: str) -> str:
    return f"int(ceil({n} * 0.75D))"


def _signature(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


_INFO = "doc_id long, key long, n long, sig long, h long, c long"


def _scan(width: int):
    """Per document: id, key, set size, class signature. Besides: hashes common in this task, with counts."""

    def run(batches):
        keys, counts, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        names = [c.split()[0] for c in _INFO.split(", ")]
        for batch in batches:
            ids, own, texts = (batch.column(i) for i in range(3))
            for a, b, data, off in text_chunks(texts):
                sets = shingle_sets(Words(data, off, SPACE), width)
                sig = [_signature(s) if len(s) else None for s in sets]
                fresh = {g: s for g, s in zip(sig, sets, strict=True) if g is not None}
                seen += len(fresh)
                n = [len(s) for s in sets]
                none = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), own.slice(a, b - a), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), none, none], names=names)
                if fresh:
                    h, c = np.unique(np.concatenate(list(fresh.values())), return_counts=True)
                    keep = c > 1
                    both = np.concatenate([keys, h[keep]])
                    keys, back = np.unique(both, return_inverse=True)
                    counts = np.bincount(back, np.concatenate([counts, c[keep]]).astype(float), len(keys)).astype(np.int64)
                    if seen > 1 / COMMON_SHARE:
                        keep = counts > COMMON_SHARE * seen
                        keys, counts = keys[keep], counts[keep]
        keep = counts > max(16, COMMON_SHARE * seen)
        if keep.any():
            h = keys[keep].view(np.int64)
            z = pa.nulls(len(h), pa.int64())
            yield pa.RecordBatch.from_arrays([z, z, z, z, pa.array(h), pa.array(counts[keep])], names=names)
        release_memory()

    return run


# A piece of a block: its shingles of one range (kind 0), its classes (1), or its common shingles (2).
_PIECE = "part int, kind int, block long, who binary, tokens binary, ranks binary"
_PIECES = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("who", pa.binary()), ("tokens", pa.binary()), ("ranks", pa.binary())])


def _five(x: np.ndarray) -> bytes:
    """The low 40 bits of each value."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unfive(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return wide.reshape(-1).view("<u8")


def _deal(width: int, bits: int, common):
    """Pieces of each block of rows. ``bits`` of a hash name its range, the next 40 are sent."""

    def pieces(block, sigs, parts):
        hot = common.value[0]
        rows = []
        size = np.array([len(p) for p in parts])
        h = np.concatenate(parts)
        who = np.repeat(np.arange(len(sigs), dtype=np.uint16), size)
        at = np.minimum(np.searchsorted(hot, h), max(0, len(hot) - 1))
        is_hot = hot[at] == h if len(hot) else np.zeros(len(h), bool)
        # what is known without counting goes to any range: classes with their sizes, and common shingles
        spread = sigs[0] & ((1 << bits) - 1)
        rows.append((spread, 1, block, np.array(sigs, np.int64).tobytes(), size.astype(np.uint32).tobytes(), b""))
        if is_hot.any():
            rows.append((spread, 2, block, who[is_hot].tobytes(), at[is_hot].astype(np.uint32).tobytes(), b""))
            h, who = h[~is_hot], who[~is_hot]
        p = (h >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
        order = np.argsort(p, kind="stable")
        p, who = p[order], who[order]
        token = (h[order] << np.uint64(bits)) >> np.uint64(24)
        cut = np.flatnonzero(np.append(True, p[1:] != p[:-1])).tolist() if len(p) else []
        for a, b in zip(cut, [*cut[1:], len(p)], strict=False):
            rows.append((int(p[a]), 0, block, who[a:b].tobytes(), _five(token[a:b]), b""))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES, strict=True)], schema=_PIECES)

    def run(batches):
        sigs, parts, held = [], [], 0
        for batch in batches:
            for _, _, data, off in text_chunks(batch.column(0)):
                for s in shingle_sets(Words(data, off, SPACE), width):
                    if len(s):
                        sigs.append(_signature(s))
                        parts.append(s)
                held += len(data)
                while len(sigs) >= BLOCK_ROWS or held >= BLOCK_BYTES and sigs:
                    yield pieces(sigs[0], sigs[:BLOCK_ROWS], parts[:BLOCK_ROWS])
                    sigs, parts, held = sigs[BLOCK_ROWS:], parts[BLOCK_ROWS:], 0
        if sigs:
            yield pieces(sigs[0], sigs, parts)
        del sigs, parts
        release_memory()

    return run


def _count(table: pa.Table) -> pa.Table:
    """In one hash range: of each piece the shingles that two classes or more hold, with the rank of their frequency."""
    kind = np.asarray(table["kind"])
    own = table.filter(pa.array(kind == 0))
    rest = table.filter(pa.array(kind != 0))
    who, tokens = own["who"].to_pylist(), own["tokens"].to_pylist()
    x = _unfive(b"".join(tokens))
    order = np.argsort(x)
    s = x[order]
    cut = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    df = np.diff(np.append(cut, len(s)))
    rank = np.zeros(len(x), np.uint16)
    rank[order] = np.repeat(np.where(df > 1, np.floor(8 * np.log2(np.maximum(df, 1))), 0).astype(np.uint16), df)
    keep = rank > 0
    sizes = np.array([len(t) // 5 for t in tokens], np.int64)
    to = np.cumsum(sizes)
    rows = []
    for i, (a, b) in enumerate(zip((to - sizes).tolist(), to.tolist(), strict=True)):
        k = keep[a:b]
        if k.any():
            rows.append((own["part"][i].as_py(), 0, own["block"][i].as_py(), np.frombuffer(who[i], np.uint16)[k].tobytes(), _five(x[a:b][k]), rank[a:b][k].tobytes()))
    got = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES, strict=True)], schema=_PIECES) if rows else _PIECES.empty_table()
    return pa.concat_tables([got, rest.cast(_PIECES)])


def _gather(bits: int, common):
    """Of a block's classes those whose shared shingles could make a similarity of 0.75: size, shared shingles rare first, bucket counts."""

    def run(table: pa.Table) -> pa.Table:
        hot, hot_rank = common.value
        who, tok, rank, sig, n = [], [], [], None, None
        for row in table.select(["part", "kind", "who", "tokens", "ranks"]).to_pylist():
            if row["kind"] == 1:
                sig, n = np.frombuffer(row["who"], np.int64), np.frombuffer(row["tokens"], np.uint32).astype(np.int64)
                continue
            who.append(np.frombuffer(row["who"], np.uint16).astype(np.int64))
            if row["kind"] == 0:
                tok.append(_unfive(row["tokens"]) | np.uint64(row["part"] << 40))
                rank.append(np.frombuffer(row["ranks"], np.uint16))
            else:
                at = np.frombuffer(row["tokens"], np.uint32)
                tok.append(hot[at] >> np.uint64(24 - bits))
                rank.append(hot_rank[at])
        who, tok, rank = (np.concatenate(v) if v else np.zeros(0, t) for v, t in ((who, np.int64), (tok, np.uint64), (rank, np.uint16)))
        shared = np.bincount(who, minlength=len(sig))
        fit = (shared > 0) & (4 * shared >= 3 * n)
        use = fit[who]
        who, tok, rank = who[use], tok[use], rank[use]
        order = np.lexsort((tok, rank, who))
        who, tok = who[order], tok[order]
        place = np.cumsum(fit) - 1
        k = int(fit.sum())
        spread = np.bincount(place[who] * BUCKETS + (tok >> np.uint64(36 + bits)).astype(np.int64), minlength=k * BUCKETS)
        off = np.append(0, np.cumsum(shared[fit]))
        return pa.table(
            [
                pa.array(sig[fit]),
                pa.array(n[fit].astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(tok.view(np.int64))),
                pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * BUCKETS, pa.int32()), pa.array(spread.astype(np.int32))),
            ],
            names=["sig", "n", "toks", "spread"],
        )

    return run


def _verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of similar classes: length and suffix filters first, then whole sets, once a pair."""
    small = classes.select("sig", "n", "spread")
    left = small.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("spread").alias("sa"))
    right = small.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("spread").alias("sb"))
    # suffix filter: within each part of the hash space no more can meet than the smaller side has there
    could = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    some = (
        pairs.join(left, "a")
        .join(right, "b")
        .where("4 * least(na, nb) >= 3 * greatest(na, nb)")
        .where(could * 7 >= (F.col("na") + F.col("nb")) * 3)
        .select("a", "b", "na", "nb")
    )
    toks = classes.select("sig", "toks")
    meet = F.size(F.array_intersect("ta", "tb"))
    return (
        some.join(toks.select(F.col("sig").alias("a"), F.col("toks").alias("ta")), "a")
        .join(toks.select(F.col("sig").alias("b"), F.col("toks").alias("tb")), "b")
        .where(meet * 7 >= (F.col("na") + F.col("nb")) * 3)
        .select("a", "b")
    )


def shingle_classes(docs: DataFrame, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows with key, set size and class signature, candidate classes with their shared shingles)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text").cast("string").alias("text"))
    scan = materialise(own.mapInArrow(_scan(width), _INFO), "scan")
    hot = scan.where("h is not null").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(MOST_COMMON).toArrow()
    keys, count = np.asarray(hot["h"], np.int64).view(np.uint64), np.asarray(hot["c"], np.int64)
    order = np.argsort(keys)
    ranks = COMMON_RANK + np.floor(8 * np.log2(np.maximum(count, 1))).astype(np.uint16)
    common = spark.sparkContext.broadcast((keys[order], ranks[order]))
    info = scan.where("h is null").select("doc_id", "key", "n", "sig")
    total = info.agg(F.sum("n")).first()[0] or 0
    want = max(32, int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE_SHINGLES)
    bits = min(24, (want - 1).bit_length())
    # one row of each class
    copies = materialise(surplus(info.where("sig is not null"), "sig"), "copies")
    texts = settle(own.select("key", "text"), copies)
    dealt = texts.select("text").mapInArrow(_deal(width, bits, common), _PIECE)
    shared = dealt.groupBy("part").applyInArrow(_count, _PIECE)
    classes = shared.groupBy("block").applyInArrow(_gather(bits, common), "sig long, n int, toks array<long>, spread array<int>")
    classes = materialise(classes, "classes")
    discard(copies)
    return info, classes


def _large_groups(entries: DataFrame, classes: DataFrame) -> DataFrame:
    """Links across components in large prefix groups, found in packed blocks.

    ``entries``: (tok, sig, root, main) of the groups, ``main`` being a group's largest component. Classes
    outside it are dealt in chunks by the largest group that they are in; a chunk meets each class of its
    groups once, whatever number of shingles they share, in blocks of bounded size.
    """
    strays = entries.where("root <> main")
    hubs = strays.groupBy("sig").agg(F.max(F.struct("m", "tok")).alias("hub")).select("sig", F.col("hub.tok").alias("hub"))
    many = hubs.groupBy("hub").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    chunked = materialise(hubs.join(many, "hub").select("sig", F.xxhash64("hub", F.pmod(F.xxhash64("sig"), F.col("chunks"))).alias("chunk")), "chunks")
    groups = strays.join(chunked, "sig").select("chunk", "tok").distinct()
    met = materialise(entries.select("tok", "sig", "root").join(groups, "tok").select("chunk", "sig", "root").distinct(), "met")
    blocks = met.groupBy("chunk").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    sets = classes.select("sig", "n", "toks")
    right = met.join(blocks, "chunk").select("chunk", F.pmod(F.xxhash64("sig"), F.col("blocks")).alias("block"), "sig", "root").join(sets, "sig")
    own = met.join(chunked, ["chunk", "sig"]).join(blocks, "chunk")
    left = own.select("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "sig", "root").join(sets, "sig")
    left = left.toDF(*left.columns)  # fresh attributes: both sides come from the same tables
    return left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(_compare, "a long, b long")


def _compare(left: pa.Table, right: pa.Table) -> pa.Table:
    """One link of each left class to each other component that it is similar to a class of."""
    a, b = [], []
    if left.num_rows and right.num_rows:
        toks = right["toks"].combine_chunks()
        owner = np.repeat(np.arange(len(toks)), np.diff(np.asarray(toks.offsets)))
        value = np.asarray(toks.flatten())
        order = np.argsort(value)
        value, owner = value[order], owner[order]
        n, sig, root = (np.asarray(right[c].combine_chunks()) for c in ("n", "sig", "root"))
        for row in range(left.num_rows):
            own = np.asarray(left["toks"][row].values)
            size, home, mine = (left[c][row].as_py() for c in ("n", "root", "sig"))
            lo, hi = np.searchsorted(value, own, "left"), np.searchsorted(value, own, "right")
            k = hi - lo
            at = np.repeat(hi - np.cumsum(k), k) + np.arange(k.sum())
            meet = np.bincount(owner[at], minlength=len(n))
            near = np.flatnonzero((7 * meet >= 3 * (n + size)) & (root != home))
            _, first = np.unique(root[near], return_index=True)
            a.extend([mine] * len(first))
            b.extend(sig[near[first]].tolist())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _prefixes(classes: DataFrame) -> DataFrame:
    """(tok, sig, n, pos): the shared shingles of each class's prefix with their places."""
    # full order: the n - size(toks) unshared shingles come before all shared ones
    prefix = f"n - {_least_overlap('n')} + 1 - (n - size(toks))"
    entries = classes.selectExpr("sig", "n", f"posexplode(slice(toks, 1, {prefix})) as (k, tok)", "n - size(toks) as unshared")
    return entries.selectExpr("tok", "sig", "n", "k + unshared as pos")


def linked_classes(classes: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, root): components of the graph of classes with a similarity of 0.75 or more.

    ``vertices`` has the vertex of each class: ``sig, v``, v being a struct that ends in the ``sig``.
    """
    entries = materialise(_prefixes(classes), "entries")
    centres = entries.groupBy("tok").agg(F.min(F.struct("sig", "n", "pos")).alias("c"), F.count("*").alias("m")).where("m > 1").drop("m")
    near = "4 * least({0}.n, {1}.n) >= 3 * greatest({0}.n, {1}.n)"  # length filter
    # positional filter: with this shingle the first in common, no more can follow than either side has left
    could = "7 * least({0}.n - {0}.pos, {1}.n - {1}.pos) >= 3 * ({0}.n + {1}.n)"
    stars = entries.alias("e").join(centres.select("tok", "c.*").alias("c"), F.expr("e.tok = c.tok and c.sig < e.sig and " + near.format("e", "c")))
    stars = stars.where(could.format("e", "c")).select(F.col("c.sig").alias("a"), F.col("e.sig").alias("b")).distinct()

    def known(edges: DataFrame, end: str) -> DataFrame:
        return edges.join(vertices.select(F.col("sig").alias(end), F.col("v").alias(f"v{end}")), end)

    similar = materialise(_verified(stars, classes), "similar")
    roots = components(known(known(forest(similar), "a"), "b").select("va", "vb"), "va", "vb")
    discard(similar)
    labels = roots.select(F.col("v.sig").alias("sig"), "root")
    rooted = materialise(entries.join(labels.select("sig", F.col("root.sig").alias("root")), "sig", "left").select("tok", "sig", "n", "pos", F.coalesce("root", "sig").alias("root")), "rooted")
    discard(entries)
    parts = rooted.groupBy("tok", "root").agg(F.count("*").alias("m"))
    groups = parts.groupBy("tok").agg(F.count("*").alias("k"), F.sum("m").alias("m"), F.max(F.struct("m", "root")).alias("main")).where("k > 1")
    groups = materialise(groups.select("tok", "m", F.col("main.root").alias("main")), "groups")
    left = materialise(rooted.join(groups.where(F.col("m") <= LARGE), "tok"), "open")
    x, y = left.alias("x"), left.alias("y")
    across = (
        x.join(y, F.expr("x.tok = y.tok and x.root < y.root and " + near.format("x", "y")))
        .where(F.expr(could.format("x", "y")))
        .select(F.expr("least(x.sig, y.sig) as a"), F.expr("greatest(x.sig, y.sig) as b"))
        .distinct()
    )
    more = _verified(across, classes)
    large = groups.where(F.col("m") > LARGE)
    if not large.isEmpty():
        more = more.union(_large_groups(rooted.join(large, "tok").select("tok", "sig", "root", "main", "m"), classes))
    # what is found between components joins their roots
    more = materialise(more, "similar")
    between = known(known(forest(more), "a"), "b")
    for end in ("a", "b"):
        of = labels.select(F.col("sig").alias(end), F.col("root").alias(f"r{end}"))
        between = between.join(of, end, "left").withColumn(f"v{end}", F.coalesce(f"r{end}", f"v{end}"))
    joined = components(between.select("va", "vb"), "va", "vb")
    discard(rooted, groups, left, more)
    over = joined.select(F.col("v").alias("root"), F.col("root").alias("top"))
    return roots.join(over, "root", "left").select("v", F.coalesce("top", "root").alias("root")).union(joined)


def link_counts(classes: DataFrame, members: DataFrame) -> DataFrame:
    """(sig, links): for each class of a component the rows of the other classes that it is similar to.

    ``members``: (sig, root, n_copies) of the classes in components of two or more. A class is dealt into a chunk
    by the largest prefix group of its component that it is in, and a chunk meets once each class that shares a
    prefix group with one of its own; where the chunk's group holds half the component, it meets all of it.
    """
    entries = materialise(_prefixes(classes).join(members.select("sig", "root"), "sig").select("tok", "root", "sig", "n"), "member-entries")
    of = ["root", "tok"]
    groups = entries.groupBy(of).agg(F.count("*").alias("m"), F.sum("n").alias("held")).where("m > 1")
    per_root = members.groupBy("root").agg(F.count("*").alias("all"))
    hubs = entries.join(groups, of).groupBy("sig", "root").agg(F.max(F.struct("m", "tok", "held")).alias("hub"), F.max("n").alias("n")).select("sig", "root", "hub.*", "n")
    sized = hubs.groupBy(of).agg(F.max("m").alias("m"), F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / PACK)).alias("chunks"))
    sized = sized.join(per_root, "root").selectExpr("root", "tok", "chunks", "2 * m >= `all` as whole")
    dealt = hubs.select("sig", "root", "tok").join(sized, of)
    dealt = materialise(dealt.select("sig", "root", "whole", F.xxhash64("root", "tok", F.pmod(F.xxhash64("sig"), F.col("chunks"))).alias("chunk")), "dealt")
    # a chunk is of one component, and either meets all of it or what shares a prefix shingle
    all_met = dealt.where("whole").select("chunk", "root").distinct().join(members.select("sig", "root"), "root").select("chunk", "sig")
    own_groups = entries.join(dealt.where("not whole").select("sig", "chunk"), "sig").select("chunk", *of).distinct()
    some_met = own_groups.join(entries.select("sig", *of), of).select("chunk", "sig").distinct()
    sets = classes.select("sig", "n", "toks").join(members.select("sig", "n_copies"), "sig")
    met = materialise(all_met.union(some_met).join(sets.select("sig", "n"), "sig"), "met")
    blocks = met.groupBy("chunk").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / PACK)).alias("blocks"))
    right = met.select("chunk", "sig").join(blocks, "chunk").select("chunk", F.pmod(F.xxhash64("sig"), F.col("blocks")).alias("block"), "sig").join(sets, "sig")
    left = dealt.select("chunk", "sig").join(blocks, "chunk")
    left = left.select("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "sig").join(sets, "sig")
    left = left.toDF(*left.columns)  # fresh attributes: both sides come from the same tables
    found = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(_count_links, "sig long, links long")
    counts = materialise(found.groupBy("sig").agg(F.sum("links").alias("links")), "link-counts")
    discard(entries, dealt, met)
    return counts


def _count_links(left: pa.Table, right: pa.Table) -> pa.Table:
    """For each left class the rows of the right ones, itself left out, that it is similar to."""
    sig = np.asarray(left["sig"].combine_chunks()) if left.num_rows else np.zeros(0, np.int64)
    links = np.zeros(len(sig), np.int64)
    if left.num_rows and right.num_rows:
        toks = right["toks"].combine_chunks()
        value, owner = np.asarray(toks.flatten()), np.repeat(np.arange(len(toks)), np.diff(np.asarray(toks.offsets)))
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        other, n, copies = (np.asarray(right[c].combine_chunks()) for c in ("sig", "n", "n_copies"))
        for row in range(len(sig)):
            own, size = np.asarray(left["toks"][row].values), left["n"][row].as_py()
            lo, hi = np.searchsorted(value, own, "left"), np.searchsorted(value, own, "right")
            k = hi - lo
            meet = np.bincount(owner[np.repeat(hi - np.cumsum(k), k) + np.arange(k.sum())], minlength=len(n))
            links[row] = copies[(7 * meet >= 3 * (n + size)) & (other != sig[row])].sum()
    return pa.table([pa.array(sig), pa.array(links)], names=["sig", "links"])


def _graph(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, candidate classes, all classes with size and vertex, roots of the classes that aren't roots)."""
    info, classes = shingle_classes(docs, width)
    least = F.struct(F.col("doc_id").isNull().alias("absent"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"))
    per_class = info.where("sig is not null").groupBy("sig").agg(F.min(least).alias("least"), F.count("*").alias("n_copies"))
    per_class = materialise(per_class.select("sig", F.struct("least.absent", "least.id", "sig").alias("v"), "n_copies"), "class-vertices")
    links = linked_classes(classes, per_class.select("sig", "v"))
    return info, classes, per_class, materialise(links.select(F.col("v.sig").alias("sig"), "root"), "class-roots")


def _with_class(info: DataFrame, per_class: DataFrame, links: DataFrame) -> DataFrame:
    known = per_class.join(links, "sig", "left").withColumn("first", F.coalesce("root", "v")).drop("v", "root")
    return info.join(known, "sig", "left")


def grouped(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, key, n, sig, n_copies, first) of each row: its set's size and signature, the rows with that set, its component's first.

    ``first`` is the component's least (no id, id, signature); null for a row without words.
    """
    info, classes, per_class, links = _graph(docs, width)
    discard(classes)
    return _with_class(info, per_class, links)


def similar_documents(docs: DataFrame, width: int = 5) -> DataFrame:
    """Documents with set size and component under 5-word-shingle Jaccard similarity of 0.75 or more.

    ``docs`` needs ``doc_id`` and ``text``; other columns, whatever their names, are ignored. Returns a row
    for each row: ``doc_id, n_shingles, component_id, n_copies, n_links``. ``n_copies`` counts the rows with the
    same set, itself included, and ``n_links`` all other rows that it is linked with, copies among them. Null,
    empty and blank texts have no shingles and are linked with nothing; a text of
    fewer words than a shingle is one shingle, and a text of any length is taken whole. A null ``doc_id``
    takes part; a component without any id has a null one. Repeated rows are copies. An empty table gives an
    empty result.
    """
    info, classes, per_class, links = _graph(docs, width)
    members = links.select("sig", F.col("root.sig").alias("root"))
    members = members.union(members.select("root", "root").distinct()).join(per_class.select("sig", "n_copies"), "sig")
    members = materialise(members, "members")
    counts = link_counts(classes, members)
    discard(classes, members)
    copies, one = F.coalesce("n_copies", F.lit(1).cast("long")), F.when(~F.col("first.absent"), F.col("first.id"))
    component = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(one)
    rows = _with_class(info, per_class.join(counts, "sig", "left"), links)
    n_links = copies - 1 + F.coalesce("links", F.lit(0).cast("long"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), copies.alias("n_copies"), n_links.alias("n_links"))


def not_first(docs: DataFrame, width: int = 5) -> DataFrame:
    """Flags (see ``rowflags``) of all rows with words but one of each component: its least id's, of equal ones the least key's."""
    rows = materialise(grouped(docs, width).where("sig is not null").select("doc_id", "key", "sig", "first"), "grouped")
    own = (F.col("sig") == F.col("first.sig")) & (F.col("doc_id").isNull() == F.col("first.absent")) & (F.coalesce("doc_id", F.lit(0).cast("long")) == F.col("first.id"))
    rest = rows.where(~own).select("key").distinct().withColumn("once", F.lit(False))
    flags = materialise(rest.unionByName(surplus(rows.where(own), "sig")), "not-first")
    discard(rows)
    return flags


OP2_SQL = r"""
with recursive cut as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)])) end as s
  from cut
), one as (select doc_id, len(s) as n, unnest(s) as x from sets
), pairs as (
  select a.doc_id as a, b.doc_id as b from one a join one b on a.x = b.x and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
), links as (select a, b from pairs union all select b, a from pairs
), reach(v, r) as (
  select doc_id, doc_id from sets
  union
  select l.b, t.r from reach t join links l on l.a = t.v where t.r < l.b
), least as (select v, min(r) as r from reach group by v
), linked as (select a, count(*) as k from links group by a
), copies as (select s, count(*) as k from sets group by s)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, least.r as component_id, case when len(s.s) = 0 then 1 else copies.k end as n_copies, coalesce(linked.k, 0) as n_links
from sets s join least on least.v = s.doc_id join copies on copies.s = s.s left join linked on linked.a = s.doc_id
"""


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
