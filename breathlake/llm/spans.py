"""Long exact spans shared between documents, by De Bruijn compaction.

Texts are read as tokens whose borders depend on content alone: anchors are
the smallest hashed grams of a sliding window, a token is the text from one
anchor to the next. Anchors are the nodes and token k-mers (a token with the
anchor that follows) the edges of a De Bruijn graph; texts thread it, so a path
branches only where some text goes another way. Any stretch of ``span``
characters holds at least one whole edge, whatever the text, so a stretch that
two documents share shows as an edge with two documents.

Edges of one document alone are dropped by one aggregation. Nonbranching paths
of the repeated edges are compacted by pointer doubling in Spark joins, which
gives every edge its path and its place on it in edges and characters. Each
document's occurrences fold into runs along those paths; where runs of two
documents overlap on a path, source coordinates say which stretch of the one
text is which stretch of the other. Only what runs leave open (their ends, and
spans that go from one path to the next) is looked up by the hash of every
stretch of ``span`` characters there. All stretches found either way are then
compared with the source texts character by character. No pair of documents is
ever formed, so a passage may stand in any number of them.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breathlake.session import cut

#: Repeated edges, and open ranges, up to which they are broadcast (at most 32 bytes each); beyond, they are joined by shuffle behind a sieve.
BROADCAST_ROWS = 200_000
#: Bits of a sieve at most (8 MB), however many keys it has: all that the driver holds of them.
SIEVE_BITS = 1 << 26
#: Characters hashed at once; longer texts go in overlapping blocks.
BLOCK = 1 << 20
#: Stretches are compared in slices on a grid of so many characters of the witness, so a witness has few different slices.
SLICE = 256

U = np.uint64
_BASE = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class SpanRules:
    """Stretches of ``span`` characters count; anchors are hashed grams of ``gram`` characters.

    Hashes of edges and stretches have ``bits`` bits. They only name
    candidates: fewer bits give more of them and the same result.
    """

    span: int = 200
    gram: int = 24
    bits: int = 64

    def hashed(self, x: np.ndarray) -> np.ndarray:
        return (_mixed(x) >> U(64 - self.bits)).view(np.int64)

    @property
    def window(self) -> int:
        """Grams of a window: two windows and a gram fit into a span, so it holds a whole edge."""
        return (self.span - self.gram + 1) // 2

    @property
    def reach(self) -> int:
        """Characters of a whole window of grams."""
        return self.window + self.gram - 1

    @property
    def margin(self) -> int:
        """Characters that blocks of one text share, so that each edge lies whole in one of them."""
        return 2 * self.window + 2 * self.gram

    @property
    def table(self) -> int:
        return BLOCK + self.margin + self.span + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(29))


@functools.cache
def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each code point, and powers of the base and of its inverse modulo 2**64."""
    chars = _mixed(_mixed((np.arange(0x110000, dtype=np.uint64) + U(1)) * U(0x94D049BB133111EB)))
    up = np.full(n, U(_BASE))
    down = np.full(n, U(pow(_BASE, -1, 2**64)))
    up[0] = down[0] = 1
    return chars, np.cumprod(up), np.cumprod(down)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _prefix(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of which any substring's hash is a difference times an inverse power."""
    chars, up, down = _tables(size)
    p = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(chars[codes] * up[: len(codes)], out=p[1:])
    return p, down


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    w = 1
    while w * 2 <= width:
        x = np.minimum(x[:-w], x[w:])
        w *= 2
    return np.minimum(x[: len(x) - (width - w)], x[width - w:]) if w < width else x


def _pieces(texts: list[str | None], margin: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Groups of (row, offset, codes) of up to about ``BLOCK`` characters each."""
    group, n = [], 0
    for row, t in enumerate(texts):
        if not t:
            continue
        codes = _codes(t)
        for at in range(0, max(1, len(codes) - margin), BLOCK):
            part = codes[at: at + BLOCK + margin]
            if n and n + len(part) > BLOCK:
                yield group
                group, n = [], 0
            group.append((row, at, part))
            n += len(part)
    if group:
        yield group


def _edges(texts: list[str | None], rules: SpanRules) -> Iterator[dict[str, np.ndarray]]:
    """Edges of each group of texts, in order.

    A window of grams names the anchor it selects, so each window start belongs
    to one anchor: those of an edge's first anchor run ``from_``..``to_``, those
    of its second one end at ``next_to``. A span begins with a whole window, so
    its first edge is that of the window it starts with, in every text alike.
    """
    g, w = rules.gram, rules.window
    position = U((1 << 22) - 1)
    for group in _pieces(texts, rules.margin):
        codes = np.concatenate([c for _, _, c in group])
        n = len(codes)
        if n < g + w:
            continue
        p, down = _prefix(codes, rules.table)
        h = _mixed((p[g:] - p[:-g]) * down[: n - g + 1])
        ranked = (h & ~position) | np.arange(len(h), dtype=np.uint64)  # ties fall to the first
        least = (_sliding_min(ranked, w) & position).astype(np.int64)
        sizes = np.array([len(c) for _, _, c in group])
        first = np.cumsum(sizes) - sizes
        windows = np.maximum(sizes - rules.reach + 1, 0)  # those wholly inside the piece
        piece = np.repeat(np.arange(len(group)), windows)
        at = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows) + first[piece]
        pos = least[at]
        if not len(pos):
            continue
        new = np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]])
        last = at[np.r_[new[1:] - 1, len(at) - 1]]
        pos, piece, begin = pos[new], piece[new], at[new]
        same = piece[1:] == piece[:-1]
        a, b, piece = pos[:-1][same], pos[1:][same], piece[1:][same]
        if not len(a):
            continue
        from_, to_, next_to = begin[:-1][same], last[:-1][same], last[1:][same]
        shift = np.array([o for _, o, _ in group])[piece] - first[piece]
        yield {
            "row": np.array([r for r, _, _ in group])[piece],
            "edge": rules.hashed((p[b + g] - p[a]) * down[a] + U(1)),
            "start": a + shift, "end": b + g + shift,
            "from_": from_ + shift, "to_": to_ + shift, "next_to": next_to + shift,
        }


def _whole_edges(texts: list[str | None], rules: SpanRules) -> Iterator[dict[str, np.ndarray]]:
    """As ``_edges``, with the blocks of a long text joined and each edge once."""
    held = None
    for e in _edges(texts, rules):
        if held is not None and held["row"][-1] == e["row"][0]:
            held = {k: np.concatenate([held[k], e[k]]) for k in e}
            order = np.lexsort((held["from_"], held["start"], held["row"]))
            held = {k: v[order] for k, v in held.items()}
            keep = np.flatnonzero(np.r_[True, (held["row"][1:] != held["row"][:-1]) | (held["start"][1:] != held["start"][:-1])])
            far = np.maximum.reduceat(held["next_to"], keep)
            held = {k: v[keep] for k, v in held.items()} | {"next_to": far}
        else:
            if held is not None:
                yield held
            held = e
    if held is not None:
        yield held


def document_edges(docs: DataFrame, rules: SpanRules) -> DataFrame:
    """``doc, edge`` of every token k-mer of ``docs(doc_id, text)``."""
    schema = pa.schema([("doc", pa.int64()), ("edge", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for e in _whole_edges(batch.column(1).to_pylist(), rules):
                yield pa.RecordBatch.from_arrays([pa.array(ids[e["row"]]), pa.array(e["edge"])], schema=schema)

    return docs.mapInArrow(run, "doc bigint, edge bigint")


_PLACED = ("edge", "start", "end", "from_", "to_", "next_to")


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each key among ``bits``, a power of two."""
    h = _mixed(_mixed(keys.view(np.uint64) + U(_BASE)))
    return h & U(bits - 1), (h >> U(32)) & U(bits - 1)


def _sieve(keys: DataFrame, rows: int) -> Broadcast:
    """A bitmap that holds all of ``keys`` (one column of ``rows`` numbers) and some others: it spares a join most of what has no match."""
    bits = min(SIEVE_BITS, 1 << max(6, (16 * rows).bit_length()))
    schema = pa.schema([("word", pa.int64()), ("marks", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_places(batch.column(0).to_numpy(), bits))
            cols = (at >> U(6)).view(np.int64), (U(1) << (at & U(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=schema)

    marks = keys.mapInArrow(run, "word bigint, marks bigint").groupBy("word").agg(F.bit_or("marks").alias("marks")).toArrow()  # a row for each 64 bits at most
    words = np.zeros(bits >> 6, np.uint64)
    words[marks["word"].to_numpy()] = marks["marks"].to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(words)


def _held(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    a, b = _places(keys, len(words) << 6)
    return ((words[a >> U(6)] >> (a & U(63))) & (words[b >> U(6)] >> (b & U(63))) & U(1)).astype(bool)


def _sifted(docs: DataFrame, sieve: Broadcast) -> DataFrame:
    """The rows of ``docs(doc_id, text)`` whose number the sieve holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_held(batch.column(0).to_numpy(), sieve.value)))

    return docs.mapInArrow(run, docs.schema)


def _occurrences(docs: DataFrame, rules: SpanRules, sieve: Broadcast | None = None) -> DataFrame:
    """Every edge (that ``sieve`` holds) with its place in its text, and the text's length."""
    names = ("doc", "chars", *_PLACED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            sizes = np.array([len(t) if t else 0 for t in texts])
            for e in _whole_edges(texts, rules):
                if sieve is not None:
                    keep = _held(e["edge"], sieve.value)
                    e = {k: v[keep] for k, v in e.items()}
                cols = (ids[e["row"]], sizes[e["row"]], *(e[c] for c in _PLACED))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=list(names))

    return docs.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def compact(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``edge, path, off, pos``: nonbranching paths of the graph.

    ``edges(edge)`` are its edges, ``pairs(prev, edge, step)`` says which
    follow each other in some text and how many characters apart they start. A
    pair is part of a path where ``prev`` is followed by nothing else and
    ``edge`` follows nothing else. Pointer doubling takes each edge to the head
    of its path; the path is named by its head, ``off`` counts edges from it and
    ``pos`` characters. An edge on a closed ring has no head and is a path of
    its own.
    """
    edges = edges.distinct()
    pairs = pairs.groupBy("prev", "edge").agg(F.min("step").alias("step"))
    into = pairs.groupBy("edge").agg(F.count("*").alias("n"), F.min("prev").alias("prev"), F.min("step").alias("step")).filter("n = 1 and prev <> edge").drop("n")
    out = pairs.groupBy("prev").agg(F.count("*").alias("n")).filter("n = 1").select("prev")
    links = into.join(out, "prev", "left_semi")
    linked = F.col("prev").isNotNull()
    p = edges.join(links, "edge", "left").select("edge", F.coalesce("prev", "edge").alias("path"), linked.cast("bigint").alias("off"), F.coalesce("step", F.lit(0)).cast("bigint").alias("pos"), linked.alias("moved"))
    p = cut(p)
    n = p.filter("moved").count()
    for _ in range(math.ceil(math.log2(n + 1)) + 1):
        if p.filter("moved").isEmpty():
            break
        ahead = p.select(F.col("edge").alias("path"), F.col("path").alias("next"), F.col("off").alias("o"), F.col("pos").alias("c"))
        p = cut(p.join(ahead, "path").select("edge", F.col("next").alias("path"), (F.col("off") + F.col("o")).alias("off"), (F.col("pos") + F.col("c")).alias("pos"), (F.col("next") != F.col("path")).alias("moved")))
    on = lambda c, alone: F.when(F.col("moved"), alone).otherwise(F.col(c)).alias(c)
    return p.select("edge", on("path", F.col("edge")), on("off", F.lit(0)), on("pos", F.lit(0)))


def _known(docs: DataFrame, rules: SpanRules) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull() & (F.length("text") >= rules.span))


def shared_runs(docs: DataFrame, rules: SpanRules = SpanRules()) -> DataFrame:
    """Occurrences of repeated edges, compacted: each with its path, place, island and run.

    An *island* is a stretch of a text all of whose edges are repeated; within
    it a *run* follows one path without a break.
    """
    known = _known(docs, rules)
    counted = document_edges(known, rules).groupBy("edge").agg(F.min("doc").alias("a"), F.max("doc").alias("b"))
    repeated = cut(counted.filter("a <> b").select("edge"))
    rows = repeated.count()
    if rows <= BROADCAST_ROWS:
        occ = _occurrences(known, rules).join(F.broadcast(repeated), "edge")
    else:
        occ = _occurrences(known, rules, _sieve(repeated, rows)).join(repeated, "edge")
    w = Window.partitionBy("doc").orderBy("start")
    occ = occ.withColumn("before", F.lag("start").over(w)).filter("before is null or before < start")  # documents given again
    follows = F.lag("end").over(w) - rules.gram == F.col("start")  # the edge before is repeated too
    occ = cut(occ.withColumn("prev", F.when(follows, F.lag("edge").over(w))).withColumn("step", F.when(follows, F.col("start") - F.lag("start").over(w))).drop("before"))
    occ = occ.join(compact(occ.select("edge"), occ.filter("prev is not null").select("prev", "edge", "step")), "edge")
    along = F.col("prev").isNotNull() & (F.lag("path").over(w) == F.col("path")) & (F.lag("off").over(w) == F.col("off") - 1)
    occ = occ.withColumn("r", F.when(along, 0).otherwise(1)).withColumn("i", F.col("prev").isNull().cast("int"))
    return cut(occ.withColumn("island", F.sum("i").over(w)).withColumn("run", F.sum("r").over(w)).drop("i", "r", "prev", "step"))


def path_runs(occ: DataFrame) -> DataFrame:
    """One row per run: document, path, offsets along it, places in the text and on the path."""
    return occ.groupBy("doc", "run").agg(
        F.first("path").alias("path"), F.min("off").alias("off_from"), F.max("off").alias("off_to"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.min("pos").alias("pos_from"), F.max(F.col("pos") + F.col("end") - F.col("start")).alias("pos_to"), F.first("island").alias("island"),
        F.min("from_").alias("from_"), F.max("next_to").alias("next_to"), F.count("*").alias("edges"),
    )


def overlaps(occ: DataFrame, runs: DataFrame) -> DataFrame:
    """``doc, start, end, wdoc, wstart``: the longest parts of each run that another document's run covers too.

    From each edge of a run, the run of another document that reaches farthest
    along the path gives the end. One aggregation finds the farthest of all,
    another the farthest of the documents that are not that one, so every
    document has its witness and no two runs are paired.
    """
    o = occ.join(runs.select("doc", "run", F.col("pos_to").alias("far"), (F.col("start") - F.col("pos_from")).alias("shift")), ["doc", "run"])
    o = cut(o.select("doc", "run", "edge", "off", "pos", "start", "far", F.struct("far", "doc", "shift").alias("reach")))
    best = o.groupBy("edge").agg(F.max("reach").alias("best"))
    o = o.join(best, "edge")
    other = o.filter("doc <> best.doc").groupBy("edge").agg(F.max("reach").alias("next"))
    o = o.join(other, "edge", "left").withColumn("by", F.when(F.col("doc") != F.col("best.doc"), F.col("best")).otherwise(F.col("next"))).filter("by is not null")
    o = o.withColumn("to", F.least("far", "by.far"))
    before = F.lag("to").over(Window.partitionBy("doc", "run").orderBy("off"))
    o = o.filter("to > pos").withColumn("before", before).filter("before is null or before < to")
    return o.select("doc", "start", (F.col("start") + F.col("to") - F.col("pos")).alias("end"), F.col("by.doc").alias("wdoc"), (F.col("by.shift") + F.col("pos")).alias("wstart"))


def _open(occ: DataFrame, along: DataFrame, span: int) -> DataFrame:
    """``doc, lo, hi``: starts of the spans that may match and that ``along`` does not hold.

    A span belongs to the edge of the window it starts with, at one distance
    from it in every text. So where one text has open spans at some distances
    from an edge, all texts with that edge show theirs at these distances.
    """
    marks = along.select("doc", F.col("start").alias("at"), (F.col("end") - span).alias("upto"))
    edges = occ.select("doc", "edge", "start", F.greatest("from_", "lo").alias("at"), F.least(F.col("to_"), F.col("hi") - span).alias("last")).filter("at <= last")
    both = edges.unionByName(marks, allowMissingColumns=True)
    mark = F.col("edge").isNull()
    before = F.max("upto").over(Window.partitionBy("doc").orderBy("at", ~mark))
    after = F.last(F.when(mark, F.struct("at", "upto")), True).over(Window.partitionBy("doc").orderBy(F.desc("at"), ~mark))
    edges = both.withColumn("before", before).withColumn("after", after).filter("edge is not null")
    lo = F.greatest(F.col("at"), F.col("before") + 1)
    hi = F.when((F.col("after.at") <= F.col("last")) & (F.col("after.upto") >= F.col("last")), F.col("after.at") - 1).otherwise(F.col("last"))
    edges = cut(edges.select("doc", "edge", "start", "at", "last", (lo - F.col("start")).alias("lo"), (hi - F.col("start")).alias("hi")))
    wide = edges.filter("lo <= hi").groupBy("edge").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    all_ = edges.drop("lo", "hi").join(wide, "edge")
    return all_.select("doc", F.greatest(F.col("at"), F.col("start") + F.col("lo")).alias("lo"), F.least(F.col("last"), F.col("start") + F.col("hi")).alias("hi")).filter("lo <= hi")


def _grams(docs: DataFrame, ranges: DataFrame, rules: SpanRules) -> DataFrame:
    """``gram, doc, at``: the hash of each stretch of ``span`` characters that starts in ``ranges(doc, lo, hi)``, both ends included.

    Kept as one array of hashes for each range, and spread out when read.
    """
    span = rules.span
    ranges = cut(ranges.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")))
    n, rows = ranges.agg(F.count("*"), F.coalesce(F.sum(F.size("ranges")), F.lit(0))).first()
    known = _known(docs, rules)
    rows_ = known.join(F.broadcast(ranges), "doc_id") if rows <= BROADCAST_ROWS else _sifted(known, _sieve(ranges.select("doc_id"), n)).join(ranges, "doc_id")
    rows_ = rows_.select("doc_id", "text", "ranges")
    schema = pa.schema([("doc", pa.int64()), ("lo", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, first, sizes, hashes = [], [], [0], [np.zeros(0, np.int64)]
            for i in range(batch.num_rows):
                codes = _codes(batch.column(1)[i].as_py())
                r = batch.column(2)[i].values
                for lo, hi in zip(r.field(0).to_pylist(), r.field(1).to_pylist()):
                    lo, hi = max(lo, 0), min(hi, len(codes) - span)
                    for s in range(lo, hi + 1, BLOCK):
                        n = min(BLOCK, hi + 1 - s)
                        p, down = _prefix(codes[s: s + n + span - 1], rules.table)
                        at.append(i), first.append(s), sizes.append(n)
                        hashes.append(rules.hashed((p[span:] - p[:-span]) * down[:n] + U(3)))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(hashes)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(first, pa.int64()), lists], schema=schema)

    kept = cut(rows_.mapInArrow(run, "doc bigint, lo bigint, grams array<bigint>"))
    return kept.select("doc", "lo", F.posexplode("grams").alias("k", "gram")).select("gram", "doc", (F.col("lo") + F.col("k")).alias("at"))


def _same_grams(grams: DataFrame, span: int) -> DataFrame:
    """Stretches whose hash another document has too, with a witness; neighbours with one witness join."""
    twice = grams.groupBy("gram").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a <> b")
    hits = cut(grams.join(twice, "gram").select("gram", "doc", "at", F.when(F.col("doc") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("wdoc"), ((F.col("doc") == F.col("a")) | (F.col("doc") == F.col("b"))).alias("end")))
    places = hits.filter("end").groupBy("gram", F.col("doc").alias("wdoc")).agg(F.min("at").alias("wat"))
    hits = hits.join(places, ["gram", "wdoc"]).select("doc", "at", "wdoc", (F.col("wat") - F.col("at")).alias("shift")).distinct()
    w = Window.partitionBy("doc", "wdoc", "shift").orderBy("at")
    hits = hits.withColumn("k", F.col("at") - F.row_number().over(w))
    g = hits.groupBy("doc", "wdoc", "shift", "k").agg(F.min("at").alias("start"), (F.max("at") + span).alias("end"))
    return g.select("doc", "start", "end", "wdoc", (F.col("start") + F.col("shift")).alias("wstart"))


def _texts(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """``text``: the characters ``[start, start + n)`` of each row of ``parts(doc, start, n, ...)``; other columns pass through."""
    rest = [c for c in parts.columns if c != "doc"]
    lists = parts.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct(*rest)).alias("parts"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(lists, "doc_id")
    fields = [f for f in lists.schema["parts"].dataType.elementType.fields]
    names = ["doc", *rest, "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, p = batch.column(1)[i].as_py(), batch.column(2)[i].values
                cols = [p.field(c) for c in rest]
                got = [text[max(a, 0): max(a + n, 0)] for a, n in zip(p.field("start").to_pylist(), p.field("n").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(got), pa.int64()), *cols, pa.array(got, pa.string())], names=names)

    return rows.mapInArrow(run, "doc bigint, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", text string")


def _unequal(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``found(doc, start, end, wdoc, wstart)`` whose text is not that of their witness.

    Slices of one place of a witness are grouped with the witness's own text:
    more than one text in a group means that some differ. A passage in a third
    of all documents is one group of one text, which partial aggregation folds
    before the shuffle.
    """
    wend = F.col("wstart") + F.col("end") - F.col("start")
    rows = found.withColumn("k", F.explode(F.sequence(F.floor(F.col("wstart") / SLICE), F.floor((wend - 1) / SLICE))))
    rows = rows.withColumn("wat", F.greatest("wstart", F.col("k") * SLICE)).withColumn("n", (F.least(wend, (F.col("k") + 1) * SLICE) - F.col("wat")).cast("int"))
    key = ["wdoc", "wat", "n"]
    own = rows.select("doc", (F.col("start") + F.col("wat") - F.col("wstart")).alias("start"), *key).distinct()
    witnesses = rows.select(F.col("wdoc").alias("doc"), F.col("wat").alias("start"), *key).distinct()
    ids = cut(found.select(F.col("doc").alias("doc_id")).union(found.select("wdoc")).distinct())
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null")
    texts = _texts(_sifted(docs, _sieve(ids, ids.count())), own.unionByName(witnesses)).select(*key, "text").distinct()
    odd = texts.groupBy(*key).agg(F.count("*").alias("c"), F.min(F.length("text")).alias("least")).filter("c > 1 or least < n").select(*key)
    return rows.join(odd, key, "left_semi").select(*found.columns).distinct()


def _by_text(docs: DataFrame, unequal: DataFrame, alive: DataFrame, rules: SpanRules) -> DataFrame:
    """``doc, start, end`` of the spans within ``unequal`` that another document's text holds, grouped by the text itself."""
    again = _grams(docs, unequal.select("doc", F.col("start").alias("lo"), (F.col("end") - rules.span).alias("hi")), rules).select("gram").distinct()
    places = _grams(docs, alive, rules).join(again, "gram", "left_semi").select("doc", F.col("at").alias("start"), F.lit(rules.span).alias("n")).distinct()
    texts = cut(_texts(docs, places).select("doc", "start", "text"))
    twice = texts.groupBy("text").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a <> b").select("text")
    return texts.join(twice, "text", "left_semi").select("doc", "start", (F.col("start") + rules.span).alias("end"))


def shared_stretches(docs: DataFrame, rules: SpanRules = SpanRules()) -> DataFrame:
    """Maximal stretches of each text that stand verbatim in some other document.

    ``docs(doc_id, text)`` has one row per document; a row given again counts
    once. Result: ``doc_id, start,
    end, chars``: code points, half open, the union of all substrings of
    ``rules.span`` characters that another document holds too; ``chars`` is the
    document's length. Nothing is normalised. Null and short texts have none.
    Equality is that of the texts; hashes only name candidates, and where
    texts of one hash differ, they are grouped by themselves. Materialises its
    stages in the checkpoint folder.
    """
    span = rules.span
    occ = shared_runs(docs, rules)
    runs = cut(path_runs(occ))
    # a span can match while its own edges are repeated: from the island's first window to the end of its last
    islands = runs.groupBy("doc", "island").agg(F.min("from_").alias("lo"), (F.max("next_to") + rules.reach).alias("hi"))
    islands = cut(islands.filter(F.col("hi") - F.col("lo") >= span))
    along = cut(overlaps(occ, runs).filter(F.col("end") - F.col("start") >= span))
    ranges = _open(occ.join(islands, ["doc", "island"]), along, span)
    found = cut(along.unionByName(_same_grams(_grams(docs, ranges, rules), span)))
    unequal = cut(_unequal(docs, found))
    parts = found.select("doc", "start", "end")
    if not unequal.isEmpty():  # texts of one hash that differ
        alive = islands.select("doc", "lo", (F.col("hi") - span).alias("hi"))
        parts = found.join(unequal, found.columns, "left_anti").select("doc", "start", "end").unionByName(_by_text(docs, unequal, alive, rules))
    w = Window.partitionBy("doc").orderBy("start", "end")
    parts = parts.withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    parts = parts.withColumn("k", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(w))
    merged = parts.groupBy("doc", "k").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    sizes = occ.groupBy("doc").agg(F.max("chars").alias("chars"))
    return merged.join(sizes, "doc").select(F.col("doc").alias("doc_id"), "start", "end", "chars")


def shared_shares(docs: DataFrame, stretches: DataFrame) -> DataFrame:
    """Per document: stretches, characters shared with others, and their share of the text (0 for an empty one)."""
    s = stretches.groupBy("doc_id").agg(F.count("*").alias("stretches"), F.sum(F.col("end") - F.col("start")).alias("shared_chars"), F.max(F.col("end") - F.col("start")).alias("longest"))
    d = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars")).dropDuplicates(["doc_id"]).join(s, "doc_id", "left").fillna(0, ["stretches", "shared_chars", "longest"])
    return d.withColumn("share", F.when(F.col("chars") > 0, F.col("shared_chars") / F.col("chars")).otherwise(0.0))
