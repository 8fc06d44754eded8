"""Long spans that stand verbatim in more than one record, and how much of each record they cover.

MinHash over paragraphs, tuned to miss nothing: the paragraphs are all windows of ``SPAN`` characters, the
shingles all runs of ``SHINGLE`` characters, and a band is one row, so two equal windows always collide on
their smallest shingle hash (neighbouring windows mostly share it, which leaves about one stored shingle in
50 characters). A stored shingle "owns" the consecutive windows whose minimum it is.

Colliding shingles are verified. Occurrences with one shingle are grouped to classes by the 64-bit hash of all text
their windows cover: a class with two records is shared as a whole. What remains (the edges of copied passages)
is compared character by character inside a collision group, one representative per class, or, where a
group has more than ``PAIRS`` classes, by joining the hashes of its single windows, so no group is expanded
into pairs and none is cut. The spans found are united per record.

The stored shingles are written once to the shared checkpoint folder; groups are counted with partial
aggregation before the shuffle and joined back, so the hot ones are split by adaptive execution.

Defined cases: null, empty and short texts share nothing; rows with one id are one record, which does not
share with itself, whatever their texts; a span repeated inside one record only is not shared; positions count Unicode characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import UNPACKED, bytes_of, joined, written

SPAN = 160
SHINGLE = 64
PAIRS = 12
CHUNK = 400_000

_B = 0x9E3779B97F4A7C15 | 1
_STORED = "fp long, ctx long, doc_id long, place long"
#: Bytes, unpacked, up to which a written side of a join is broadcast; beyond, it is shuffled.
FEW_BYTES = 64 << 20
#: Bits of the table of asked records: per record, and at most.
BITS, MOST_BITS = 16, 1 << 31


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes of substrings of one text by prefix sums modulo 2**64."""

    def __init__(self, limit: int):
        self.power = np.full(limit + 1, _B, np.uint64)
        self.power[0] = 1
        np.cumprod(self.power, out=self.power)
        self.inverse = np.full(limit + 1, pow(_B, -1, 1 << 64), np.uint64)
        self.inverse[0] = 1
        np.cumprod(self.inverse, out=self.inverse)

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        s = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(_B)) * self.power[: len(codes)], out=s[1:])
        return s

    def span(self, s: np.ndarray, a, b) -> np.ndarray:
        return _mix((s[b] - s[a]) * self.inverse[a])


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of ``w`` values, by doubling."""
    n, have = len(x) - w + 1, 1
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = w - have
    return np.minimum(x[:n], x[rest : rest + n]) if rest else x[:n]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _shape(lo, hi, pos) -> np.ndarray:
    return _mix((hi - lo).astype(np.uint64) * np.uint64(1 << 20) + (pos - lo).astype(np.uint64))


def stored_shingles(ids: list[int], codes: list[np.ndarray], hasher: Hasher) -> tuple[np.ndarray, ...]:
    """(fp, doc, pos, lo, hi, ctx) of texts that fit the hasher when joined."""
    lens = np.array([len(c) for c in codes])
    start = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(lens, out=start[1:])
    joined = np.concatenate(codes)
    s = hasher.prefix(joined)
    k = np.arange(len(joined) - SHINGLE + 1)
    h = hasher.span(s, k, k + SHINGLE)
    # High bits order, low bits tell the place: ties go to the first.
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    packed = (h >> bits << bits) | k.astype(np.uint64)
    at = (_window_min(packed, SPAN - SHINGLE + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # Windows within one text, as (doc, first..last window).
    win = np.arange(len(at))
    doc = np.searchsorted(start, win, side="right") - 1
    ok = win + SPAN <= start[doc + 1]
    win, doc, at = win[ok], doc[ok], at[ok]
    if not len(win):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z, z
    new = np.ones(len(win), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(win)) - 1
    d, lo, hi, pos = doc[first], win[first], win[last], at[first]
    ctx = hasher.span(s, lo, hi + SPAN) ^ _shape(lo, hi, pos)
    base = start[d]
    return h[pos].view(np.int64), np.asarray(ids, np.int64)[d], pos - base, lo - base, hi - base, ctx.view(np.int64)


def _shingle_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(CHUNK)
    ids: list[int] = []
    codes: list[np.ndarray] = []
    shift: list[int] = []
    size = 0

    def flush():
        # Pieces of a long text carry their place in it.
        fp, n, pos, lo, hi, ctx = stored_shingles(list(range(len(ids))), codes, hasher)
        # Windows owned never exceed SPAN - SHINGLE + 1, so both distances fit in a byte.
        place = (lo + np.asarray(shift, np.int64)[n] << 16) | (pos - lo << 8) | (hi - lo)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (fp, ctx, np.asarray(ids, np.int64)[n], place)], ["fp", "ctx", "doc_id", "place"])

    for b in batches:
        names, texts = b.column(0).to_pylist(), b.column(1)
        for i, text in enumerate(texts):
            c = _codes(text.as_py())
            if len(c) < SPAN:
                continue
            step = CHUNK // 2
            for a in range(0, len(c) - SPAN + 1, step):
                piece = c[a : a + step + SPAN - 1]
                if size + len(piece) > CHUNK:
                    yield flush()
                    ids, codes, shift, size = [], [], [], 0
                ids.append(names[i])
                codes.append(piece)
                shift.append(a)
                size += len(piece)
    if ids:
        yield flush()


def shingles(documents: DataFrame) -> DataFrame:
    """The stored shingles of all records: fp, ctx (hash of the text of the windows owned), doc_id, place."""
    long = documents.where(F.col("doc_id").isNotNull() & (F.length("text") >= SPAN))
    return long.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_shingle_kernel, _STORED)


def _cut_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the asked contexts: rows (doc_id, text, asks) to (fp, ctx, n, doc_id, pos, lo, hi, part).

    A context is looked up again by its hash, so of several texts under one id each gives only its own.
    """
    hasher = Hasher(4 * SPAN)
    for b in batches:
        out: list[list] = [[] for _ in range(8)]
        for doc, text, asks in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            text = text.as_py()
            for a in asks.as_py():
                lo, hi, part = a["lo"], a["hi"], text[a["lo"] : a["hi"] + SPAN]
                if len(part) != hi - lo + SPAN:
                    continue
                x = np.array([lo, hi, a["pos"]])
                s = hasher.prefix(_codes(part))
                if int((hasher.span(s, np.array([0]), np.array([len(part)])) ^ _shape(x[:1], x[1:2], x[2:])).view(np.int64)[0]) != a["ctx"]:
                    continue
                row = (a["fp"], a["ctx"], a["n"], doc, a["pos"], lo, hi, part)
                for c, v in zip(out, row):
                    c.append(v)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["fp", "ctx", "n", "doc_id", "pos", "lo", "hi", "part"])


def _shared_windows(a: str, pa_: int, b: str, pb: int) -> tuple[int, int] | None:
    """Extent around a common shingle at pa_ in a and pb in b, as offsets from it, if long enough."""
    left = 0
    m = min(pa_, pb)
    while left < m and a[pa_ - left - 1] == b[pb - left - 1]:
        left += 1
    right, m = 0, min(len(a) - pa_, len(b) - pb)
    if a[pa_ : pa_ + m] == b[pb : pb + m]:
        right = m
    else:
        while right < m and a[pa_ + right] == b[pb + right]:
            right += 1
    return (left, right) if right >= SHINGLE and left + right >= SPAN else None


def _pair_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by fp, one per class of a small group: (fp, ctx, l, r) of the spans that classes of one record share."""

    def judge(group: list[tuple]) -> list[tuple]:
        out = []
        for i, (fp, ca, na, da, pa_, la, ta) in enumerate(group):
            for _, cb, nb, db, pb, lb, tb in group[i + 1 :]:
                if da == db and na == 1 and nb == 1:
                    continue
                e = _shared_windows(ta, pa_ - la, tb, pb - lb)
                if e:
                    out += [(fp, c, -e[0], e[1]) for c, n in ((ca, na), (cb, nb)) if n == 1]
        return out

    group: list[tuple] = []
    for b in batches:
        found: list[tuple] = []
        for row in zip(*[b.column(c).to_pylist() for c in ("fp", "ctx", "n", "doc_id", "pos", "lo", "part")]):
            if group and group[0][0] != row[0]:
                found += judge(group)
                group = []
            group.append(row)
        yield _spans(found)
    if group:
        yield _spans(judge(group))


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 4
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["fp", "ctx", "l", "r"])


def _window_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of a context: (fp, key, n, doc_id, ctx, l), l counted from the shingle."""
    hasher = Hasher(4 * SPAN)
    names = ["fp", "key", "n", "doc_id", "ctx", "l"]
    for b in batches:
        cols: list[list[np.ndarray]] = [[] for _ in names]
        for fp, ctx, n, doc, pos, lo, part in zip(*[b.column(c).to_pylist() for c in ("fp", "ctx", "n", "doc_id", "pos", "lo", "part")]):
            c = _codes(part)
            s = hasher.prefix(c)
            k = np.arange(len(c) - SPAN + 1)
            at = k + lo - pos
            key = hasher.span(s, k, k + SPAN) ^ _mix((at + (1 << 30)).astype(np.uint64))
            m = len(k)
            for x, v in zip(cols, (np.full(m, fp), key.view(np.int64), np.full(m, n, np.int32), np.full(m, doc), np.full(m, ctx), at.astype(np.int32))):
                x.append(v)
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names)


def _asked_texts(documents: DataFrame, asks: DataFrame) -> DataFrame:
    """The records asked for, with what is asked: by broadcast where the asks are few, else by a shuffle of hardly more
    than these records, as a bit table of their ids, bounded in size, goes over the texts first."""
    texts = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if UNPACKED * bytes_of(asks) <= FEW_BYTES:
        return texts.join(F.broadcast(asks), "doc_id")
    size = 1 << 16
    while size < min(BITS * asks.count(), MOST_BITS):
        size *= 2
    bits = np.zeros(size // 8, np.uint8)
    for r in asks.select("doc_id").toLocalIterator():
        k = int(_mix(np.array([r.doc_id], np.int64).view(np.uint64))[0]) & (size - 1)
        bits[k >> 3] |= 1 << (k & 7)
    table = documents.sparkSession.sparkContext.broadcast(bits)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = _mix(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & np.uint64(size - 1)
            yield b.filter(pa.array((table.value[(k >> np.uint64(3)).astype(np.int64)] >> (k & np.uint64(7)).astype(np.uint8)) & 1 == 1))

    return texts.where("doc_id is not null").mapInArrow(asked, "doc_id long, text string").join(asks.hint("merge"), "doc_id")


def shared_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, a, b): spans [a, b) of records that also stand in another record; spans may overlap."""
    fps = written(shingles(documents), "shingles")
    # Collisions between records, counted before any shuffle of the rows themselves.
    multi = fps.groupBy("fp").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).where("d0 <> d1").select("fp")
    hits = joined(fps, written(multi, "collisions"), ["fp"], "inner", FEW_BYTES)
    hits = written(hits, "hits").select(
        "fp", "ctx", "doc_id", F.expr("cast(place >> 16 as int)").alias("lo"),
        F.expr("cast((place >> 16) + ((place >> 8) & 255) as int)").alias("pos"), F.expr("cast((place >> 16) + (place & 255) as int)").alias("hi"),
    )
    classes = hits.groupBy("fp", "ctx").agg(
        F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), F.min(F.struct("doc_id", "pos", "lo", "hi")).alias("rep")
    )
    classes = written(classes, "classes")
    many = F.col("d0") != F.col("d1")
    whole = hits.join(classes.where(many).select("fp", "ctx"), ["fp", "ctx"], "left_semi").select(
        "doc_id", F.col("lo").alias("a"), (F.col("hi") + SPAN).alias("b")
    )
    # Groups with a class of one record need a look at the text; one representative stands for a class.
    size = classes.groupBy("fp").agg(F.count("*").alias("size"), F.sum((~many).cast("int")).alias("alone")).where("size > 1 and alone > 0")
    asked = classes.join(size.select("fp", "size"), "fp").select(
        "fp", "ctx", F.when(many, 2).otherwise(1).alias("n"), "rep.doc_id", "rep.pos", "rep.lo", "rep.hi", "size"
    )
    # The size of the group rides on the sign of n: negative for large groups.
    signed = F.when(F.col("size") > PAIRS, -F.col("n")).otherwise(F.col("n")).alias("n")
    asks = written(asked.groupBy("doc_id").agg(F.collect_list(F.struct("fp", "ctx", signed, "pos", "lo", "hi")).alias("asks")), "asks")
    parts = _asked_texts(documents, asks).select("doc_id", "text", "asks").mapInArrow(
        _cut_kernel, "fp long, ctx long, n int, doc_id long, pos int, lo int, hi int, part string"
    )
    parts = written(parts, "parts")
    small = parts.where("n > 0").repartition("fp").sortWithinPartitions("fp").mapInArrow(_pair_kernel, "fp long, ctx long, l int, r int")
    windows = parts.where("n < 0").mapInArrow(_window_kernel, "fp long, key long, n int, doc_id long, ctx long, l int")
    both = windows.groupBy("fp", "key").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), F.min("n").alias("n0")).where("d0 <> d1 or n0 = -2")
    large = windows.where("n = -1").join(both.select("fp", "key"), ["fp", "key"], "left_semi").select("fp", "ctx", "l", (F.col("l") + SPAN).alias("r"))
    # A class of one record may stand in it several times.
    edges = hits.join(small.unionByName(large), ["fp", "ctx"]).select("doc_id", (F.col("pos") + F.col("l")).alias("a"), (F.col("pos") + F.col("r")).alias("b"))
    return whole.unionByName(edges)


def shared_characters(documents: DataFrame) -> DataFrame:
    """(doc_id, shared_chars): characters of a record in spans shared with other records, records above 0."""
    w = W.partitionBy("doc_id").orderBy("a", "b")
    seen = F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1))
    s = shared_spans(documents).distinct().select("doc_id", "b", F.greatest("a", F.coalesce(seen, F.lit(0))).alias("from"))
    return s.groupBy("doc_id").agg(F.sum(F.greatest(F.col("b") - F.col("from"), F.lit(0))).cast("int").alias("shared_chars"))
