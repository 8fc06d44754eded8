"""Passages of held-out items inside a corpus of damaged subtitle files.

A prefix-filtered set join. Both sides become words that survive the usual damage: wrongly decoded bytes are
decoded again, cue numbers, time lines and markup are dropped, case, accents and punctuation folded, and letters
that character recognition confuses mapped to one sign. Bracketed text, lyrics, advert lines, speaker labels and
dashes are kept as stretches that may be read or skipped, so a passage is found inside them and around them.

A leak is an item-sized window, ``WINDOW`` consecutive words of an item. Its shingles are its pairs of neighbouring
words; of a window with at most ``DAMAGED`` spoiled words ``SHARED`` shingles are whole, so the document has ``MET``
of the window's ``PREFIX`` rarest, rarity being the number of places in the corpus, counted over all documents.

1. One pass over the documents, whatever the number of items: shingles are looked up in a bit table of the items'
   shingles (of a bounded size, a filter only) and counted; where ``SHARED`` of them stand within a window (the
   positional bound), the words around go on as a segment. Texts are neither shuffled nor read again.
2. The shingles of an item's windows are ranked by rarity; segments and items meet by an equi-join on the prefix,
   ``MET`` of it in one window of the item.
3. Each pair is verified word by word from every common shingle, damaged words by edit distance, over all ways of
   skipping stretches, for a run of at least ``WINDOW`` words of the item.

Defined cases: null and empty texts hold nothing; items under ``WINDOW`` words cannot leak; repeated
documents give one row per (doc_id, item_id); texts are read whole; extra columns are ignored. A word spoiled in
more than two letters ends a run. The words of the items (a vocabulary) are sent to every worker.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import joined, worker_cache, written

WINDOW = 10
DAMAGED = 2
#: Shingles of a window that DAMAGED words leave whole; of its PREFIX rarest at least MET are among them.
SHARED = WINDOW - 1 - 2 * DAMAGED
MET = 3
PREFIX = WINDOW - 1 - SHARED + MET
#: Words by which merged or split words may stretch a window.
SLACK = 2
#: Bits of the table of shingles: per shingle, and at most.
BITS, MOST_BITS = 32, 1 << 31
#: Candidates that one task verifies; they are small in bytes, so their number decides.
TASK_PAIRS = 5_000
#: Bytes up to which written tables of items and candidates are broadcast.
FEW_BYTES = 32 << 20

TIMES = re.compile(r"^(?:[^\S\n]*\d+[^\S\n]*\n)?[^\S\n]*\d{1,2}:\d\d:\d\d[.,:]\d+[^\S\n]*-->.*$", re.M)
#: Markup: elements of subtitle formats, of any length, and override codes.
TAGS = re.compile(r"</?(?:i|b|u|s|em|strong|font|span|br|p|c|v|ruby|rt|lang)\b[^<>\n]*>|\{\\[^{}\n]*\}", re.I)
#: Stretches that may be skipped.
SOUNDS = {c: re.compile(p) for c, p in {"[": r"\[[^\[\]]*\]", "(": r"\([^()]*\)", "{": r"\{[^{}]*\}", "<": r"<[^<>]*>", "♪": r"♪[^♪\n]*♪"}.items()}
ADVERT_WORDS = re.compile(r"\.example\b|Untertitel|Subtitles? by|Traduit par|Sous-titres|Subtítulos|Captions by")
LABELS = re.compile(r"^[^\S\n]*(?:-[^\S\n]*)?[^\W\d_a-z](?:[^\W\d_a-z]|[ .'’-])*:(?=\s)|^[^\S\n]*[-–](?=[^\S\n])", re.M)

#: Signs that recognition confuses, each mapped to one of its group (fixed values).
CONFUSED = {"0": "o", "1": "l", "i": "l", "|": "l", "5": "s", "8": "b", "e": "c", "é": "c"}
JOINED = (("rn", "m"), ("vv", "w"), ("ii", "n"))


def repair(text: str) -> str:
    """Undo UTF-8 that was decoded as Latin-1 or Windows-1252; other text is left as it is."""
    if not ("Ã" in text or "â" in text or "Â" in text):
        return text

    def one(m: re.Match) -> str:
        for codec in ("cp1252", "latin-1"):
            try:
                return m.group().encode(codec).decode("utf-8")
            except UnicodeError:
                pass
        return m.group()

    return re.sub(r"[\u00c2-\u00f4][\u0080-\u00bf\u0152-\u0192\u02c6-\u02dc\u2013-\u203a\u20ac\u2122]{1,3}", one, text)


def stretches(text: str) -> list[tuple[int, int]]:
    """Spans of a text that may be skipped: brackets, lyrics, adverts, labels and dashes at the start of a line."""
    out = [m.span() for c, p in SOUNDS.items() if c in text for m in p.finditer(text)]
    for m in ADVERT_WORDS.finditer(text):
        a = text.rfind("\n", 0, m.start()) + 1
        b = text.find("\n", m.end())
        out.append((a, b if b >= 0 else len(text)))
    out += [m.span() for m in LABELS.finditer(text)]
    return out


def spoken(text: str) -> str:
    """A subtitle file without numbers, times and markup."""
    text = repair(text.replace("\r\n", "\n").replace("\r", "\n").lstrip("\ufeff"))
    text = TIMES.sub("", text)
    return TAGS.sub("", text) if "<" in text or "{" in text else text


def plain(word: str) -> str:
    """Letters and digits of a word, folded."""
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    return re.sub(r"[\W_]+", "", word.lower())


_SWAP = str.maketrans(CONFUSED)


def sign(word: str) -> str:
    """A word up to confused letters; a dash standing alone is a word of its own."""
    p = plain(word).translate(_SWAP)
    for a, b in JOINED:
        p = p.replace(a, b)
    return p or ("—" if word and not word.strip("—–-") else "")


def _signs(text: str) -> list[tuple[str, int]]:
    """Signs of the words of a text with their hashes."""
    kept = worker_cache("leak-signs", dict)
    if len(kept) > 500_000:
        kept.clear()
    out = []
    for w in text.split():
        s = kept.get(w)
        if s is None:
            x = sign(w)
            s = kept[w] = (x, xxhash.xxh3_64_intdigest(x))
        if s[0]:
            out.append(s)
    return out


def words(text: str) -> list[str]:
    return [s for s, _ in _signs(text)]


def reading(text: str) -> tuple[list[tuple[str, int]], list[tuple[int, int]]]:
    """Words of a subtitle file with their hashes, and the stretches [a, b) of them that may be skipped."""
    text = spoken(text)
    spans = stretches(text)
    if not spans:
        return _signs(text), []
    cuts = sorted({0, len(text), *(x for s in spans for x in s)})
    out: list[tuple[str, int]] = []
    at = {0: 0}
    for a, b in zip(cuts, cuts[1:]):
        out += _signs(text[a:b])
        at[b] = len(out)
    return out, sorted({(at[a], at[b]) for a, b in spans if at[a] < at[b]})


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def near(a: str, b: str) -> bool:
    """Whether a damaged word may be the other: two edits in long words, one in short ones that begin alike."""
    if a == b:
        return True
    n, m = len(a), len(b)
    short = min(n, m)
    most = 2 if short >= 8 else 1 if short >= 4 or (short >= 2 and a[0] == b[0]) else 0
    if abs(n - m) > most or not most:
        return False
    row = list(range(m + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[m] <= most


def bridges(skips: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Pairs of words that become neighbours when stretches between them are skipped."""
    jump = defaultdict(list)
    for a, b in skips:
        jump[a].append(b)
    out = []
    for a in jump:
        if a == 0:
            continue
        seen, todo = set(), list(jump[a])
        while todo:
            b = todo.pop()
            if b < n and b not in seen:
                seen.add(b)
                out.append((a - 1, b))
                todo += jump.get(b, ())
    return out


class Judge:
    """Verification of segments against items; ``known`` are all words of the items, ``numbers`` those that are numbers."""

    def __init__(self, known: set[str], numbers: set[str]):
        self.known, self.numbers = known, numbers
        self.near: dict[tuple[str, str], bool] = {}
        self.items: dict[str, tuple] = {}
        self.last: tuple | None = None

    def same(self, a: str, b: str) -> bool:
        if a == b:
            return True
        if a in self.known or b in self.numbers:
            return False
        if len(self.near) > 200_000:
            self.near.clear()
        r = self.near.get((a, b))
        if r is None:
            r = self.near[a, b] = near(a, b)
        return r

    def pairs_of(self, item: str) -> tuple[list[str], dict[tuple[str, str], list[int]]]:
        """The words of an item and the places of its pairs."""
        got = self.items.get(item)
        if got is None:
            if len(self.items) > 5_000:
                self.items.clear()
            words, places = item.split(" "), defaultdict(list)
            for q in range(len(words) - 1):
                places[words[q], words[q + 1]].append(q)
            got = self.items[item] = words, dict(places)
        return got

    def segment(self, doc: str, skips: list[int]) -> tuple[list[str], list[tuple[int, int]], dict]:
        """The words of a segment, what may be skipped, and the places of its pairs; segments come sorted, so the last one is kept."""
        if self.last is None or self.last[0] != doc or self.last[1] != skips:
            words, spans, places = doc.split(" "), list(zip(skips[::2], skips[1::2])), defaultdict(list)
            for p, pair in enumerate(zip(words, words[1:])):
                places[pair].append((p, p + 1))
            for p, r in bridges(spans, len(words)):
                places[words[p], words[r]].append((p, r))
            self.last = doc, skips, (words, spans, dict(places))
        return self.last[2]

    def holds(self, text: str, stretches: list[int], item: str) -> bool:
        """Whether the words of a segment (stretches: first and past-last word of each, one after the other) hold WINDOW
        consecutive words of the item."""
        words, places = self.pairs_of(item)
        doc, skips, here = self.segment(text, stretches)
        common = here.keys() & places.keys()
        if len(words) < WINDOW or sum(len(places[x]) for x in common) < SHARED:
            return False
        hits = sorted((p, r, q) for x in common for p, r in here[x] for q in places[x])
        hits = self._bound(hits, skips, len(doc))
        if not hits:
            return False
        ahead, back = defaultdict(list), defaultdict(list)
        for a, b in skips:
            ahead[a].append(b)
            back[b].append(a)
        done: set[tuple[int, int]] = set()
        for p, r, q in hits:
            if (p, q) in done:
                continue
            first = self._reach(doc, back, words, p, q, -1, done)
            last = self._reach(doc, ahead, words, r, q + 1, 1, done)
            if last - first + 1 >= WINDOW:
                return True
        return False

    @staticmethod
    def _bound(hits: list[tuple[int, int, int]], skips: list[tuple[int, int]], n: int) -> list[tuple[int, int, int]]:
        """The hits that belong to SHARED shingles of some window of the item near one offset, stretches all read or all skipped;
        where some are read and some skipped within a passage, the offset moves, and one damaged word is allowed."""

        def close(q: set[int], least: int) -> set[int]:
            if len(q) < least:
                return set()
            q = sorted(q)
            return {x for k in range(len(q) - least + 1) if q[k + least - 1] - q[k] < WINDOW - 1 for x in q[k : k + least]}

        every = {h[2] for h in hits}
        if not close(every, SHARED):
            return []
        near: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
        for h in hits:
            # Offsets within 4 share one of two buckets.
            near[0, (h[0] - h[2]) >> 3].append(h)
            near[1, (h[0] - h[2] + 4) >> 3].append(h)
        kept: set[tuple[int, int, int]] = set()
        if skips:
            inside = [0] * (n + 1)
            for a, b in skips:
                inside[a] += 1
                inside[b] -= 1
            place, covered, at = [], 0, 0
            for k in range(n):
                covered += inside[k]
                at += covered == 0
                place.append(at)
            for h in hits:
                near[2, (place[h[0]] - h[2]) >> 3].append(h)
                near[3, (place[h[0]] - h[2] + 4) >> 3].append(h)
            mixed = close(every, SHARED + 2)
            kept.update(h for h in hits if h[2] in mixed)
        for some in near.values():
            if len(some) >= SHARED:
                q = close({h[2] for h in some}, SHARED)
                kept.update(h for h in some if h[2] in q)
        return sorted(kept)

    def _reach(self, doc: list[str], jump: dict[int, list[int]], item: list[str], p: int, q: int, way: int, done: set) -> int:
        """Last word of the item matched going one way from doc[p] = item[q]."""
        n, m = len(doc), len(item)
        # Equal words where nothing can be skipped need no search.
        while True:
            i, j = p + way, q + way
            if not (0 <= i < n and 0 <= j < m) or doc[i] != item[j] or (i if way > 0 else p) in jump:
                break
            if way > 0:
                done.add((p, q))
            p, q = i, j
        best = q
        seen = {(p, q)}
        todo = [(p, q)]
        while todo:
            i, j = todo.pop()
            if (j - best) * way > 0:
                best = j
            if way > 0:
                done.add((i, j))
            for i2 in self._next(jump, i, way, len(doc)):
                for to in self._steps(doc, jump, item, i2, j + way, way):
                    if to not in seen:
                        seen.add(to)
                        todo.append(to)
        return best

    @staticmethod
    def _next(jump: dict[int, list[int]], i: int, way: int, n: int) -> list[int]:
        """Places of the word that follows (precedes) word i, by skipping or not; stretches are [a, b)."""
        edge = i + 1 if way > 0 else i
        if edge not in jump:
            return [i + way] if 0 <= i + way < n else []
        edges, todo = {edge}, [edge]
        while todo:
            for x in jump.get(todo.pop(), ()):
                if x not in edges:
                    edges.add(x)
                    todo.append(x)
        at = edges if way > 0 else {x - 1 for x in edges}
        return [x for x in at if 0 <= x < n]

    def _steps(self, doc: list[str], jump: dict, item: list[str], i: int, j: int, way: int) -> Iterator[tuple[int, int]]:
        if not 0 <= j < len(item):
            return
        if self.same(doc[i], item[j]):
            yield i, j
            return
        for i2 in self._next(jump, i, way, len(doc)):
            if self.same(doc[i] + doc[i2] if way > 0 else doc[i2] + doc[i], item[j]):
                yield i2, j
        j2 = j + way
        if 0 <= j2 < len(item):
            if self.same(doc[i], item[j] + item[j2] if way > 0 else item[j2] + item[j]) or (item[j] == "—" and self.same(doc[i], item[j2])):
                yield i, j2


def _item_words(items: DataFrame) -> DataFrame:
    """item_id, words, hs (hashes of the pairs), numbers; one row per item text of at least WINDOW words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                s = _signs(t)
                if len(s) < WINDOW:
                    continue
                h = np.array([x for _, x in s], np.uint64)
                out.append((i, " ".join(x for x, _ in s), pair_hash(h[:-1], h[1:]).view(np.int64), list({sign(w) for w in t.split() if plain(w).isdigit()})))
            cols = list(zip(*out)) or [()] * 4
            types = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["item_id", "words", "hs", "numbers"])

    have = items.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return have.mapInArrow(work, "item_id long, words string, hs array<long>, numbers array<string>")


def bit_table(hashes: Iterator[int], count: int) -> np.ndarray:
    """A table of bits set at the hashes, of a bounded size."""
    size = 1 << 16
    while size < min(BITS * count, MOST_BITS):
        size *= 2
    table = np.zeros(size // 8, np.uint8)
    for h in hashes:
        k = h & (size - 1)
        table[k >> 3] |= 1 << (k & 7)
    return table


def _look_up(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    k = h & np.uint64(len(table) * 8 - 1)
    return (table[(k >> np.uint64(3)).astype(np.int64)] >> (k & np.uint64(7)).astype(np.uint8)) & 1 == 1


def segments_of(read: list[tuple[list[tuple[str, int]], list[tuple[int, int]]]], table: np.ndarray, count: Counter) -> Iterator[tuple[int, str, list[int], list[int]]]:
    """(number of the text, words, skips, shingles) of stretches with SHARED shingles within a window; all shingles met are counted."""
    n = np.array([len(w) for w, _ in read])
    start = np.zeros(len(read) + 1, np.int64)
    np.cumsum(n, out=start[1:])
    h = np.fromiter((x for w, _ in read for _, x in w), np.uint64, start[-1])
    a = np.arange(max(len(h) - 1, 0))
    ends = start[1:-1]
    ok = np.ones(len(a), bool)
    ok[ends[(ends > 0) & (ends < len(h))] - 1] = False
    a = a[ok]
    b = a + 1
    more = [(start[d] + x, start[d] + y) for d, (w, skips) in enumerate(read) if skips for x, y in bridges(skips, len(w))]
    if more:
        x = np.array(more, np.int64)
        a, b = np.concatenate([a, x[:, 0]]), np.concatenate([b, x[:, 1]])
    if not len(a):
        return
    key = pair_hash(h[a], h[b])
    hit = np.flatnonzero(_look_up(table, key))
    hit = hit[np.argsort(a[hit], kind="stable")]
    at, key = a[hit], key[hit]
    u, c = np.unique(key.view(np.int64), return_counts=True)
    for x, y in zip(u.tolist(), c.tolist()):
        count[x] += y
    doc = np.searchsorted(start, at, side="right") - 1
    # Place of every word when stretches count nothing.
    covered = np.zeros(len(h) + 1, np.int64)
    for d, (_, skips) in enumerate(read):
        for x, y in skips:
            covered[start[d] + x] += 1
            covered[start[d] + y] -= 1
    place = np.cumsum(np.cumsum(covered)[:-1] == 0) if len(h) else covered
    close = np.zeros(len(at), bool)
    if len(at) >= SHARED:
        k = np.flatnonzero((doc[SHARED - 1 :] == doc[: len(doc) - SHARED + 1]) & (place[at[SHARED - 1 :]] - place[at[: len(at) - SHARED + 1]] < WINDOW + SLACK))
        for s in range(SHARED):
            close[k + s] = True
    reach = WINDOW + SLACK
    group: list[int] = []
    chosen = np.flatnonzero(close).tolist()
    for x, k in enumerate(chosen):
        group.append(k)
        after = chosen[x + 1] if x + 1 < len(chosen) else None
        if after is not None and doc[after] == doc[k] and place[at[after]] - place[at[k]] <= 2 * reach:
            continue
        d = doc[k]
        lo = max(int(np.searchsorted(place, place[at[group[0]]] - reach, side="left")), start[d])
        hi = min(int(np.searchsorted(place, place[at[k]] + reach + 1, side="right")), start[d + 1])
        w, skips = read[d]
        lo, hi = lo - start[d], hi - start[d]
        inside = [z - lo for x, y in skips if x >= lo and y <= hi for z in (x, y)]
        yield int(d), " ".join(s for s, _ in w[lo:hi]), inside, list(dict.fromkeys(key[group].view(np.int64).tolist()))
        group = []


def _segments(docs: DataFrame, table) -> DataFrame:
    """Segments of documents (doc_id, words, skips, hs) and, with a null doc_id, counts of shingles (hs, n)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        count: Counter = Counter()
        names = ["doc_id", "words", "skips", "hs", "n"]
        types = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names)

        for b in batches:
            ids = b.column(0).to_pylist()
            for a in range(0, len(ids), 256):
                read = [reading(t.as_py()) for t in b.column(1)[a : a + 256]]
                yield batch([(ids[a + d], w, s, hs, None) for d, w, s, hs in segments_of(read, bits, count)])
            if len(count) > 200_000:
                yield batch([(None, None, None, list(count), list(count.values()))])
                count.clear()
        yield batch([(None, None, None, list(count), list(count.values()))])

    return docs.mapInArrow(work, "doc_id long, words string, skips array<int>, hs array<long>, n array<long>")


def _prefix(items: DataFrame, frequency: DataFrame) -> DataFrame:
    """(h, item_id, part): the PREFIX rarest shingles of every window of every item, in parts of two windows' length.

    Parts overlap by half (even and odd numbers), so every window lies in one part.
    """
    each = items.select("item_id", F.size("hs").alias("m"), F.posexplode("hs").alias("q", "h"))
    ranked = each.join(frequency, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = F.greatest(F.lit(0), F.col("q") - (WINDOW - 2))
    last = F.least(F.col("q"), F.col("m") - (WINDOW - 1))
    windows = ranked.select("item_id", "h", "q", "n", F.explode(F.sequence(first, last)).alias("k"))
    rank = F.row_number().over(W.partitionBy("item_id", "k").orderBy("n", "h", "q"))
    size = 2 * (WINDOW - 1)
    parts = F.array(F.expr(f"2 * (q div {size})"), F.expr(f"2 * ((q + {size // 2}) div {size}) + 1"))
    return windows.withColumn("rank", rank).where(F.col("rank") <= PREFIX).select("h", "item_id", F.explode(parts).alias("part")).distinct()


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold ten or more consecutive words of an item."""
    sc = documents.sparkSession.sparkContext
    docs = documents.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = written(_item_words(items), "items")
    shingles = known.select(F.explode("hs").alias("h")).distinct()
    table = sc.broadcast(bit_table((r.h for r in shingles.toLocalIterator()), shingles.count()))
    vocabulary = {r.w for r in known.select(F.explode(F.split("words", " ")).alias("w")).distinct().toLocalIterator()}
    numbers = {r.w for r in known.select(F.explode("numbers").alias("w")).distinct().toLocalIterator()}
    lists = sc.broadcast((vocabulary, numbers))

    found = written(_segments(docs, table).withColumn("sid", F.monotonically_increasing_id()), "segments")
    counts = found.where("doc_id is null").select(F.explode(F.arrays_zip("hs", "n")).alias("c")).groupBy("c.hs").agg(F.sum("c.n").alias("n"))
    prefix = written(_prefix(known, counts.withColumnRenamed("hs", "h")), "prefix")
    segments = found.where("doc_id is not null")
    met = joined(segments.select("sid", F.explode("hs").alias("h")), prefix, ["h"], "inner", FEW_BYTES)
    met = met.groupBy("sid", "item_id", "part").agg(F.count("*").alias("met")).where(F.col("met") >= MET).select("sid", "item_id").distinct()
    met = written(met, "candidates")
    parts = met.count() // TASK_PAIRS + 1
    pairs = segments.select("sid", "doc_id", "words", "skips").repartition(parts, "sid").join(met.repartition(parts, "sid").hint("merge"), "sid")
    pairs = joined(pairs, written(known.select("item_id", F.col("words").alias("item")), "item-words"), ["item_id"], "inner", FEW_BYTES)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*lists.value)
        for b in batches:
            keep = []
            for w, s, i in zip(*(b.column(c).to_pylist() for c in ("words", "skips", "item"))):
                keep.append(judge.holds(w, s, i))
            yield b.select(["doc_id", "item_id"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("doc_id", "item_id", "words", "skips", "item").mapInArrow(verify, "doc_id long, item_id long").distinct()
