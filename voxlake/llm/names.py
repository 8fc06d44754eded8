"""Variant spellings of names typed by people, linked to the entity they name.

Every distinct value is read into two parts: for a person the given name (nicknames brought to the full name)
and the surname, for an institution its kind (the words that say what it is, abbreviations and acronyms
written out) and its place. Two names are within the radius if both parts are within one edit (insertion,
deletion, replacement or a swap of neighbours): the maximum of two edit metrics, itself a metric.

The metric space is partitioned by pivots: the frequent first parts of the data, at most ``PIVOTS``. A name
belongs to the cell of each pivot within twice the radius of its first part, and one with no pivot within the
radius to the cell of the rest as well; by the triangle inequality any two names within the radius then share
a cell. Cells of more than ``TILE`` names are cut into tiles, each a pair of blocks, so no cell is one task. Inside
a tile an exact radius join runs: lengths and sets of letters, two lower bounds of the metric, are compared for
whole rows at a time, what passes is tested with the metric on both parts. What is linked in a tile goes on as a
star around its smallest name, so the components take few rounds of label propagation. A name with only an initial
meets the names of its letter in a cell of their own, by the same metric, and joins the one entity of that surname
whose given name begins so, if it is one or clearly the most frequent.

Whether the surname comes first where nothing says so is decided by the words that stand as given names more often
than as surnames where the order is known: all of them, whatever their number.

All steps work on distinct values and distinct parts, so a name that holds a third of all rows is one value.
Result pairs are all pairs of values within an entity, as the problem asks for.

Defined cases: null and empty values, pseudonyms and placeholders name nobody; repeated rows count once; an
initial that fits several entities about equally often is left alone; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import written
from . import pii

FIELDS = ("patientname", "operatorsname", "institutionname")
RADIUS = 1
PIVOTS = 512
#: First parts in fewer distinct values than this are no pivots.
PIVOT_VALUES = 5
#: Names of a cell that meet in one task.
TILE = 2000
#: Values of an entity that one task pairs with the rest of it.
VALUES = 1000
#: How much more frequent an entity must be than the next to take an initial that fits both.
CLEAR = 3

#: Nicknames of the full name at the head of each line (fixed values).
NICKNAMES = """
alexander alex sandy sasha
anthony tony
antonia toni
benjamin ben benny
charles charlie chuck
christopher chris kit
daniel dan danny
deborah debbie deb
dmitri dima dmitry
dorothea dora thea dorothy
edward ed ned eddie
ekaterina katya
elizabeth liz lizzie beth betty
francisco paco pancho
friedrich fritz
gabriela gabi
giuseppe beppe peppe
henrietta hettie etta
ignacio nacho
isabella bella izzy
johannes hans hannes
joseph joe
josephine jo josie
katherine kate kathy katie
leonard leo len lenny
margaret maggie peggy meg
mikhail misha
nathaniel nate nathan
nicholas nick nico
oliver ollie
patricia pat trish patty
philippa pippa
raymond ray
rebecca becky
richard rick dick rich
robert bob rob bobby
samuel sam sammy
susan sue suzie susie
theodore ted theo teddy
ulrich uli
veronica ronnie vera
victoria vicky tori
vladislav vlad slava
wilhelmina mina
william will bill billy
zachary zach zack
"""
FULL = {n: line.split()[0] for line in NICKNAMES.strip().splitlines() for n in line.split()}

#: Words that say what an institution is, with the abbreviations that are no prefix of them (fixed values).
KIND_WORDS = (
    "university hospital general infirmary institute neuroimaging brain research centre children clinic imaging medical medicine college school "
    "laboratory psychiatry health science sciences neuroscience foundation national royal regional district memorial"
).split()
KIND_FORMS = {"center": "centre", "ctr": "centre", "childrens": "children", "childrensclinic": "children", "klinik": "clinic", "klinikum": "clinic", "institut": "institute"}
ACRONYMS = {"uh": "hospital university", "brc": "brain centre research", "gi": "general infirmary", "cc": "children clinic", "ion": "institute neuroimaging", "in": "institute neuroimaging"}
UNITS = frozenset("dept department radiology neurology unit mri mrt section division ward lab abteilung service psychiatry cardiology neuroradiology".split())
NOBODY = frozenset("operator tech technician mri mrt user admin staff unknown nurse radiographer test phantom anonymous none patient pilot".split())
STOP = frozenset("of for the f and de la der des du fur".split())


def folded(s: str) -> str:
    s = unicodedata.normalize("NFD", s.lower())
    return "".join(c for c in s if not unicodedata.combining(c)).replace("ß", "ss")


def within_one(a: str, b: str) -> bool:
    """Whether two strings are within one insertion, deletion, replacement or swap of neighbours."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if n > m:
        a, b, n, m = b, a, m, n
    if m - n > 1:
        return False
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    if n == m:
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :]


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with swaps (unrestricted, so a metric), or most + 1 if larger."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    big = n + m
    last_row: dict[str, int] = {}
    d = [[big] * (m + 2) for _ in range(n + 2)]
    for i in range(n + 1):
        d[i + 1][1] = i
    for j in range(m + 1):
        d[1][j + 1] = j
    for i in range(1, n + 1):
        last_col = 0
        for j in range(1, m + 1):
            k, q = last_row.get(b[j - 1], 0), last_col
            same = a[i - 1] == b[j - 1]
            if same:
                last_col = j
            d[i + 1][j + 1] = min(d[i][j] + (not same), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][q] + (i - k - 1) + 1 + (j - q - 1))
        last_row[a[i - 1]] = i
    return min(d[n + 1][m + 1], most + 1)


def within(a: str, b: str, radius: int) -> bool:
    """Whether two strings are within the radius of the metric."""
    return a == b or (within_one(a, b) if radius == 1 else radius > 1 and distance(a, b, radius) <= radius)


def letters(s: str) -> int:
    """The set of letters of a string as bits: two strings within r edits differ in at most 2 r bits."""
    out = 0
    for c in s:
        out |= 1 << (ord(c) & 63)
    return out


def person_words(value: str) -> tuple[list[str], bool | None]:
    """Folded words of the name in a value, without titles, contacts and middle initials; and whether the surname
    is known to come first (None: not known)."""
    span = next(((a, b) for k, a, b in pii.person_items(value) if k == "name"), None)
    if span is None:
        return [], None
    name = value[span[0] : span[1]]
    first = True if "^" in name.strip("^ ") or "," in name else None
    words = [folded(w) for w in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", name)]
    long = [w for w in words if len(w) > 1]
    if len(long) >= 2:
        words = long
    return [re.sub(r"['’-]", "", w) for w in words], first


def shortened(s: str) -> list[str]:
    """The string and all strings with one letter left out; two strings within one edit share one."""
    return list(dict.fromkeys([s, *(s[:i] + s[i + 1 :] for i in range(len(s)))]))


class Given:
    """Given names, looked up exactly or with one edit."""

    def __init__(self, names: frozenset[str]):
        self.names = names
        self.near: dict[str, list[str]] = {}
        for n in names:
            for k in shortened(n):
                self.near.setdefault(k, []).append(n)

    def knows(self, w: str) -> bool:
        return w in self.names or (len(w) > 3 and any(within_one(w, g) for k in shortened(w) for g in self.near.get(k, ())))


def person_parts(value: str, given: Given) -> tuple[str, str] | None:
    """(first part, second part): full given name or an initial with a point, and surname."""
    words, first = person_words(value)
    if len(words) < 2 or not NOBODY.isdisjoint(words):
        return None
    if len(words[0]) == 1 or len(words[-1]) == 1:
        k = 0 if len(words[0]) == 1 else -1
        rest = words[1:] if k == 0 else words[:-1]
        return words[k] + ".", "".join(rest)
    if first is None:
        first = given.knows(words[-1]) and not given.knows(words[0])
    g, s = (words[-1], words[:-1]) if first else (words[0], words[1:])
    return FULL.get(g, g), "".join(s)


def _kind_word(w: str) -> str | None:
    if w in KIND_FORMS:
        return KIND_FORMS[w]
    for k in KIND_WORDS:
        if w == k or (len(w) >= 2 and len(w) < len(k) and k.startswith(w)):
            return k
    for k in (*KIND_WORDS, "childrens", "center"):
        if len(k) > 4 and within_one(w, k):
            return KIND_FORMS.get(k, k)
    return None


def institution_parts(value: str) -> tuple[str, str] | None:
    """(kind, place) of an institution; departments belong to theirs. A value without a kind or a place names none."""
    kinds: set[str] = set()
    place: list[str] = []
    for raw in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", value):
        w = re.sub(r"['’]", "", folded(raw))
        if raw.isupper() and w in ACRONYMS and len(raw) <= 3:
            kinds.update(ACRONYMS[w].split())
        elif w in STOP or w in UNITS:
            continue
        elif k := _kind_word(w):
            kinds.add(k)
        elif not any(len(u) > 4 and within_one(w, u) for u in UNITS):
            place.append(w)
    if not kinds or not place or re.fullmatch(r"(?i)anonym\w*|unknown|none|null|test|n|x+", "".join(place)):
        return None
    return " ".join(sorted(kinds)), "".join(place)


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of all ids in (a, b): the smallest id of the component, by propagation of labels.

    Each round is written to the shared folder; the rounds follow the diameter, a few for spellings.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least("a", F.min("b")).alias("label"))
    labels = written(labels, "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved"))
        # Jump to the label of the label.
        step = written(step, "labels")
        to = step.select(F.col("id").alias("label"), F.col("label").alias("to"))
        labels = written(step.join(to, "label", "left").select("id", F.coalesce(F.least("to", "label"), "label").alias("label")), "labels")
        if step.where("moved").limit(1).count() == 0:
            return labels


def _parse(values: DataFrame, given: frozenset[str]) -> DataFrame:
    """field, value, n to those with field, value, n, p, s."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Given(given)
        for b in batches:
            out = []
            for f, v, n in zip(*[b.column(i).to_pylist() for i in range(3)]):
                parts = institution_parts(v) if f == "institutionname" else person_parts(v, known)
                if parts and parts[1]:
                    out.append((f, v, n, *parts))
            cols = list(zip(*out)) or [()] * 5
            types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["field", "value", "n", "p", "s"])

    return values.repartition("value").mapInArrow(work, "field string, value string, n long, p string, s string")


def _given(values: DataFrame) -> frozenset[str]:
    """Words that are given names more often than surnames where the order is known, and the fixed ones: a vocabulary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [w for w, first in map(person_words, b.column(0).to_pylist()) if first and len(w) > 1 and len(w[-1]) > 1]
            given = [w[-1] for w in words]
            rest = [x for w in words for x in w[:-1]]
            cols = [pa.array(given + rest, pa.string()), pa.array([1] * len(given) + [-1] * len(rest), pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["p", "n"])

    ordered = values.where("field <> 'institutionname' and (instr(value, '^') > 0 or instr(value, ',') > 0)").select("value")
    more = ordered.mapInArrow(work, "p string, n int").groupBy("p").agg(F.sum("n").alias("n")).where("n > 0")
    return frozenset(FULL) | {r.p for r in more.select("p").toLocalIterator()}


def _cells(nodes: DataFrame, pivots: list[str], radius: int) -> DataFrame:
    """field, id, p, s to one row per cell the name belongs to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[str]] = {}
        bits = np.array([letters(q) for q in pivots], np.uint64)
        size = np.array([len(q) for q in pivots], np.int64)
        for b in batches:
            out = []
            for f, i, p, s in zip(*[b.column(c).to_pylist() for c in range(4)]):
                cells = seen.get(p)
                if cells is None:
                    far = np.bitwise_count(bits ^ np.uint64(letters(p))) > 4 * radius
                    d = {pivots[k]: distance(p, pivots[k], 2 * radius) for k in np.flatnonzero(~far & (np.abs(size - len(p)) <= 2 * radius))}
                    cells = [q for q, x in d.items() if x <= 2 * radius]
                    if min(d.values(), default=2 * radius + 1) > radius:
                        cells.append("*")
                    seen[p] = cells
                out += [(f, c, i, p, s) for c in cells]
            cols = list(zip(*out)) or [()] * 5
            types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["field", "cell", "id", "p", "s"])

    return nodes.select("field", "id", "p", "s").mapInArrow(work, "field string, cell string, id long, p string, s string")


def _tiles(cells: DataFrame, tile: int) -> DataFrame:
    """Rows of cells to rows of tiles: lo and hi are the two blocks of a tile, blk the block of the row."""
    size = cells.groupBy("field", "cell").agg(F.floor((F.count("*") - 1) / tile).cast("int").alias("last"))
    rows = cells.join(F.broadcast(size), ["field", "cell"])  # as many rows as pivots, letters and fields give
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("last") + 1).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    return rows.withColumn("lo", F.least("blk", "other")).withColumn("hi", F.greatest("blk", "other")).drop("other", "last")


def radius_pairs(p: list[str], s: list[str], left: np.ndarray, right: np.ndarray, radius: int, parts: bool = True) -> Iterator[tuple[int, int]]:
    """Pairs (i, j), i of ``left`` and j of ``right``, within the radius in the second part and, with ``parts``, in the first."""
    bits = [np.array([letters(x) for x in c], np.uint64) for c in ((s, p) if parts else (s,))]
    size = [np.array([len(x) for x in c], np.int64) for c in ((s, p) if parts else (s,))]
    kept: dict[tuple[str, str], bool] = {}
    for a in range(0, len(left), 256):
        row = left[a : a + 256]
        ok = np.ones((len(row), len(right)), bool)
        for m, n in zip(bits, size):
            ok &= np.bitwise_count(m[row][:, None] ^ m[right][None, :]) <= 2 * radius
            ok &= np.abs(n[row][:, None] - n[right][None, :]) <= radius
        for x, y in zip(*np.nonzero(ok)):
            i, j = int(row[x]), int(right[y])
            if i == j or not within(s[i], s[j], radius):
                continue
            if parts:
                pair = (p[i], p[j])
                near = kept.get(pair)
                if near is None:
                    near = kept[pair] = within(*pair, radius)
                if not near:
                    continue
            yield i, j


def _by_tile(work_on):
    """A kernel over rows sorted by tile: ``work_on(columns)`` for each whole tile, columns being lists."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if row[:4] != key:
                    if held:
                        yield work_on(list(zip(*held)))
                    held, key = [], row[:4]
                held.append(row)
        if held:
            yield work_on(list(zip(*held)))

    return work


def _linked(tiles: DataFrame, radius: int) -> DataFrame:
    """(a, b): names within the radius as stars around the smallest id of what is linked in a tile."""

    def join(c: list[tuple]) -> pa.RecordBatch:
        _, _, lo, hi, blk, ids, p, s = c
        blk = np.array(blk)
        left, right = np.flatnonzero(blk == lo[0]), np.flatnonzero(blk == hi[0])
        root = list(range(len(ids)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in radius_pairs(p, s, left, right, radius):
            i, j = find(i), find(j)
            if i != j:
                i, j = (i, j) if ids[i] < ids[j] else (j, i)
                root[j] = i
        star = [(ids[find(i)], ids[i]) for i in range(len(ids)) if find(i) != i]
        cols = list(zip(*star)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["a", "b"])

    key = ["field", "cell", "lo", "hi"]
    rows = tiles.select(*key, "blk", "id", "p", "s").repartition(*key).sortWithinPartitions(*key)
    return rows.mapInArrow(_by_tile(join), "a long, b long")


def _initials(short: DataFrame, full: DataFrame, tile: int, radius: int) -> DataFrame:
    """(a, b, far): names with an initial a and full names b of that letter within the radius of the surname."""

    def join(c: list[tuple]) -> pa.RecordBatch:
        _, _, lo, hi, blk, ids, p, s = c
        blk, ini = np.array(blk), np.array([x.endswith(".") for x in p])
        out = []
        for x, y in {(lo[0], hi[0]), (hi[0], lo[0])}:
            left, right = np.flatnonzero((blk == x) & ini), np.flatnonzero((blk == y) & ~ini)
            out += [(ids[i], ids[j], int(s[i] != s[j])) for i, j in radius_pairs(p, s, left, right, radius, False)]
        cols = list(zip(*out)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int32()))], ["a", "b", "far"])

    key = ["field", "cell", "lo", "hi"]
    cell = lambda df: df.select("field", F.substring("p", 1, 1).alias("cell"), "id", "p", "s")
    have = cell(full).join(cell(short).select("field", "cell").distinct(), ["field", "cell"], "left_semi")
    rows = _tiles(cell(short).unionByName(have), tile).select(*key, "blk", "id", "p", "s").repartition(*key).sortWithinPartitions(*key)
    return rows.mapInArrow(_by_tile(join), "a long, b long, far int")


def linked_values(headers: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(field, value, entity): the entity every value names, values that name nobody left out."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS]))
    rows = headers.select(each.alias("x")).select("x.field", "x.value").where("value is not null and trim(value) <> ''")
    values = written(rows.groupBy("field", "value").agg(F.count("*").alias("n")), "values")
    parsed = written(_parse(values, _given(values)), "parts")
    nodes = parsed.groupBy("field", "p", "s").agg(F.sum("n").alias("n")).withColumn("id", F.monotonically_increasing_id())
    nodes = written(nodes, "nodes")
    full, short = nodes.where("not endswith(p, '.')"), nodes.where("endswith(p, '.')")
    top = full.groupBy("p").count().where(F.col("count") >= PIVOT_VALUES).orderBy(F.desc("count"), "p").limit(PIVOTS)
    cells = written(_cells(full, [r.p for r in top.collect()], radius), "cells")
    label = components(_linked(_tiles(cells, tile), radius))
    full = written(full.join(label, "id", "left").withColumn("entity", F.coalesce("label", "id")).select("field", "id", "p", "s", "n", "entity"), "entities")
    # Initials: entities of the surname (or within the radius of it) whose first part begins so; the nearest, if clear.
    near = _initials(short, full, tile, radius).join(full.select(F.col("id").alias("b"), "n", "entity"), "b")
    near = near.groupBy("a", "far", "entity").agg(F.sum("n").alias("n")).groupBy("a", "far").agg(
        F.max(F.struct("n", "entity")).alias("best"), F.sum("n").alias("all"), F.count("*").alias("of")
    )
    near = near.groupBy("a").agg(F.min_by(F.struct("best", "all", "of"), "far").alias("x"))
    clear = (F.col("x.of") == 1) | (F.col("x.best.n") >= CLEAR * (F.col("x.all") - F.col("x.best.n")))
    near = near.select(F.col("a").alias("id"), F.when(clear, F.col("x.best.entity")).alias("entity"), F.lit(True).alias("fits"))
    # An initial that fits nothing stays an entity of its own; one that fits several equally is left out.
    short = short.join(near, "id", "left").where("entity is not null or fits is null").select("id", F.coalesce("entity", "id").alias("entity"))
    entity = full.select("id", "entity").unionByName(short)
    of = nodes.select("field", "p", "s", "id").join(entity, "id")
    return parsed.join(of, ["field", "p", "s"]).select("field", "value", "entity")


def linked_pairs(headers: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(field, name_a, name_b): all pairs of different values of one entity, name_a < name_b by code point.

    The values of an entity are cut into parts of about VALUES; each part meets all of them in a task of its own.
    """
    v = written(linked_values(headers, radius, tile), "linked")
    size = v.groupBy("field", "entity").agg(F.floor((F.count("*") - 1) / VALUES).cast("int").alias("last"), F.count("*").alias("of")).where(F.col("of") > 1)
    v = v.join(size, ["field", "entity"])
    a = v.select("field", "entity", F.pmod(F.xxhash64("value"), F.col("last") + 1).cast("int").alias("part"), F.col("value").alias("name_a"))
    b = v.select("field", "entity", F.explode(F.sequence(F.lit(0), "last")).alias("part"), F.col("value").alias("name_b"))
    return a.join(b, ["field", "entity", "part"]).where("name_a < name_b").select("field", "name_a", "name_b")
