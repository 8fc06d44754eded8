import random
import re

from pyspark.sql import functions as F

from voxlake.operators import parsefail as P

LINES = "line_id long, file_id long, line_no int, raw string, extra string"
FILES = "file_id long, n_columns int, extra string"


def run(rows, lines, files):
    both = rows([(i, f, i, r, "x") for i, (f, r) in enumerate(lines)], LINES), rows([(*f, "y") for f in files], FILES)
    bad = {r.line_id: r.reason for r in P.failed_lines(P.parse_cells(*both)).collect()}
    good = {}
    for r in P.loaded_cells(*both).orderBy("line_id", "col").collect():
        good.setdefault(r.line_id, []).append(r.value)
    return bad, good


def plain(raw, n):
    """The rule written straight down."""
    if raw is None:
        return None
    s = re.sub(r"^[ \t]+|[ \t]+$", "", raw[:-1] if raw.endswith("\r") else raw)
    if not s:
        return None
    cells = re.split(r"[ \t]+", s)
    if any('"' in c and not re.fullmatch('"[^"]*"', c) for c in cells):
        return "quoting"
    if len(cells) != n:
        return "column_count"
    for c in cells:
        c = c[1:-1] if c.startswith('"') else c
        if not re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", c) or abs(float(c)) == float("inf"):
            return "invalid_value"
    return None


def test_reasons(rows):
    lines = ["1 2", "\t1  2 \r", '"1" "2"', '"1 "2"', "1", "1 2 3", "1 x", "1 1e400", "nan 2", '1 2"', '1 ""', "", " \t ", None, "+.5 5.", "1\xa02", "٣ 1", "-.75e2 1E+3", "1 0x1F", "1 2d"]
    bad, good = run(rows, [(1, r) for r in lines], [(1, 2)])
    assert bad == {i: plain(r, 2) for i, r in enumerate(lines) if plain(r, 2)}
    assert good[0] == [1.0, 2.0] and good[2] == [1.0, 2.0] and good[14] == [0.5, 5.0] and good[17] == [-75.0, 1000.0]
    assert set(good) == {i for i, r in enumerate(lines) if r and r.strip() and not plain(r, 2)}


def test_random_against_plain_rule(rows):
    rnd = random.Random(3)
    parts = ["1", "-2.5", "3e4", '"7"', '"', "x", " ", "\t", "  ", "1,5", '""', ".", "\r"]
    lines = ["".join(rnd.choice(parts) + rnd.choice([" ", "\t", "", " "]) for _ in range(rnd.randint(0, 5))) for _ in range(400)]
    bad, good = run(rows, [(1, r) for r in lines], [(1, 3)])
    assert bad == {i: plain(r, 3) for i, r in enumerate(lines) if plain(r, 3)}


def test_unknown_file_repeats_and_empty(rows, spark):
    bad, good = run(rows, [(9, "1")], [(1, 1)])
    assert bad == {0: "column_count"} and good == {}
    lines = rows([(5, 1, 1, "1 2", "a"), (5, 1, 1, "1 2", "b"), (6, 1, 2, "z", "a"), (6, 1, 2, "z", "a")], LINES)
    files = rows([(1, 2, "a"), (1, 2, "b")], FILES)
    c = P.parse_cells(lines, files)
    assert P.loaded_cells(lines, files).count() == 2
    assert [tuple(r) for r in P.failed_lines(c).collect()] == [(6, "column_count")]
    none = lines.where(F.lit(False)), rows([], FILES)
    assert P.failed_lines(P.parse_cells(*none)).count() == 0 and P.loaded_cells(*none).count() == 0


def test_long_line(rows):
    bad, good = run(rows, [(1, " ".join(["1.5"] * 20000)), (1, "a" * 100000)], [(1, 20000)])
    assert bad == {1: "column_count"} and len(good[0]) == 20000


def test_rules_are_data(rows):
    """Another rule table, other failures."""
    lines = rows([(0, 1, 0, "1 2", "x"), (1, 1, 1, "-1 2", "x"), (2, 1, 2, "7", "x")], LINES)
    cells = P.parse_cells(lines, rows([(1, 2, "y")], FILES))
    rules = [("cell", r"\A[0-9]+\z", True, "not_natural", 1)]
    assert [tuple(r) for r in P.failed_lines(cells, rules).collect()] == [(1, "not_natural")]
    assert P.failed_lines(cells, []).count() == 0
