import random
from itertools import combinations

import pytest
from hypothesis import given, settings, strategies as st

from voxlake.llm import names as N

SCHEMA = "header_id long, patientname string, operatorsname string, institutionname string, field string"


def naive(a, b):
    """Edit distance with unrestricted swaps, from its definition by search."""
    if a == b:
        return 0
    return next(d for d in range(1, len(a) + len(b) + 1) if _reach(a, b, d))


def _reach(a, b, d):
    if a == b:
        return True
    if d == 0:
        return False
    out = {a[:i] + a[i + 1 :] for i in range(len(a))}
    letters = set(b)
    out |= {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in letters} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in letters}
    out |= {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    return any(_reach(x, b, d - 1) for x in out)


@settings(max_examples=150, deadline=None)
@given(st.text("ab", max_size=4), st.text("abc", max_size=4))
def test_metric(a, b):
    d = naive(a, b)
    assert N.distance(a, b, 9) == d and N.within_one(a, b) is (d <= 1)
    if d <= 1:
        assert set(N.shortened(a)) & set(N.shortened(b))


def pairs(rows, patients=(), operators=(), places=()):
    data = [(i, p, None, None, "x") for i, p in enumerate(patients)] + [(100 + i, None, o, None, "x") for i, o in enumerate(operators)]
    data += [(200 + i, None, None, n, "x") for i, n in enumerate(places)]
    return {tuple(r) for r in N.linked_pairs(rows(data, SCHEMA)).collect()}


def test_entities(rows):
    groups = [
        ["Sutaloha, Veronica", "SUTALOHA^VERONICA", "Ronnie Sutaloha", "Sutalloha^Veronica^", "sutaloha veronica ", "Veroncia K. Sutaloha", "Sutaloha^V", "Dr. Veronica Sutáloha (555 0172"],
        ["Sutaloha, Benjamin", "Ben Sutaloha"],
        ["Tagepoha^Samuel", "Samuel Taegpoha", "S. Tagepoha"],
    ]
    nobody = ["anonymous", "VP000253", "", None, "ANON^12"]
    got = pairs(rows, [v for g in groups for v in g] * 2 + nobody)
    assert got == {("patientname", *sorted(p)) for g in groups for p in combinations(g, 2)}


def test_institutions(rows):
    groups = [
        ["Babadaberg University Hospital", "Univ. Hosp. Babadaberg", "Babadaberg UH", "Babadbaerg University Hosp.", "The Babadaberg University Hospital", "Babadaberg University Hospital, Dept. of Radiology"],
        ["Babadaberg Brain Research Centre", "BRC Babadaberg", "Babadaberg Centre for Brain Research", "Babadaberg, Brain Res. Ctr"],
        ["Tevetoville Children's Clinic", "Clinic for Children Tevetoville", "Tevetoville Childrens Clinic", "Tevetowille Child. Clin."],
    ]
    assert pairs(rows, places=[v for g in groups for v in g]) == {("institutionname", *sorted(p)) for g in groups for p in combinations(g, 2)}


def test_ambiguous_initial_and_empty(rows):
    got = pairs(rows, operators=["Ada Fobezare", "Fobezare, Ada", "Abel Fobezare", "Fobezare^Abel", "A. Fobezare"])
    assert got == {("operatorsname", "Ada Fobezare", "Fobezare, Ada"), ("operatorsname", "Abel Fobezare", "Fobezare^Abel")}
    assert pairs(rows) == set()
    assert pairs(rows, ["x" * 3000 + " " + "y" * 3000]) == set()


def test_radius_join_misses_nothing(rows, spark):
    """Every pair within the radius is linked, whatever the pivots: against all pairs."""
    rnd = random.Random(4)
    given = ["robert", "susan", "nicholas", "gabriela"]
    base = [(rnd.choice(given), "".join(rnd.choice("bdfgklm") + rnd.choice("aeiou") for _ in range(4))) for _ in range(40)]

    def typo(w):
        i = rnd.randrange(len(w) - 1)
        return rnd.choice([w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])

    names = base + [(typo(g) if rnd.random() < 0.5 else g, typo(s)) for g, s in base for _ in range(3)]
    values = sorted({f"{s}^{g}" for g, s in names})
    got = {r.value: r.entity for r in N.linked_values(rows([(i, v, None, None, "x") for i, v in enumerate(values)], SCHEMA)).collect()}
    for a, b in combinations(values, 2):
        (sa, ga), (sb, gb) = a.split("^"), b.split("^")
        if N.within_one(N.FULL.get(ga, ga), N.FULL.get(gb, gb)) and N.within_one(sa, sb):
            assert got[a] == got[b], (a, b)


def test_components(rows):
    edges = rows([(i, i + 1) for i in range(20, 40)] + [(1, 2), (2, 1), (5, 5)], "a long, b long")
    got = {r.id: r.label for r in N.components(edges).collect()}
    assert {got[i] for i in range(20, 41)} == {20} and got[1] == got[2] == 1 and got[5] == 5
    assert N.components(edges.where("false")).count() == 0


@pytest.mark.parametrize("value,want", [("Zaziroholm UH", ("hospital university", "zaziroholm")), ("Gen Inf Tuvofiberg", ("general infirmary", "tuvofiberg")), ("N/A", None), ("University Hospital", None)])
def test_institution_parts(value, want):
    assert N.institution_parts(value) == want


@pytest.mark.parametrize("radius,tile", [(1, 7), (2, 2000), (3, 11)])
def test_radius_join_against_brute_force(rows, radius, tile):
    g = random.Random(radius)
    word = lambda n: "".join(g.choice("abcdez") for _ in range(n))
    given = ["q" + word(6) for _ in range(5)]

    def damaged(w):
        for _ in range(g.randint(0, 2)):
            i = g.randrange(1, len(w) - 1)
            w = g.choice([w[:i] + w[i + 1 :], w[:i] + g.choice("abz") + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])
        return w

    base = [("x" + word(9), g.choice(given)) for _ in range(25)]
    names = sorted({(damaged(s), damaged(p)) for s, p in base for _ in range(4)})
    root = list(range(len(names)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in combinations(enumerate(names), 2):
        if all(N.distance(x, y, radius) <= radius for x, y in zip(a, b)):
            root[find(i)] = find(j)
    data = [(i, f"{s}, {p}", None, None, "x") for i, (s, p) in enumerate(names)]
    got = {}
    for r in N.linked_values(rows(data, SCHEMA), radius, tile).collect():
        got.setdefault(r.entity, set()).add(r.value)
    want = {}
    for i, (s, p) in enumerate(names):
        want.setdefault(find(i), set()).add(f"{s}, {p}")
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_hot_entity_in_parts(rows, monkeypatch):
    monkeypatch.setattr(N, "VALUES", 2)
    same = ["Sutaloha, Veronica", "SUTALOHA^VERONICA", "Ronnie Sutaloha", "Sutalloha^Veronica^", "sutaloha veronica "]
    assert pairs(rows, same * 3) == {("patientname", *sorted(p)) for p in combinations(same, 2)}


def test_any_number_of_given_names(rows):
    g = random.Random(1)
    given = list({"b" + "".join(g.choice("aeioulnrst") for _ in range(8)) for _ in range(700)})
    known = [f"Xyzu{i}q, {w}".replace(str(i), "abcdefghij"[i % 10] * 3 + "klmnopqrst"[i // 10 % 10] * 3 + "uvwxyzabcd"[i // 100]) for i, w in enumerate(given)]
    got = pairs(rows, known + [" ".join(x.split(", ")) for x in known])
    assert {("patientname", *sorted((x, " ".join(x.split(", "))))) for x in known} <= got
