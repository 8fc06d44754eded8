import random

from voxlake.llm import shared_spans as S

SCHEMA = "doc_id long, text string, fp long, a int"


def brute(docs):
    seen = {}
    for d, t in docs:
        for i in range(len(t or "") - S.SPAN + 1):
            seen.setdefault(t[i : i + S.SPAN], set()).add(d)
    out = {}
    for d, t in docs:
        cover = set()
        for i in range(len(t or "") - S.SPAN + 1):
            if len(seen[t[i : i + S.SPAN]]) > 1:
                cover.update(range(i, i + S.SPAN))
        if cover:
            out[d] = len(cover)
    return out


def found(rows, docs):
    return {r.doc_id: r.shared_chars for r in S.shared_characters(rows([(d, t, 1, 2) for d, t in docs], SCHEMA)).collect()}


def text(rnd, n, alphabet="abcdefgh \né中\U0001f600"):
    return "".join(rnd.choice(alphabet) for _ in range(n))


def test_against_brute_force(rows):
    rnd = random.Random(5)
    docs = []
    pieces = [text(rnd, rnd.randint(100, 700)) for _ in range(8)]
    for d in range(40):
        parts = [text(rnd, rnd.randint(0, 300))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(pieces)
            a = rnd.randint(0, len(p) // 3)
            parts += [p[a : rnd.randint(a, len(p))], text(rnd, rnd.randint(0, 50))]
        docs.append((d, "".join(parts)))
    docs += [(50, docs[3][1]), (51, docs[3][1][:159]), (52, docs[3][1][:160]), (53, None), (54, "")]
    assert found(rows, docs) == brute(docs)


def test_low_entropy_and_exact_borders(rows):
    base = "x" * 500
    docs = [(1, base), (2, "y" + "x" * 160 + "z"), (3, "x" * 159 + "q"), (4, "ab" * 200), (5, "ba" * 90 + "c"), (6, "ab" * 79 + "d")]
    assert found(rows, docs) == brute(docs)


def test_many_neighbours_of_one_passage(rows):
    rnd = random.Random(2)
    hot = text(rnd, 200)
    docs = [(d, text(rnd, 100) + hot[d % 5 : 200 - d % 7] + text(rnd, 100)) for d in range(S.PAIRS * 4)]
    assert found(rows, docs) == brute(docs)


def test_one_record_alone(rows):
    rnd = random.Random(3)
    t = text(rnd, 400)
    assert found(rows, [(1, t + t), (1, t)]) == {}
    assert found(rows, []) == {}
    assert found(rows, [(1, t), (1, t), (2, t), (None, t)]) == {1: 400, 2: 400}


def test_long_text_in_pieces(rows):
    rnd = random.Random(9)
    long = text(rnd, S.CHUNK + 5000, "abcdefghijklmnopqrstuvwxyz ")
    at = S.CHUNK // 2 - 100
    docs = [(1, long), (2, "q" * 50 + long[at : at + 400]), (3, long[-300:] + "!")]
    assert found(rows, docs) == {1: 700, 2: 400, 3: 300}


def test_many_asks_shuffle_only_the_asked(rows, monkeypatch):
    """The path beyond the broadcast gives the same."""
    import random

    g = random.Random(4)
    text = lambda n: "".join(g.choice("abcdefgh \n") for _ in range(n))
    common = [text(400) for _ in range(3)]
    docs = rows([(i, text(300) + common[i % 3] + text(200), "x") for i in range(9)] + [(20 + i, text(700), "x") for i in range(20)], "doc_id long, text string, extra string")
    want = sorted(map(tuple, S.shared_characters(docs).collect()))
    monkeypatch.setattr(S, "FEW_BYTES", 0)
    assert sorted(map(tuple, S.shared_characters(docs).collect())) == want and len(want) == 9
