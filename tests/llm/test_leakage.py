import pytest

from voxlake.llm import leakage as L

ITEM = "By the eclipse the grateful cooper owed Rook 553 maps, 683 varnished seedlings and one windmill — nothing engraved, nothing seven-sided. Zoé alone kept braided oars “for later”."
OTHER = "After low tide, 203 envious beekeepers catalogued the windmill; Teodric alone kept scarlet flasks and faded tiles “for later”."
DOC = "doc_id long, text string, item_id string"
ITEMS = "item_id long, text string, suite string"


def cues(words, per=4, extra=None, plain=False):
    w = words.split()
    out = []
    for k in range(0, len(w), per):
        n = k // per
        out.append(("" if plain else f"{n + 1}\n") + f"00:01:{n:02d},100 --> 00:01:{n:02d},900\n" + (extra(" ".join(w[k : k + per])) if extra else " ".join(w[k : k + per])))
    return "Did you sell the letter?\n\n" + "\n\n".join(out) + "\n\n99\n00:09:00,000 --> 00:09:01,000\nGood then."


def find(rows, docs, items=((1, ITEM), (2, OTHER))):
    d = rows([(i, t, "x") for i, t in docs], DOC)
    return {(r.doc_id, r.item_id) for r in L.leaks(d, rows([(*i, "s") for i in items], ITEMS)).collect()}


def part(a, b):
    return " ".join(ITEM.split()[a:b])


def test_damage(rows):
    cut = part(2, 20)
    docs = {
        1: cues(cut),
        2: cues(cut.upper(), plain=True).replace("\n", "\r\n"),
        3: cues(cut, extra=lambda s: f"<i>{s}</i>\n[Tür knallt]"),
        4: cues(cut.replace("owed", "0wed").replace("maps", "rnaps").replace("the", "thc")),
        5: cues(ITEM).encode().decode("latin-1"),
        6: cues(cut.replace(",", "").replace("—", "-")),
        7: cues(cut, extra=lambda s: "♪ la la ♪\n" + s),
        8: cues(part(3, 13)),
    }
    assert find(rows, docs.items()) == {(d, 1) for d in docs}


def test_no_cases(rows):
    docs = {
        1: cues(part(3, 11)),
        2: cues(part(2, 9) + " and then nobody came home again " + part(9, 16)),
        3: cues("By the eclipse the grateful cooper owed Rook 554 maps, 111 varnished seedlings and two windmills"),
        4: None,
        5: "",
        6: cues("seedlings " * 40),
    }
    assert find(rows, docs.items()) == set()


def test_ties_repeats_and_empty(rows):
    t = cues(ITEM + " " + OTHER)
    assert find(rows, [(1, t), (1, t), (2, t)]) == {(d, i) for d in (1, 2) for i in (1, 2)}
    assert find(rows, [(1, t)], []) == set()
    assert find(rows, []) == set()
    assert find(rows, [(1, t)], [(1, "too short"), (2, None), (3, ITEM), (4, ITEM)]) == {(1, 3), (1, 4)}


def test_many_items_in_one_pass(rows):
    items = [(i, " ".join(f"{w}{i}" if w.isalpha() and len(w) > 4 else w for w in ITEM.split())) for i in range(60)]
    got = find(rows, [(i, cues(items[i][1])) for i in range(0, 60, 7)], items)
    assert {(i, i) for i in range(0, 60, 7)} <= got and all(d == i for d, i in got)


LONG_TAG = '<font color="#ffffff" face="Some Very Long Face Name, Another Name" size="24">'


@pytest.mark.parametrize(
    "text",
    [
        "Well.\n(" + part(0, 10) + ")\nGood.",
        "Well.\n[" + part(0, 10) + "] Good.",
        part(0, 5) + " " + LONG_TAG + part(5, 10) + "</font>",
        part(0, 5) + " [a very long description of a sound that goes on and on, with thunder, bells, dogs and a far away train] " + part(5, 10),
        "Captions by someone: " + part(0, 10),
        part(0, 4) + "\nSubtitles by nightowl - subs.example\n" + part(4, 10),
        "♪ " + part(0, 10) + " ♪",
        part(0, 3) + " (" + part(3, 7) + " [bang] " + part(7, 8) + ") " + part(8, 10),
        "ROOK: " + part(0, 4) + "\n- " + part(4, 7) + "\nMRS ALICE MONTGOMERY-HARTWELL OF THE OLD TANNERY: " + part(7, 10),
        "( music" + "\n\n" + part(0, 10) + "\nand no bracket closes",
    ],
)
def test_passage_inside_and_around_stretches(rows, text):
    assert find(rows, [(1, text), (2, text.replace("grateful", "other words instead of"))]) == {(1, 1)}


def test_bit_table_is_a_filter():
    hs = [x * 7919 - 5 for x in range(1000)]
    t = L.bit_table(iter(hs), len(hs))
    assert L._look_up(t, L.np.array(hs, L.np.int64).view(L.np.uint64)).all()
    assert L._look_up(t, L.np.arange(10**6, 10**6 + 5000).astype(L.np.uint64)).mean() < 0.1


def test_long_text(rows):
    filler = "the cook and the captain went to the market again before noon " * 8000
    assert find(rows, [(7, filler + part(4, 18) + " " + filler)]) == {(7, 1)}


@pytest.mark.parametrize("a,b,ok", [("seedlings", "sccdlings", True), ("tailor", "tailors", True), ("oars", "tiles", False), ("zo", "zoc", True), ("a", "an", False)])
def test_near(a, b, ok):
    assert L.near(a, b) is ok
