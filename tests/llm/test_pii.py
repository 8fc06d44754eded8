import pytest

from voxlake.llm import pii as P


def kinds(text, field="imagecomments"):
    return [(k, text[a:b]) for k, a, b in P.items(text, field)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("results -> r-j (at) post.test - CC d_v@ward7.example.", [("email", "r-j (at) post.test"), ("email", "d_v@ward7.example")]),
        ("send to m@mail [dot] example [dot] com now", [("email", "m@mail [dot] example [dot] com")]),
        ("T1@3T, T2 skipped, echo@24ms ok", []),
        ("tel +49 30 23125 632. repeat of series 4", [("phone", "+49 30 23125 632")]),
        ("ring (312) 555-0172", [("phone", "312) 555-0172")]),
        ("reach at +1 202 5550154 ext. 91.", [("phone", "+1 202 5550154 ext. 91")]),
        ("reach at 415.555.0112", [("phone", "415.555.0112")]),
        ("order no. 8282/42 (service), coil SN 75037-02 swapped, UID 1.2.999.0797.52628.251, ticket 492-6048 closed, batch 0012-345", []),
        ("SSN 959-36-1833 checked; 341875-2888", [("id_number", "959-36-1833"), ("id_number", "341875-2888")]),
        ("licence no FUZÉK228858X9QQ", [("id_number", "FUZÉK228858X9QQ")]),
        ("hosp. no. 00590489 checked", [("id_number", "00590489")]),
        ("NIN QQ 87 31 55 D", [("id_number", "QQ 87 31 55 D")]),
        ("lives at 139 PURUGAMON AVENUE\nPass-Nr. XW7501200 (to confirm).", [("address", "139 PURUGAMON AVENUE"), ("id_number", "XW7501200")]),
        ("home: Flat 14, 18 Rezakiza Close, Zaziroholm", [("address", "Flat 14, 18 Rezakiza Close, Zaziroholm")]),
        ("send CD to 87, rue Felajatu, 00763 Juhavuford.", [("address", "87, rue Felajatu, 00763 Juhavuford")]),
        ("wohnhaft Livevevastr. 19 - eyes closed", [("address", "Livevevastr. 19")]),
        ("daughter Mr Vebédara waits outside", [("name", "Vebédara")]),
        ("consent taken by A. Vebédara", [("name", "A. Vebédara")]),
        ("Überweisung durch Topevuku, Zachary", [("name", "Topevuku, Zachary")]),
        ("referred by ekaterina bomufahas / eyes open", [("name", "ekaterina bomufahas")]),
        ("eyes closed, Nejozate, Margaret felt unwell", [("name", "Nejozate, Margaret")]),
        ("TE 35 ms. Überweisung durch CHARLES HEBIMUMUR.", [("name", "CHARLES HEBIMUMUR")]),
        ("Fourier window on, Hanning off. prior CD from Golugeville University Hospital, Ward 7 West informed", []),
    ],
)
def test_free_text(text, want):
    assert kinds(text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("Fujutomer^Friedrich", [("name", "Fujutomer^Friedrich")]),
        ("Dr. Henrietta Pujubamu", [("name", "Henrietta Pujubamu")]),
        (" Rulitafur, Philippa^^Dr", [("name", "Rulitafur, Philippa")]),
        ("Filevilu William (020 7946 0848", [("name", "Filevilu William"), ("phone", "020 7946 0848")]),
        ("Gosihoke^William (555 0172", [("name", "Gosihoke^William"), ("phone", "555 0172")]),
        ("D. Menajebi tel d-p(at)imaging.invalid", [("name", "D. Menajebi"), ("email", "d-p(at)imaging.invalid")]),
        ("anonymous", []),
        ("ANON^340", []),
        ("VP000253", []),
        ("pilot 417", []),
        ("sub-0002959", []),
        ("", []),
    ],
)
def test_person_field(text, want):
    assert kinds(text, "patientname") == want


def test_masked():
    t = "ring (312) 555-0172; pt Ada Byron anxious"
    assert P.masked(t, "imagecomments") == "ring [PHONE]; pt [NAME] anxious"
    assert P.masked(None, "imagecomments") is None and P.masked("", "patientname") == ""
    assert P.masked("eyes closed " * 20000, "imagecomments") == "eyes closed " * 20000


def test_frames(rows):
    schema = "header_id long, imagecomments string, studydescription string, patientname string, kind string"
    d = rows([(1, None, "", "A^Byron", "x"), (2, "tel 415.555.0112", None, None, "x"), (2, "tel 415.555.0112", None, None, "x"), (None, "tel 415.555.0112", None, None, "x")], schema)
    assert {tuple(r) for r in P.personal_items(d).collect()} == {(1, "patientname", "name", 1), (2, "imagecomments", "phone", 5)}
    assert P.personal_items(d).count() == 2 and P.masked_texts(d).count() == 4
    assert P.personal_items(d.where("false")).count() == 0


#: Sentences written without the templates of the tables, with what they hold.
UNSEEN = [
    ("Discussed with John Miller before the scan", {("name", "John Miller")}),
    ("Next of kin Jane Doe informed", {("name", "Jane Doe")}),
    ("Contact: Anna Bell, 12 Elm Way, Leeds", {("name", "Anna Bell"), ("address", "12 Elm Way, Leeds")}),
    ("Lives at 45 Kings Parade", {("address", "45 Kings Parade")}),
    ("Llamar a Maria Lopez al 612 345 678", {("name", "Maria Lopez"), ("phone", "612 345 678")}),
    ("carer: tom hardy", {("name", "tom hardy")}),
    ("Hausarzt Peter Schmidt hat angerufen", {("name", "Peter Schmidt")}),
    ("results to r.jones+mri@clinic.example.org please", {("email", "r.jones+mri@clinic.example.org")}),
    ("see mailto:ward7@hospital.example.net for the form", {("email", "ward7@hospital.example.net")}),
    ("write to ann (at) lab dot example dot com", {("email", "ann (at) lab dot example dot com")}),
    ("moved last year, now Flat 3, 18 Orchard Grove, York", {("address", "Flat 3, 18 Orchard Grove, York")}),
    ("wohnt jetzt Lindenstraße 14", {("address", "Lindenstraße 14")}),
    ("domicilié 7 rue Pasteur", {("address", "7 rue Pasteur")}),
    ("vive en calle Mayor 22", {("address", "calle Mayor 22")}),
    ("her mobile is +44 7700 900123 after six", {("phone", "+44 7700 900123")}),
    ("tel. 020 7946 0958 (evenings)", {("phone", "020 7946 0958")}),
    ("insurance no. AB1234567 on file", {("id_number", "AB1234567")}),
    ("MRN 00451278, allergies none", {("id_number", "00451278")}),
    ("SSN 078-05-1120 given at desk", {("id_number", "078-05-1120")}),
    ("Dr. Okafor asked for a second series", {("name", "Okafor")}),
    ("spoke with Mrs Ingrid Larsen about claustrophobia", {("name", "Ingrid Larsen")}),
    ("interpreter: Yusuf Demir", {("name", "Yusuf Demir")}),
    ("son Pavel Novak picked up the films", {("name", "Pavel Novak")}),
    ("the porter Mike Dunn knows the way", {("name", "Mike Dunn")}),
]


def test_recall_on_unseen_sentences():
    want = hit = extra = 0
    for text, items in UNSEEN:
        got = {(k, text[a:b]) for k, a, b in P.free_text_items(text)}
        want, hit, extra = want + len(items), hit + len(items & got), extra + len(got - items)
    assert hit / want >= 0.9 and extra / want <= 0.1, (hit, extra, want)


def test_without_anchors_nothing_is_found(monkeypatch):
    import ahocorasick

    none = ahocorasick.Automaton()
    none.add_word("\x00never", (("cue", "never"),))
    none.make_automaton()
    monkeypatch.setattr(P, "anchors", lambda: none)
    assert not any(P.free_text_items(t) for t, _ in UNSEEN)


@pytest.mark.parametrize(
    "text",
    ["Contact Radiology before noon", "carer present", "partner waits in room 12", "gp letter attached", "2 series on 3 T Skyra", "slab at 45 degrees, 612 slices", "Next of kin informed", "scan at 12 30 45",
     "FOV 220 220 180 mm", "no way 12 can be repeated", "friend drives home"],
)
def test_ordinary_sentences(text):
    assert P.free_text_items(text) == []


def test_whole_text_is_read():
    filler = "run 12 of the series was repeated at 3 T because of motion. " * 4000
    text = filler + "Contact: Anna Bell, 12 Elm Way, Leeds. " + filler
    assert [(k, text[a:b]) for k, a, b in P.free_text_items(text)] == [("name", "Anna Bell"), ("address", "12 Elm Way, Leeds")]
