"""Personal items in free text: found, and replaced by typed placeholders.

Anchor expansion. One pass of an Aho-Corasick automaton over the lower-case text finds the anchors: at-signs and
their written forms, digits, street words, cues of telephone, identity numbers and persons, titles. Nothing else
looks at the whole text: from each anchor a deterministic local parser expands to both sides and validates what it
reads there (a local part and a domain with a top-level name around an at-sign; the number around a digit, with
enough digits or the shape of a number that is issued to persons; a number, capitalised words and town around a
street word; words that can be a name beside a cue). Overlaps go to the item found by the stronger kind, in the
order of ``KINDS``.

Everything is a map over the rows: no shuffle, no limit on a text's length. Cues and street words are fixed
lists in English, German, French and Spanish.

Defined cases: null and empty texts hold nothing and stay as they are; several items of one text are all
found; the same text under several ids counts for each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import worker_cache

FIELDS = ("imagecomments", "studydescription", "patientname")
KINDS = ("email", "id_number", "address", "phone", "name")

# Cues (fixed values).
AT = ("@", "(at)", "[at]", " at ")
PHONE_CUES = ("phone", "telephone", "tel", "call", "ring", "mob", "mobile", "cell", "reach at", "rückruf", "fax", "handy", "téléphone", "teléfono", "telefon", "whatsapp")
ID_CUES = (
    "mrn", "hosp. no.", "hospital no.", "hospital number", "record number", "record no.", "ssn", "nin", "national id", "personnummer", "dni",
    "id card", "id-nr.", "id no.", "passport", "passport no.", "pass-nr.", "driving licence", "licence no", "license no", "ins#", "insurance no.",
    "kv-nr.", "nhs no.", "patient id", "patient no.", "policy no.", "steuer-id", "nie", "nif", "svnr",
)
NAME_CUES = (
    "referred by", "accompanied by", "consent taken by", "demandé par", "überweisung durch", "spoke to", "scan of", "pt", "patient", "daughter", "son",
    "wife", "husband", "mother", "father", "brother", "sister", "seen by", "reported by", "requested by", "signed by", "taken by", "enviado por", "envoyé par",
)
#: Words of persons and contacts that stand before anything; what follows must look like a full name.
ROLE_CUES = (
    "discussed with", "spoke with", "talked to", "called by", "next of kin", "emergency contact", "contact", "carer", "caregiver", "guardian", "partner", "spouse",
    "neighbour", "neighbor", "friend", "uncle", "aunt", "grandmother", "grandfather", "interpreter", "gp", "family doctor", "hausarzt", "hausärztin", "betreuer", "betreuerin",
    "angehöriger", "angehörige", "ehemann", "ehefrau", "llamar a", "avisar a", "contacto", "acompañado por", "acompañada por", "médico", "médecin", "prévenir", "appeler", "accompagné par",
    "accompagnée par", "mari", "épouse",
)
NAME_ENDS = ("felt unwell", "waits outside", "anxious", "after scan", "aborted")
TITLES = ("dr", "mr", "mrs", "ms", "miss", "prof", "herr", "frau", "mme", "mlle", "sr", "sra", "señor", "señora", "monsieur", "madame")
PSEUDONYM = r"(?i)anonym\w*|anon\W.*|unknown|phantom.*|test.*|none|n/?a|null|nan|-+|\?+|x+|[^^,]*\d.*"

DOT = r"(?:\.|\s?[\[(]dot[\])]\s?|\s+dot\s+)"
EMAIL = re.compile(
    rf"(?i)(?<![\w.+-])([a-z0-9][\w.%+-]*)(?:\s?@\s?|\s?\(at\)\s?|\s?\[at\]\s?|\s+at\s+)([a-z0-9-]+(?:{DOT}[a-z0-9-]+)*{DOT}[a-z]{{2,}})(?![\w@-])"
)
NUMBER_RUN = re.compile(r"\+?(?:\(\d+\)|\d+)(?:[ ./-]?(?:\(\d+\)|\d+))*(?:\s?(?:ext|Durchwahl|x)\.?\s?\d+\b)?")
PHONE_ALONE = re.compile(r"\+\d|\(\d{3}\) \d{3}-\d{4}\b|\d{3}\.\d{3}\.\d{4}\b|0\d{2,4}/\d{5,}|00\d{2}[- ]\d{2,}[- ]\d{4,}|0\d{2} \d{4} \d{4}\b|0\d{4} \d{6}\b")
ID_SHAPES = (
    r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]", r"\d{3}-\d{2}-\d{4}", r"\d{6}-\d{4}", r"\d{8}-[A-Z]", r"[^\W\d_]{5}\d{6}[A-Z]\d[A-Z]{2}", r"[A-Z]{2}\d{7}", r"[A-Z]\d{9}",
)
ID_ALONE = re.compile(r"(?<![\w.+/-])(?:" + "|".join(ID_SHAPES) + r")(?![\w-])(?!\.\d)")
ID_CUED = re.compile(r"(?:no\.?|nr\.?|number)?[\s:#]*((?:" + "|".join(ID_SHAPES) + r"|[A-Z]{0,3}\d[\dA-Z-]{4,}))(?![\w])", re.I)
WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
TAIL = r"[^\W\d_]*(?:['’-][^\W\d_]+)*"
STREET_WORDS = r"(?:street|st\.|st\b|road|rd\b\.?|avenue|ave\b\.?|lane|hill|close|terrace|drive|court|place|square|crescent|gardens|boulevard|row|mews|way|parade|grove|esplanade|quay|wharf)"
#: Anchors of addresses: the words above, and those of French, Spanish and German streets.
STREET_CUES = (
    "street", "st", "road", "rd", "avenue", "ave", "lane", "hill", "close", "terrace", "drive", "court", "place", "square", "crescent", "gardens", "boulevard", "row", "mews", "way",
    "parade", "grove", "esplanade", "quay", "wharf", "rue", "allée", "chemin", "calle", "avenida", "plaza", "paseo", "straße", "strasse", "str.", "weg", "platz", "gasse", "allee",
)
ADDRESS = re.compile(
    rf"(?<![\w.])(?:(?:(?:Flat|Apt|Unit|Suite)\.? \d+[a-z]?, )?\d+[a-z]? (?:[A-ZÀ-Ý]{TAIL} ){{1,3}}(?i:{STREET_WORDS})(?!\w)"
    rf"|\d+[a-z]?,? (?i:rue|avenue|boulevard|place|allée|chemin)(?: (?i:de|du|des|la|le))* {WORD}"
    rf"|(?i:calle|avenida|plaza|paseo)(?: (?i:de|del|la))* {WORD},? \d+[a-z]?"
    rf"|{WORD}(?i:straße|strasse|str\.|weg|platz|gasse|allee) ?\d+[a-z]?)"
    rf"(?P<rest>(?:,? (?:Apt|Flat|Unit|Suite)\.? \d+[a-z]?)?(?:, (?:\d{{4,5}} )?[A-ZÀ-Ý][^\W\d_]+(?: \d{{4,5}})?(?=\.?\s*$|\.?\s*\n|\.\s|[;,]| [/-] | \())?)"
)
FLAT_BEFORE = re.compile(r"(?:Flat|Apt|Unit|Suite)\.? \d+[a-z]?, $")
BEFORE_NUMBER = re.compile(r"[\s.:]*(?:no\.?|nr\.?|al|sous|unter|at|on)?[\s.:]*")
#: A grouped number behind a word by which someone is reached.
REACHED_AT = re.compile(r"\b(?:al|at|on|unter|sous|au)\s$")
GROUPED = re.compile(r"\d{2,5}(?: \d{2,4}){2,4}")
TITLE = r"(?:(?:" + "|".join(TITLES) + r")\b\.?\s+)"
#: What may follow "Surname, Given", so that the comma is no end of the name.
CLOSED = r"(?=\.?\s*$|\.?\s*\n|\.\s|[;,]| [/-] | felt\b| waits\b| anxious\b| after\b| aborted\b)"
NAME_FORMS = rf"(?:{WORD}, {WORD}{CLOSED}|(?:[^\W\d_]\. ?)+{WORD}|{WORD} [^\W\d_]\. {WORD}|{WORD} {WORD}|{WORD})(?![\w@])"
AFTER_CUE = re.compile(rf"[\s:]+(?i:{TITLE})*({NAME_FORMS})")
AFTER_TITLE = re.compile(rf"\.?\s+(?i:{TITLE})*((?:[^\W\d_]\. ?)+{WORD}|{WORD} [^\W\d_]\. {WORD}|{WORD} {WORD}|{WORD})")
BEFORE_END = re.compile(rf"(?:^|(?<=\n)|(?<=[;:,./-] )|(?<=[;:,/]))\s*(?i:{TITLE})*({NAME_FORMS})\s*$")
PROPER = r"(?:[A-ZÀ-Ý][^\W\d_]+(?:['’-][^\W\d_]+)*)"
ROLE_NAME = re.compile(rf"[\s:]+(?i:{TITLE})*({PROPER}(?: (?:[A-ZÀ-Ý]\.|(?:de|van|von|der|la|del|di|da))){{0,2}}(?: {PROPER}){{1,2}})(?![\w@])")
ROLE_LOWER = re.compile(rf"\s*:\s*([^\W\d_]{{2,}} [^\W\d_]{{2,}})(?=\s*(?:$|\n|[.,;(]))")
NOT_NAMES = frozenset(
    "the a an of in on at to by for with after before and or scan outside room ward series run first last radiology doctor nurse staff mother father family parents technician "
    "anxious aborted unwell felt waits".split()
)


def lowered(text: str) -> str:
    """Lower case, character for character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def anchors():
    """The automaton over all cues, made once per worker: end position to (class, cue)."""

    def build():
        import ahocorasick

        a = ahocorasick.Automaton()
        groups = (
            ("email", AT), ("digit", tuple("0123456789")), ("street", STREET_CUES), ("phone", PHONE_CUES), ("id_number", ID_CUES), ("name", NAME_CUES),
            ("role", ROLE_CUES), ("end", NAME_ENDS), ("title", TITLES),
        )
        for kind, cues in groups:
            for cue in cues:
                known = a.get(cue, ())
                a.add_word(cue, (*known, (kind, cue)))
        a.make_automaton()
        return a

    return worker_cache("pii-anchors", build)


def _cut_name(words: str) -> str:
    """A name without words that end it."""
    low = lowered(words)
    for end in NAME_ENDS:
        k = low.find(" " + end.split()[0])
        if k > 0:
            words, low = words[:k], low[:k]
    parts = words.split()
    while len(parts) > 1 and parts[-1].lower() in NOT_NAMES:
        parts.pop()
    return words[: words.find(parts[-1]) + len(parts[-1])] if parts else words


def _is_name(name: str, cued: bool) -> bool:
    parts = re.findall(WORD, name)
    if not parts or (len(parts[0]) > 1 and parts[0].lower() in NOT_NAMES) or max(map(len, parts)) < 2:
        return False
    # Typed in lower case throughout it takes two words and a cue.
    return name[0].isupper() or (cued and len(parts) >= 2)


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def _digit_starts(text: str, at: list[int]) -> list[int]:
    """Where the groups of digits at the anchors begin."""
    return [i for i in at if i == 0 or not text[i - 1].isdigit()]


def _word_start(text: str, i: int) -> int:
    while i > 0 and (text[i - 1].isalnum() or text[i - 1] in "_'’-"):
        i -= 1
    return i


def _emails(text: str, at: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Around each at-sign [a, b): the local part before it, the domain behind it."""
    out = []
    for a, b in at:
        i = a
        if i > 0 and text[i - 1].isspace():
            i -= 1
        while i > 0 and (text[i - 1].isalnum() or text[i - 1] in "_.%+-"):
            i -= 1
        while i < a:
            m = EMAIL.match(text, i)
            if m and m.end(1) <= a < m.start(2):
                out.append(("email", i, m.end()))
                break
            # A local part begins at the edge of its characters, or behind a percent sign.
            i = text.find("%", i, a) + 1 or a
    return out


def _addresses(text: str, at: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Around each street word [a, b): from the house number, or the word itself, to the town."""
    out = []
    for a, b in at:
        starts = {a, _word_start(text, a)}
        i = a
        # Back over up to three words and a house number, and a flat before it.
        for _ in range(5):
            if i > 0 and text[i - 1] == " ":
                i -= 1
                j = i - 1 if i > 0 and text[i - 1] == "," else i
                k = _word_start(text, j)
                if k == j:
                    break
                if text[k].isdigit():
                    starts.add(k)
                    flat = FLAT_BEFORE.search(text, max(0, text.rfind("\n", 0, k)), k)
                    if flat:
                        starts.add(flat.start())
                    break
                i = k
            else:
                break
        for k in sorted(starts):
            m = ADDRESS.match(text, k)
            if m and m.start() <= a < m.end():
                out.append(("address", m.start(), m.end()))
                break
    return out


def _numbers(text: str, digits: list[int], cues: list[tuple[int, str, str]]) -> list[tuple[str, int, int]]:
    out = []
    tried: set[int] = set()
    done = 0
    for i in digits:
        # Numbers issued to persons: the word around the digits, or two letters and a space before it.
        k = _word_start(text, i)
        for start in (k - 3, k):
            if start in tried or start < 0 or (start < k and not (text[k - 1] == " " and text[start : start + 2].isalpha())):
                continue
            tried.add(start)
            m = ID_ALONE.match(text, start)
            if m:
                out.append(("id_number", m.start(), m.end()))
                break
        # Telephone numbers: the run of digit groups, from its sign or bracket.
        if i < done:
            continue
        start = i - 1 if i and text[i - 1] in "+(" else i
        if start == i - 1 and text[start] == "(" and start and text[start - 1] == "+":
            start -= 1
        m = NUMBER_RUN.match(text, start) or NUMBER_RUN.match(text, i)
        if not m:
            continue
        done = m.end()
        if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in ".-/"):
            continue
        called = REACHED_AT.search(text, max(0, m.start() - 8), m.start()) and GROUPED.fullmatch(m[0])
        if (called or PHONE_ALONE.match(m[0])) and 7 <= _digits(m[0]) <= 18:
            out.append(("phone", m.start() + (m[0][0] == "("), m.end()))
    for end, kind, _ in cues:
        if kind == "id_number":
            m = ID_CUED.match(text, end)
            if m and _digits(m[1]) >= 5:
                out.append(("id_number", m.start(1), m.end(1)))
        elif kind == "phone":
            m = BEFORE_NUMBER.match(text, end)
            n = NUMBER_RUN.match(text, m.end())
            if n and 6 <= _digits(n[0]) <= 18:
                k = n.start() + (n[0][0] == "(")
                out.append(("phone", k, n.end()))
    return out


def _after_role(text: str, end: int) -> tuple[int, int] | None:
    """A full name behind a role: two or three capitalised words, or, behind a colon, two words that close the phrase."""
    m = ROLE_NAME.match(text, end)
    if m:
        words = m[1].split()
        while len(words) > 2 and words[-1].lower() in NOT_NAMES:
            words.pop()
        if len(words) >= 2 and not any(w.lower() in NOT_NAMES or w.isupper() and len(w) > 1 for w in words):
            return m.start(1), m.start(1) + len(" ".join(words))
    m = ROLE_LOWER.match(text, end)
    if m and not any(w in NOT_NAMES for w in m[1].lower().split()):
        return m.span(1)
    return None


def _names(text: str, cues: list[tuple[int, str, str]]) -> list[tuple[str, int, int]]:
    out = []
    for end, kind, cue in cues:
        if kind == "role":
            span = _after_role(text, end)
            if span:
                out.append(("name", *span))
            continue
        if kind == "name":
            m = AFTER_CUE.match(text, end)
        elif kind == "title":
            m = AFTER_TITLE.match(text, end)
        elif kind == "end" and cue == "felt unwell":
            # Back to the last mark that a name cannot hold.
            stop = end - len(cue)
            start = max(text.rfind(c, 0, stop) for c in "\n;:/") + 1
            m = BEFORE_END.search(text[start:stop])
            if m and _is_name(m[1], True):
                out.append(("name", start + m.start(1), start + m.end(1)))
            continue
        else:
            continue
        if m:
            name = _cut_name(m[1])
            if kind == "title" and name[:1].isupper() and "," not in name:
                # Behind a title a word in lower case goes on with the sentence.
                while " " in name and name.rsplit(" ", 1)[1].islower():
                    name = name.rsplit(" ", 1)[0]
            if "," in name:
                # Surname, Given: only if both look like it; else the comma ends the name.
                a, b = name.split(",", 1)
                if not (a[:1].isupper() and b.strip()[:1].isupper() and " " not in a):
                    name = a
            if _is_name(name, True):
                out.append(("name", m.start(1), m.start(1) + len(name)))
    return out


def anchored(text: str) -> dict[str, list]:
    """Anchors of a text by class: email and street as spans, digit as places, cue as (end, class, cue)."""
    low = lowered(text)
    found: dict[str, list] = {"email": [], "street": [], "digit": [], "cue": []}
    for end, hits in anchors().iter(low):
        for kind, cue in hits:
            begin = end - len(cue) + 1
            if kind == "digit":
                found["digit"].append(end)
            elif kind == "email":
                # Of a written form the letters count.
                found["email"].append((begin + (cue[0] == " "), end + 1 - (cue[-1] == " ")))
            elif kind == "street":
                found["street"].append((begin, end + 1))
            elif kind == "title" and text[begin].islower():
                continue
            elif (begin == 0 or not low[begin - 1].isalnum()) and (not cue[-1].isalnum() or end + 1 == len(low) or not low[end + 1].isalpha()):
                found["cue"].append((end + 1, kind, cue))
    return found


def free_text_items(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the personal items of a text, 0-based, not overlapping, in order."""
    at = anchored(text)
    found = _emails(text, at["email"]) + _addresses(text, at["street"])
    found += _numbers(text, _digit_starts(text, at["digit"]), at["cue"])
    found += _names(text, at["cue"])
    found.sort(key=lambda x: (KINDS.index(x[0]), x[1], -x[2]))
    kept: list[tuple[str, int, int]] = []
    for x in found:
        if all(x[2] <= k[1] or x[1] >= k[2] for k in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: x[1])


def person_items(text: str) -> list[tuple[str, int, int]]:
    """Items of a field that holds the name of a person, maybe with a contact beside it."""
    contact = [x for x in free_text_items(text) if x[0] != "name"]
    if not contact:
        done = 0
        for i in _digit_starts(text, anchored(text)["digit"]):
            m = NUMBER_RUN.match(text, i - 1) if i and text[i - 1] in "+(" else None
            m = m or NUMBER_RUN.match(text, i)
            if i < done:
                continue
            done = m.end()
            if _digits(m[0]) >= 7 and re.search(r"[^\W\d_]{2}", text[: m.start()]) and text[m.start() - 1] in " (":
                contact.append(("phone", m.start() + (m[0][0] == "("), m.end()))
    name = text[: contact[0][1]] if contact else text
    name = re.sub(r"(?i)[\s(+:,;]*(?:\b(?:tel|phone|mob|mail|email|e-mail)\b[.:]?)?[\s(+]*$", "", name)
    lead = re.match(rf"(?i)[\W_]*{TITLE}*[\W_]*", name).end()
    body = name[lead:].rstrip(" .^")
    if not re.search(r"[^\W\d_]{2}", body) or re.fullmatch(PSEUDONYM, body.strip()):
        return contact
    body = re.sub(rf"(?i)\^+(?:{'|'.join(TITLES)})\.?$", "", body)
    return [("name", lead, lead + len(body)), *contact]


def items(text: str | None, field: str) -> list[tuple[str, int, int]]:
    if not text:
        return []
    return person_items(text) if field == "patientname" else free_text_items(text)


def masked(text: str | None, field: str) -> str | None:
    """The text with every item replaced by a placeholder of its type, the rest unchanged."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b in items(text, field):
        if a > at and text[a - 1] == "(" and ")" in text[a:b]:
            a -= 1
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def personal_items(headers: DataFrame) -> DataFrame:
    """(header_id, field, kind, start_pos) of every item, start_pos 1-based."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (h, f, k, s + 1)
                for i, f in enumerate(FIELDS, 1)
                for h, t in zip(b.column(0).to_pylist(), b.column(i).to_pylist())
                for k, s, _ in items(t, f)
            ]
            cols = list(zip(*rows)) or [(), (), (), ()]
            types = [pa.int64(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["header_id", "field", "kind", "start_pos"])

    df = headers.where("header_id is not null").select(F.col("header_id").cast("long").alias("header_id"), *FIELDS)
    return df.mapInArrow(work, "header_id long, field string, kind string, start_pos int").distinct()


def masked_texts(headers: DataFrame) -> DataFrame:
    """header_id and the three texts with placeholders."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [pa.array([masked(t, f) for t in b.column(i).to_pylist()], pa.string()) for i, f in enumerate(FIELDS, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["header_id", *FIELDS])

    return headers.select(F.col("header_id").cast("long").alias("header_id"), *FIELDS).mapInArrow(work, "header_id long, " + ", ".join(f"{f} string" for f in FIELDS))
