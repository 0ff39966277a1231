"""Personal information in free text: found by kind and replaced by placeholders.

Every place that may be personal is a candidate, and the co-occurrence of its terms
with protected places over the whole corpus tells how strongly they reveal one: the
disclosure of a term is its pointwise mutual information with them, in bits.

* **Numbers, mail and postal addresses.**  Their terms are their own shape (digits
  and letters folded) and the words before them in the line.  Candidates whose own
  form, or a cue beside them, gives them away are the protected places; numbers that
  only look alike are candidates too.  The former are found if some term discloses
  their kind, the latter if a word before them discloses it strongly, so that cues
  are learned from the corpus and need not be listed.
* **Names of people** have no form.  Every pair of capitalised words is a candidate,
  and some stand where a person is named (an author field, a signature, "my
  colleague ...").  A candidate is a name if all its terms disclose more than a
  threshold, wherever it stands; products, releases and teams are written like
  names, but not where people are.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.physical import materialize, sized_broadcast, spread

KINDS = ("email", "phone", "id_number", "address", "name")
BROADCAST_TERMS = 500_000
#: A cue stands within so many characters before an identity number; a person place
#: is told by so many before and after a name.
CUE_CHARS, BEFORE_CHARS, AFTER_CHARS = 45, 40, 24
#: So many words before a number or address, in its line, are its terms.
CONTEXT_WORDS = 4

_AT = r"(?:@|&#0*64;|&commat;|%40| ?[\[({<]\s?(?:at|AT|@)\s?[\])}>] ?)"
_DOT = r"(?:\.| ?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>] ?)"
_EMAIL = re.compile(
    rf"(?:(?<![\w.+/:@-])|(?<=mailto:))(?P<l>\w[\w+'-]*(?:{_DOT}[\w+'-]+)*){_AT}(?P<d>[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[^\W\d_]{{2,}})(?![\w-]*[@:]|/\w)"
    rf"|(?<![\w.+/:@-])(?P<m>\w[\w+'-]*(?:(?:\.| dot | DOT )[\w+'-]+)*) (?:at|AT) (?P<e>[\w-]+(?:(?: dot | DOT )[\w-]+)*(?: dot | DOT )[^\W\d_]{{2,}})(?![\w+-]| at [\w-]+ dot | AT [\w-]+ DOT )"
)
_EMAIL_SIGN = re.compile(r"@|&#0*64;|&commat;|%40|[\[({<]\s?(?:at|AT)\s?[\])}>]| (?:at (?=[\w-]+ dot )|AT (?=[\w-]+ DOT ))")
#: Mailboxes that belong to programs and hosts, not to people.
_NO_PERSON = re.compile(r"^(?:git|root|no-?reply|do-?not-?reply|noreply.*|postmaster|mailer-daemon|hostmaster|ubuntu|ec2-user|www-data|daemon|nobody|.*[-_.]?bot|svc[-_.].*|runner[-_.].*|ci[-_.].*)$", re.I)
_NO_HOST = re.compile(r"serviceaccount|\biam\b|gserviceaccount|svc\.|cluster\.local|\.local$|\.internal$|\.(?:git|ya?ml|json|py|go|js|md|txt|png|sh|com:\w+)$", re.I)

_EXT = r"(?:,? ?(?:ext\.?|x|#|extension) ?\d{1,6})?"
_PHONE = re.compile(
    rf"(?<![\w+./=-])(?:\+\d[\d ()./-]{{6,20}}\d|\(0?\d{{2,4}}\) ?\d{{3,4}}[ .-]?\d{{3,5}}|(?:1[ .-])?\d{{3}}([.-])\d{{3}}\1\d{{4}}|0\d{{3,4}}[ /-]\d{{3,4}}[ -]?\d{{3,4}}|0\d(?:[ .]\d\d){{4}}|0\d{{9,10}}){_EXT}(?![\w/]|[.:-]\d)"
)
#: Numbers in groups parted by blanks; only their words tell whether they are telephone numbers.
_GROUPED = re.compile(r"(?<![\w.+/=:-])\d{2,4}(?: \d{2,4}){2,4}(?![\w/]|[.:-]\d)")

_SSN = re.compile(r"(?<![\w.-])\d{3}([ -])\d{2}\1\d{4}(?![\w-]|[.:]\d)")
_NINO = re.compile(r"(?<![\w-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w-])")
_DOCUMENT = re.compile(r"(?<![\w./-])(?:[A-Z]{1,2}\d{6,9}[A-Z]?|\d{7,9}[A-Z]|\d{2}[ .]?\d{3}[ .]?\d{3}-?[A-Z]?|C[A-Z0-9]{8})(?![\w/-]|[.:]\d)")
#: Words before an identity number, in several languages.
_CUE_ID = re.compile(
    r"\b(?:ssn|social security|insurance|nino|ni n(?:umber|o)|passport|reisepass|personalausweis|ausweis|passeport|pasaporte|passaporte|dni|nie|nif|identity|identit\w+|id[ -]?card|id n(?:umber|o)|national id|carte d'identit\w+|"
    r"documento|cédula|cpf|steuer-?id|tax id|sozialversicherung\w*|паспорт\w*|身份证|护照|パスポート)\b",
    re.I,
)

_CAP = r"(?:(?:d'|l'|O')?[A-ZÀ-ÖØ-ÞŁŚŻČĎŘŠŽĀĒĪŌŪ][\w'’-]*\.?)"
_WORDS = rf"{_CAP}(?: (?:de la|de los|de|du|des|del|der|den|of|the|an|am) {_CAP}| {_CAP})"
_TYPE = (
    r"(?:[Ss]treet|STREET|St\b\.?|ST\b\.?|[Aa]venue|AVENUE|Ave\b\.?|AVE\b\.?|[Rr]oad|ROAD|Rd\b\.?|[Bb]oulevard|BOULEVARD|Blvd\b\.?|BLVD\b\.?|Lane|LANE|Ln\b\.?|Drive|DRIVE|Dr\b\.?|Court|COURT|Ct\b\.?|Close|CLOSE|"
    r"Way|WAY|Place|Pl\b\.?|Terrace|TERRACE|Square|Sq\b\.?|Crescent|Row|Walk|Gardens|Mews|Parkway|Pkwy\b\.?|Highway|Hwy\b\.?|Quay|Hill)"
)
_UNIT = r"(?:[, \r\n]{1,3}(?:Apt|Apartment|Flat|Suite|Ste|Unit|Floor|Room|APT|FLAT|SUITE)\b\.? ?#?\w+)?"
_TOWN = rf"(?:(?:,|,? ?\r?\n) ?(?:\d{{4,5}} )?{_CAP}(?: {_CAP})?(?:,? (?:[A-Z]{{2}} )?\d{{4,5}})?)?"
_ADDRESS = re.compile(
    rf"(?<![\w.#-])(?:\d{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,4}}{_TYPE}(?![\w-]){_UNIT}{_TOWN}"
    rf"|\d{{1,4}}(?: (?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|quai|allée|impasse|cours|route|Rue|Avenue|Boulevard|Place|Chemin|Quai|Allée|RUE) (?:(?:de la|de l'|de|du|des|d'|l'|la|le|les) ?)*{_CAP}(?:[ -](?:(?:de|du|des|la|le|et) )?{_CAP}){{0,3}}{_TOWN}"
    rf"|(?:[A-ZÄÖÜ][\wäöüß-]*?(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring|graben|markt|chaussee|steig|pfad|STRASSE|WEG|GASSE)|(?:Am|An der|An den|Im|In der|Zum|Zur|Auf dem|Auf der|Unter den|Hinter der) (?:{_CAP} ?){{1,3}}) ?\d{{1,4}} ?[a-z]?(?![\w.%-]){_TOWN}"
    rf"|(?:Calle|C/|Avenida|Avda\.|Plaza|Paseo|Camino|Carrera|Rua|Praça|Via|Viale|Piazza|Corso|CALLE) (?:(?:de la|de los|del|de|la|el|da|do|dos|das|della|di) )?{_CAP}(?: (?:(?:de|del|la) )?{_CAP}){{0,3}},? (?:n[º°.] ?)?\d{{1,4}}(?:(?:, ?|,? ?\r?\n)\d{{1,2}}[ºª°]? ?[A-Za-zºª]{{0,4}}\b)?{_TOWN}"
    rf"|(?:P\.? ?O\.? ?[Bb]ox|P\.? ?O\.? BOX|[Pp]ost [Bb]ox|Postfach|Apartado(?: de [Cc]orreos)?|Bo[iî]te [Pp]ostale|Caixa [Pp]ostal|Casella [Pp]ostale|Postbus) ?\d[\d ]{{0,6}}{_TOWN})",
)
_PARTICLE = r"(?:(?:van|von|de|den|der|di|da|dos|la|le|ter|ten|bin|ibn|af|zu)(?: (?:de|der|den|la))? )?(?:(?:al|el|Al|El)-)?"
#: The capital letters of all scripts.
_UP = "".join(map(chr, (c for c in range(0x10000) if unicodedata.category(chr(c)) in ("Lu", "Lt"))))
_WORD = rf"[{_UP}][^\W\d_]*(?:['’][^\W\d_]+)*(?:-[^\W\d_]+(?:['’][^\W\d_]+)*)*"
_RUN = re.compile(rf"(?<![\w@./-])(?:[{_UP}]\.|{_WORD})(?:,? (?:[{_UP}]\.(?= )|{_PARTICLE}{_WORD}))+(?![\w@])")
_PIECE = re.compile(rf"(?P<p>{_PARTICLE})(?P<w>[{_UP}]\.|{_WORD})(?P<c>,?)")
_TITLE = r"(?:Dr|Mr|Ms|Mrs|Mx|Prof|Herr|Frau|Sir|Dame|Señora?|Sra?|Mme|Mlle|Monsieur|Madame|DR|MR|MS|MRS|PROF)"
_IS_TITLE = re.compile(rf"^{_TITLE}\.?$")
_TITLED = re.compile(rf"(?<![\w.])(?:{_TITLE}\.? )+(?P<w>{_PARTICLE}{_WORD}(?: {_PARTICLE}{_WORD})?)")
_SIGNED = re.compile(r"(?:^|(?<=[\s\x00]))(?:(?:best|kind|warm) regards|regards|best|cheers|thanks|greetings|sincerely),[ \t]*(?:\r?\n)?[ \t>]*(?P<a>[^\W\d_]+(?:-[^\W\d_]+)*) (?P<b>(?:(?:van|von|de|den|der|al)[ -])?[^\W\d_]+(?:-[^\W\d_]+)*)", re.I | re.M)

#: Of a text with a title one is there, of one with a signature one in lower case.
_TITLES = ("Dr", "Mr", "Ms", "Mx", "Prof", "Herr", "Frau", "Sir", "Dame", "Señor", "Sr", "Mme", "Mlle", "Monsieur", "Madame", "DR", "MR", "MS", "PROF")
_SIGNS_OFF = ("regards,", "best,", "cheers,", "thanks,", "greetings,", "sincerely,")

#: What stands before and after people in technical threads.
_BEFORE = re.compile(
    rf"(?:\b(?:I am|I'm|my name is|this is|colleague|colleagues|manager|cc:?|loop in|ping|ask|contact|thanks to|credit to|dear|hi|hello|hey)"
    rf"|\b(?:name|author|owner|maintainer|assignee|reporter|contact|reviewer|approver|user|full[ _]?name|reported[ -]by|signed-off-by|reviewed-by|approved by|written by|filed by|raised by|found by|suggested by|assigned to|co-authored-by)\W{{0,5}}"
    rf"|(?:^|\n)[ \t>]*--[ \t]*\r?\n[ \t>]*|\b(?:regards|best|cheers|sincerely|greetings|grüßen|grüße|saludos|cordialement)\b,?\s{{0,3}})\s*(?:{_TITLE}\.? )*$",
    re.I,
)
_AFTER = re.compile(r"(?:\W{0,2}\s*(?:suggested|explained|said|says|wrote|reported|mentioned|confirmed|told|asked|noticed|saw|thinks|who|found|proposed|replied|joined|pointed|maintains|owns)\b|,? from our\b| and I (?:run|work|maintain|am|are|own)\b|\s*<[^>\s]+@)")


def _term(word: str) -> str:
    """What a word counts as: folded, the first part of a double name."""
    return re.sub(r"['’]s$", "", word.casefold()).split("-")[0].strip("'’.")


def _clear(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with the spans blanked out, at the same length."""
    out, done = [], 0
    for a, b, _ in sorted(spans):
        if a >= done:
            out += [text[done:a], "\x00" * (b - a)]
            done = b
    return "".join(out) + text[done:]


def _emails(text: str) -> list[re.Match]:
    """Mail addresses of people, of any length."""
    if not _EMAIL_SIGN.search(text):
        return []
    return [m for m in _EMAIL.finditer(text) if not (_NO_PERSON.match(m["l"] or m["m"]) or _NO_HOST.search(m["d"] or m["e"]))]


#: After the last digit of a number may follow a letter and an extension; so many
#: characters hold them and what must not follow.
TAIL_CHARS = 24


@functools.cache
def _kinds() -> np.ndarray:
    """Of each code point of the basic plane: 1 a digit, 2 what parts groups of digits, 3 a plain capital.

    Code points beyond count as digits, since some are.
    """
    out = np.array([unicodedata.category(chr(c)) == "Nd" for c in range(0x10000)], np.uint8)
    out[[ord(c) for c in " ()./-"]] = 2
    out[ord("A") : ord("Z") + 1] = 3
    out[0xFFFF] = 1
    return out


def number_places(texts: list[str]) -> list[list[tuple[int, int]]]:
    """(start, end) of each place of each text where a telephone or identity number may begin.

    These are groups of digits, parted by blanks, points, strokes and brackets only,
    with six digits or more, and nine plain capitals and digits in a row; up to three
    characters before belong to them.
    """
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[np.minimum(code, 0xFFFF)]
    edges = np.flatnonzero(np.diff((kind == 1).view(np.int8), prepend=0))
    first, after = edges[::2], edges[1::2]
    others = np.concatenate(([0], np.cumsum((kind == 0) | (kind == 3))))
    new = np.ones(len(first), bool)
    new[1:] = others[first[1:]] > others[after[:-1]]
    at = np.flatnonzero(new)
    digits = np.add.reduceat(after - first, at) if len(at) else np.zeros(0, np.int64)
    last = np.concatenate((at[1:], [len(first)]))[: len(at)] - 1
    a, b = first[at][digits >= 6], after[last][digits >= 6]
    rows = np.flatnonzero(np.diff(((kind == 1) | (kind == 3)).view(np.int8), prepend=0))
    c, d = rows[::2], rows[1::2]
    a, b = np.concatenate((a, c[d - c >= 9])), np.concatenate((b, d[d - c >= 9]))
    order = np.argsort(a, kind="stable")
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))[:-1]
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    of = np.searchsorted(begins, a[order], "right") - 1
    for n, x, y in zip(of.tolist(), (a[order] - begins[of]).tolist(), (b[order] - begins[of]).tolist()):
        out[n].append((max(x - 3, 0), y))
    return out


def by_form(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what its own form or a cue gives away."""
    return forms(text, _emails(text), number_places([text])[0])[0]


def forms(text: str, emails: list[re.Match], places: list[tuple[int, int]]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(start, end, kind) of what its own form or a cue gives away, and of what only looks alike.

    Numbers are looked for in ``places`` only, the result of ``number_places``.
    """
    out = [(*m.span(), "email") for m in emails]
    alike: list[tuple[int, int, str]] = []

    def matches(pattern: re.Pattern) -> Iterator[re.Match]:
        done = 0
        for a, b in places:
            for m in pattern.finditer(text, max(a, done), b + TAIL_CHARS):
                if m.start() >= b:
                    break
                yield m
                done = m.end()

    for m in matches(_SSN):
        cue = _CUE_ID.search(text, max(0, m.start() - CUE_CHARS), m.start())
        if cue or (m[1] == "-" and not re.search(r"\d[-.]?$", text[max(0, m.start() - 2) : m.start()]) and not re.search(r"(?:build|version|ticket|part|serial|model|order)\s+\W*$", text[max(0, m.start() - 20) : m.start()], re.I)):
            out.append((*m.span(), "id_number"))
        else:
            alike.append((*m.span(), "id_number"))
    out += [(*m.span(), "id_number") for m in matches(_NINO)]
    for m in matches(_DOCUMENT):
        window = text[max(0, m.start() - CUE_CHARS) : m.start()]
        (out if _CUE_ID.search(window.rpartition("\n\n")[2]) else alike).append((*m.span(), "id_number"))
    for m in matches(_PHONE):
        digits = sum(c.isdigit() for c in re.sub(r"(?:ext|x|#).*", "", m[0]))
        least = 9 if m[0][0] == "+" else 7
        if digits < least or digits > 15 or any(a < m.end() and m.start() < b for a, b, _ in out):
            continue
        if m[0][0] in "+(" or m[1] or re.match(r"0\d{3,4}[ /-]|0\d[ .]|0\d{9}", m[0]):
            out.append((*m.span(), "phone"))
    out += [(*m.span(), "address") for m in _ADDRESS.finditer(_clear(text, out) if out else text)]
    alike += [(*m.span(), "phone") for m in matches(_GROUPED) if 9 <= sum(c.isdigit() for c in m[0]) <= 12]
    return out, [x for x in alike if not any(a < x[1] and x[0] < b for a, b, _ in out)] if out else alike


_WORDS_BEFORE = re.compile(r"[^\W\d_]+")


def terms_of(text: str, begin: int, end: int, kind: str) -> list[str]:
    """The terms of a number or address: its shape, then the words before it in its line.

    A shape begins with the kind and a sharp, and so is no word.  Single plain letters
    are parts of other things and no terms.
    """
    shape = kind if kind in ("email", "address") else re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "9", text[begin:end]))
    words = _WORDS_BEFORE.findall(text, text.rfind("\n", 0, begin) + 1, begin)[-CONTEXT_WORDS:]
    return [f"{kind}#{shape}", *dict.fromkeys(w.casefold() for w in words if len(w) > 1 or not w.isascii())]


def _placed(text: str, begin: int, end: int) -> bool:
    """Does a person stand at this place?  Lines in capitals say nothing of it."""
    before = _BEFORE.search(text, max(0, begin - BEFORE_CHARS), begin)
    return bool(before and not before[0].isupper() or _AFTER.match(text, end, end + AFTER_CHARS))


def candidates(text: str) -> list[tuple[int, int, list[str], bool, bool]]:
    """(start, end, terms, in a person place, counts): possible names of people.

    ``text`` has what is found by form blanked out.
    """
    out = []
    for run in _RUN.finditer(text):
        pieces = [(m.start() + run.start(), m.end("w") + run.start(), m["w"], bool(m["c"])) for m in _PIECE.finditer(run[0])]
        pieces = [p for p in pieces if p[2]]
        for (a, b, first, comma), (c, d, second, _) in zip(pieces, pieces[1:]):
            if _IS_TITLE.match(first) or _IS_TITLE.match(second):
                continue
            placed = _placed(text, a, d)
            terms = [_term(w) for w in (first, second) if not w.endswith(".")]
            terms = [t for t in terms if len(t) > 1]
            if terms and (len(terms) == 2 or first.endswith(".") or second.endswith(".")):
                out.append((a, d, terms, placed, True))
    for m in _TITLED.finditer(text) if any(t in text for t in _TITLES) else ():
        terms = [_term(w) for w in re.findall(_WORD, m["w"])][-1:]
        if terms:
            out.append((*m.span(), terms, _placed(text, *m.span()), False))
    low = text.lower()
    for m in _SIGNED.finditer(text) if any(s in low for s in _SIGNS_OFF) else ():
        if m["a"].islower():
            out.append((m.start("a"), m.end("b"), [_term(m["a"]), _term(m["b"].split(" ")[-1])], True, False))
    return out


def hints(emails: list[re.Match]) -> list[list[str]]:
    """The two words of mail addresses such as ``first.last@host``."""
    out = []
    for m in emails:
        local = re.sub(r"\+.*|\d+$", "", m["l"] or m["m"])
        parts = [p for p in re.split(rf"{_DOT}|_| dot | DOT ", local) if p and p.isalpha()]
        if len(parts) == 2 and all(len(p) > 2 for p in parts):
            out.append([_term(p) for p in parts])
    return out


def scan(segments: DataFrame, key: str, number: str, text: str) -> DataFrame:
    """Everything that may be personal: one row for each place in a segment.

    ``key, segment_no, check, kind, begin, end, terms, placed``; ``kind`` is one
    of KINDS, still a candidate, or ``hint`` for the words of a mail address.
    ``check`` is a checksum of the segment's text.  ``placed`` tells whether a person
    place, or for the other kinds an own form or cue, gives the candidate away; it is
    NULL for candidates that do not count in the statistics.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows, checks, kinds, begins, ends, terms, placed = [], [], [], [], [], [], []

            def add(i, check, kind, a, b, words, where):
                rows.append(i), checks.append(check), kinds.append(kind), begins.append(a), ends.append(b), terms.append(words), placed.append(where)

            values = [v if v and not v.isspace() else "" for v in batch.column(2).to_pylist()]
            for i, (value, places) in enumerate(zip(values, number_places(values))):
                if not value:
                    continue
                check = zlib.crc32(value.encode("utf-8", "surrogatepass"))
                emails = _emails(value)
                found, alike = forms(value, emails, places)
                for a, b, kind in found:
                    add(i, check, kind, a, b, terms_of(value, a, b, kind), True)
                for a, b, kind in alike:
                    add(i, check, kind, a, b, terms_of(value, a, b, kind), False)
                for words in hints(emails):
                    add(i, check, "hint", 0, 0, words, True)
                for a, b, words, where, counts in candidates(_clear(value, found) if found else value):
                    add(i, check, "name", a, b, words, where if counts else None)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(checks, pa.int64()), pa.array(kinds, pa.string()), pa.array(begins, pa.int32()),
                 pa.array(ends, pa.int32()), pa.array(terms, pa.list_(pa.string())), pa.array(placed, pa.bool_())],
                names=["key", "segment_no", "check", "kind", "begin", "end", "terms", "placed"],
            )

    kind = segments.schema[key].dataType.simpleString()
    source = segments.select(F.col(key).alias("key"), F.col(number).cast("long").alias("segment_no"), F.col(text).alias("text")).where("text is not null")
    return spread(source).mapInArrow(batches, f"key {kind}, segment_no long, check long, kind string, begin int, end int, terms array<string>, placed boolean")


def disclosing_terms(
    found: DataFrame, min_bits: float = 2.0, min_share: float = 0.3, min_places: int = 3, min_company: float = 0.5
) -> DataFrame:
    """``term, bits``: the terms that reveal a person.

    ``bits`` is the pointwise mutual information of a term and a person place,
    log2(P(place | term) / P(place)), over all countable candidates of the corpus.
    A term discloses by itself if it has ``min_bits`` (or, where most candidates
    are people anyway, ``min_share`` of its occurrences in person places), in at
    least ``min_places`` places.  A rarer term discloses by its company, if at
    least ``min_company`` of its candidates also hold a term that discloses by
    itself: most surnames are told by the first names beside them.
    """
    counted = found.where("kind in ('name', 'hint') and placed is not null")
    each = counted.select(F.explode(F.array_distinct("terms")).alias("term"), F.col("placed").cast("int").alias("placed"), (F.col("kind") == "hint").cast("int").alias("hint"))
    terms = each.groupBy("term").agg(
        F.sum(1 - F.col("hint")).alias("n"), F.sum((1 - F.col("hint")) * F.col("placed")).alias("n_placed"), F.sum("hint").alias("n_hint")
    )
    total = counted.where("kind = 'name'").agg(F.count("*").alias("all"), F.sum(F.col("placed").cast("int")).alias("all_placed"))
    seen = total.first()
    base = F.lit(max(seen["all_placed"] or 0, 1) / max(seen["all"], 1))
    places = F.col("n_placed") + F.least(F.col("n_hint"), F.col("n"))
    share = F.least(places / F.col("n"), F.lit(1.0))
    scored = terms.where("n > 0").select("term", places.alias("places"), share.alias("share"), F.log2(F.greatest(share, F.lit(1e-9)) / base).alias("bits"))
    by_itself = (F.col("places") >= min_places) & (F.col("share") >= min_share / 2) & ((F.col("bits") >= min_bits) | (F.col("share") >= min_share))
    strong = materialize(scored.where(by_itself).select("term", "bits"), "strong")
    known = sized_broadcast(strong.select(F.col("term").alias("beside"), F.lit(1).alias("known")), BROADCAST_TERMS)
    pairs = found.where("kind = 'name' and placed is not null and size(terms) = 2").select(
        F.explode(F.arrays_zip(F.col("terms").alias("term"), F.reverse("terms").alias("beside"))).alias("x")
    ).select("x.term", "x.beside")
    company = pairs.join(known, "beside", "left").groupBy("term").agg(F.avg(F.coalesce("known", F.lit(0))).alias("company"))
    beside = company.where(F.col("company") >= min_company).join(strong.select("term"), "term", "left_anti").select("term", F.lit(0.0).alias("bits"))
    return strong.unionByName(beside)


def disclosing_contexts(
    found: DataFrame, min_bits: float = 1.0, min_share: float = 0.5, strong_bits: float = 2.0, strong_share: float = 0.9, min_places: int = 3,
    innocent_share: float = 0.1, innocent_uses: int = 10,
) -> DataFrame:
    """``kind, term, bits, discloses, strong, innocent``: shapes and words that reveal a kind of number or address, or tell against it.

    ``bits`` is log2(P(protected place of the kind | term) / P(such a place)) over all
    candidates that are no names.  A shape is taken to have been seen in
    ``min_places`` protected places before, if in any, so that a small corpus
    discloses too.  ``strong`` terms, always words, disclose in look-alikes.  Where
    so many candidates are protected that no term can have the bits asked for, half
    of what it can have is enough.  ``innocent`` are words of ``innocent_uses`` or
    more uses of which hardly any are protected places.
    """
    counted = found.where("kind not in ('name', 'hint')")
    each = counted.select("kind", F.explode("terms").alias("term"), F.col("placed").cast("int").alias("placed"))
    by_kind = each.groupBy("kind", "term").agg(F.count("*").alias("n"), F.sum("placed").alias("places"))
    seen = {r["kind"]: (r["n"], r["places"]) for r in counted.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("placed").cast("int")).alias("places")).collect()}  # one row a kind
    total = max(sum(n for n, _ in seen.values()), 1)
    base = F.coalesce(*[F.when(F.col("kind") == k, F.lit(max(p, 1) / total)) for k, (_, p) in seen.items()], F.lit(1.0))
    most = -F.log2(base)  # bits of a term that stands with such places only
    shape = F.contains(F.col("term"), F.lit("#"))
    before = F.when(shape & (F.col("places") > 0), F.lit(min_places)).otherwise(0)
    known = by_kind.withColumn("n", F.sum("n").over(Window.partitionBy("term")) + before).withColumn("places", F.col("places") + before)
    share = F.col("places") / F.col("n")
    scored = known.select("kind", "term", "n", "places", share.alias("share"), F.when(F.col("places") > 0, F.log2(share / base)).alias("bits"), shape.alias("shape"))
    discloses = (F.col("places") >= min_places) & (F.col("share") >= min_share) & (F.col("bits") >= F.least(F.lit(min_bits), most / 2))
    strong = discloses & ~F.col("shape") & (F.col("share") >= strong_share) & (F.col("bits") >= F.least(F.lit(strong_bits), most / 2))
    innocent = ~F.col("shape") & (F.col("n") >= innocent_uses) & (F.col("share") <= innocent_share)
    flags = (F.coalesce(c, F.lit(False)).alias(n) for c, n in ((discloses, "discloses"), (strong, "strong"), (innocent, "innocent")))
    return scored.select("kind", "term", "bits", *flags).where("discloses or innocent")


def disclosed_places(found: DataFrame) -> DataFrame:
    """``key, segment_no, check, pii_kind, begin, end``: the numbers and addresses that their terms disclose.

    A look-alike needs a word that discloses strongly, and none that is innocent.
    """
    terms = sized_broadcast(materialize(disclosing_contexts(found), "contexts"), BROADCAST_TERMS)
    place = ["key", "segment_no", "check", "kind", "begin", "end"]
    asked = found.where("kind not in ('name', 'hint')").select(*place, "placed", F.explode("terms").alias("term"))
    told = asked.join(terms, ["kind", "term"]).groupBy(*place).agg(
        F.bool_or(F.col("discloses") & (F.col("placed") | F.col("strong"))).alias("told"), F.bool_or(F.col("innocent") & ~F.col("placed")).alias("innocent")
    )
    return told.where("told and not innocent").select("key", "segment_no", "check", F.col("kind").alias("pii_kind"), "begin", "end")


def mentions(segments: DataFrame, key: str, number: str, text: str) -> DataFrame:
    """``key, segment_no, check, pii_kind, begin, end, score`` of all personal information.

    A candidate is a name if all its terms disclose, or if it stands in a person
    place and one of them discloses by itself, or there has an initial before it.
    The other kinds come from ``disclosed_places``.  ``score`` ranks overlapping
    places.

    NULL, empty and blank segments hold none.  Offsets count code points from 0.
    Segments with the same key and number (repeated rows) are told apart by
    ``check``.  The term statistics cover all segments; candidates are joined with
    the disclosing terms, which are broadcast only if they are few.
    """
    found = materialize(scan(segments, key, number, text), "scan")
    terms = sized_broadcast(materialize(disclosing_terms(found), "terms"), BROADCAST_TERMS)
    forms = disclosed_places(found)
    first, last = F.element_at("terms", 1), F.element_at("terms", -1)
    judged = (
        found.where("kind = 'name'").select("key", "segment_no", "check", "begin", "end", "placed", (F.size("terms") == 1).alias("alone"), first.alias("first"), last.alias("last"))
        .join(terms.select(F.col("term").alias("first"), F.col("bits").alias("bits_first")), "first", "left")
        .join(terms.select(F.col("term").alias("last"), F.col("bits").alias("bits_last")), "last", "left")
    )
    both = F.col("bits_first").isNotNull() & F.col("bits_last").isNotNull()
    either = (F.coalesce("bits_first", F.lit(0.0)) > 0) | (F.coalesce("bits_last", F.lit(0.0)) > 0)
    score = F.coalesce("bits_first", F.lit(-2.0)) + F.coalesce("bits_last", F.lit(-2.0)) + F.coalesce(F.col("placed").cast("int"), F.lit(0))
    initial = F.col("alone") & F.coalesce("placed", F.lit(False))
    names = judged.where(both | initial | (either & F.coalesce("placed", F.lit(True)))).select(
        "key", "segment_no", "check", F.lit("name").alias("pii_kind"), "begin", "end", score.cast("double").alias("score")
    )
    forms = forms.withColumn("score", F.lit(99.0))
    return forms.unionByName(names).withColumnRenamed("key", key)


def segments_of(df: DataFrame, key: str, body: str, comments: str, comment_text: str = "body") -> DataFrame:
    """``key, segment_no, text``: 0 for the body, k for the k-th comment."""
    texts = F.concat(F.array(F.col(body)), F.coalesce(F.transform(F.col(comments), lambda c: c[comment_text]), F.array().cast("array<string>")))
    return df.select(F.col(key), F.posexplode(texts).alias("segment_no", "text")).where("text is not null")


def kinds_found(df: DataFrame, key: str, body: str, comments: str) -> DataFrame:
    """``key, segment_no, pii_kind``: one row for each kind that a segment holds."""
    found = mentions(segments_of(df, key, body, comments), key, "segment_no", "text")
    return found.select(key, F.col("segment_no").cast("long").alias("segment_no"), "pii_kind").distinct()


def placeholders(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    """``text`` with spans replaced by their kind; of overlapping ones the best score wins.

    Of equal scores the longer span wins, then the earlier.
    """
    kept: list[tuple[int, int, str]] = []
    for a, b, kind, _ in sorted(spans, key=lambda s: (-s[3], s[0] - s[1], s[0])):
        if all(b <= c or d <= a for c, d, _ in kept):
            kept.append((a, b, kind))
    out, done = [], 0
    for a, b, kind in sorted(kept):
        out += [text[done:a], f"<{kind.upper()}>"]
        done = b
    return "".join(out) + text[done:]


def sanitized(df: DataFrame, key: str, body: str, comments: str) -> DataFrame:
    """``key, body, comments`` of every row with personal information replaced.

    Everything else stays character by character; NULL bodies, NULL comments and
    comments without body stay NULL; other columns are not read.  Repeated keys
    keep all their rows.
    """
    found = mentions(segments_of(df, key, body, comments), key, "segment_no", "text")
    spans = found.groupBy(key).agg(F.collect_set(F.struct("segment_no", "check", "begin", "end", "pii_kind", "score")).alias("spans"))
    rows = df.select(F.col(key), F.col(body).alias("body"), F.col(comments).alias("comments")).join(spans, key, "left")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            bodies, threads, where = (batch.column(i).to_pylist() for i in (1, 2, 3))

            def cleared(value: str | None, number: int, marks: list[dict] | None) -> str | None:
                if not value or not marks:
                    return value
                check = zlib.crc32(value.encode("utf-8", "surrogatepass"))
                return placeholders(value, [(m["begin"], m["end"], m["pii_kind"], m["score"]) for m in marks if m["segment_no"] == number and m["check"] == check])

            new = [cleared(b, 0, w) for b, w in zip(bodies, where)]
            new_threads = [
                None if t is None else [None if c is None else {**c, "body": cleared(c["body"], k, w)} for k, c in enumerate(t, 1)] for t, w in zip(threads, where)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(new, pa.string()), pa.array(new_threads, batch.schema.field(2).type)], names=[key, "body", "comments"]
            )

    schema = rows.select(key, "body", "comments").schema
    out = rows.select(key, "body", "comments", "spans").mapInArrow(batches, schema)
    return out.select(key, F.col("body").alias(body), F.col("comments").alias(comments))
