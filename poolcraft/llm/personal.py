"""Personal data in free text: find it and put typed placeholders in its place (problem 1).

Weak supervision. Finders propose spans of five kinds; for each span several
labelers vote yes, no or abstain: its written form (patterns), what is known of its
parts (gazetteers: names from the candidate records, street words, top-level
domains), and the words around it (labels, titles, the line it stands in). The votes
of all texts are counted by pattern; expectation-maximisation over those counts
estimates, per kind, how reliable each labeler is, and from that how likely a span
with given votes is personal data. A logistic classifier over votes and further
features of the span is then trained on these soft labels, and decides.

The counts are sums over all spans of all texts, by votes and features; there are as many
rows as different patterns (a few hundred), whatever the number of texts, so both fits
take place on the driver and use every text. A text is read once, whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolcraft.session import cut_lineage, written

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}

#: Most names of each sort that every task holds, the most frequent first (under 4 MB); a text's other words are joined to the rest of the names.
GAZETTEER = 100_000

#: Labelers per kind, in the order of their votes; a kind's missing ones abstain.
LABELERS = {
    "email": ("strict form", "written-out form", "known top-level domain", "own line or contact line"),
    "phone": ("national form", "number of digits", "label or contact line", "counts, dates and references"),
    "id_number": ("form of an identity number", "label before it", "number of characters", "documents line"),
    "address": ("street form", "street word", "town, postcode or label", "prose words"),
    "name": ("first name known", "last name known", "title, label or heading", "organisation or trade words", "dealings with a person, or a place"),
}
VOTES = 5
YES, NO, ABSTAIN = 1, 2, 0

# --- finders ----------------------------------------------------------------------------------------------------------

_AT_WORD = (re.compile(r" at (?=[\w-]+(?: dot | ?[(\[]dot[)\]] ?|\.)[\w-]+)"), re.compile(r" AT (?=[\w-]+(?: DOT | ?[(\[]DOT[)\]] ?|\.)[\w-]+)"))
_AT_MARK = re.compile(r"@|[(\[]\s?(?:at|AT)\s?[)\]]")
_LOCAL = re.compile(r"[\w.+%'-]+$")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?| dot )[A-Za-z0-9-]+)+", re.I)
_DIGITS = re.compile(r"(?<![\w@.,/%-])(?:\+\s?|\()?\d(?:[\d \t\xa0()./‐‑‒–-](?!\s{2})){5,24}\d(?:\s?(?:ext\.?|extension|x)\s?\d{1,6})?(?![\w%@])", re.I)
_CODES = re.compile(r"(?<![\w-])(?:[A-Z]{1,2} ?\d[\d -]{4,12}[A-D]?|\d{8}-[A-Z])(?![\w-])")
_CODE = re.compile(r"[A-Z]\d{3}-\d{4}-\d{4}|[A-Z]{1,2}\d{6,9}[A-Z]?|[A-Z]{2} \d\d ?\d\d ?\d\d ?[A-D]|\d{8}-[A-Z]")

# Street words and their usual short forms.
_STREETS = r"street|st|avenue|ave|road|rd|lane|ln|drive|dr|court|ct|way|place|pl|terrace|ter|close|crescent|cres|boulevard|blvd|square|sq|parkway|pkwy|highway|hwy|circle|cir|trail|trl|row|walk|gardens|grove|mews|loop|alley"
_RUES = r"rue|avenue|av\.|bd|boulevard|impasse|chemin|allée|place|quai|cours|route|passage|square|calle|avenida|paseo|plaza|camino|via|viale|piazza|corso"
_STRASSEN = r"straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer|steig|pfad|graben|markt"
_HOUSE = re.compile(rf"(?<![\w.,/-])\d{{1,5}}(?:[A-Za-z]|,| ?bis,?| ?ter,?)? (?=[A-Z0-9À-Ý]|(?i:{_RUES})\b)")
_US = re.compile(rf"\d{{1,5}}[A-Za-z]? (?:(?:N|S|E|W|NE|NW|SE|SW)\.? |(?:North|South|East|West|NORTH|SOUTH|EAST|WEST) )?(?:[A-Z0-9][\w'’.-]* ){{1,3}}?(?i:{_STREETS})\b\.?")
_FR = re.compile(rf"\d{{1,4}}(?: ?(?:bis|ter|quater|[A-Da-d]))?,? (?i:{_RUES}) (?i:(?:de |du |des |de la |de l['’]|d['’]|del |de los |de las |della )?)[A-ZÀ-Ý][\w'’-]*(?: (?i:de |du |des |la )?[A-ZÀ-Ý][\w'’-]+)?")
_BEHIND = re.compile(r"(?<=[a-zß.A-Z]) \d{1,4}(?: ?[a-z])?(?= ?[,;|·•\n\r)]|\.(?:\s|$)|  |$)")
_DE = re.compile(rf"(?<![\w-])(?:[A-ZÄÖÜ][\wäöüß-]*(?i:{_STRASSEN})|(?:Am|An der|An den|Auf dem|Auf der|Im|In der|In den|Zum|Zur|Unter den|Unter der|Hinter der|Vor dem|AM|AN DER|IM|ZUM|ZUR)(?: [A-ZÄÖÜ][\wäöüß-]+){{1,3}}|[A-ZÄÖÜ][\wäöüß]+(?:er|sche) (?i:{_STRASSEN}))$")
# Streets whose word comes first and whose number comes last.
_ROAD_FIRST = re.compile(
    r"(?<![\w-])(?i:calle|c/|avenida|avda\.?|av\.|paseo|plaza|camino|carretera|via|viale|piazza|corso|largo|rua|travessa|rue|ulica|ul\.|aleja|al\.|osiedle|os\.|plac|pl\.|ulice|utca)\s?"
    r"(?:(?i:de|del|della|di|da|das|do|dos|la|las|los|el|des|du)\s){0,3}[A-ZÀ-Ž][\w'’.-]*(?: (?:(?i:de|del|la|las|los|di|da|y|e)\s){0,2}[A-ZÀ-Ž][\w'’.-]*){0,3},?$"
)
_BOX = re.compile(r"(?<!\w)(?:P\.? ?O\.? ?Box|Post Office Box|Postfach|Boîte postale|Apartado(?: de correos)?)\s?(?:no\.? ?)?\d[\d ]{0,7}\d?(?!\w)", re.I)
_BOX_MARKS = ("ox ", "OX ", "ostfach", "OSTFACH", "partado", "PARTADO", "ostale", "OSTALE")

_TOKEN = re.compile(r"[A-ZÀ-ÖØ-Þ](?:[^\W\d_]+|(?=['’][A-ZÀ-ÖØ-Þ]))(?:['’][^\W\d_]+)*(?:-[^\W\d_]+(?:['’][^\W\d_]+)*)*")
_GAP = re.compile(r"[ \t\xa0]{1,2}(?:[A-Z]\.?[ \t]{1,2})?(?:(?:van|von|de|der|den|del|di|da|la|le|bin|al|ten)[ \t]){0,2}")
_COMMA = re.compile(r",[ \t]{1,2}")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_](?:['’-])?(?: -)? ){2,24}(?: {1,3}(?:[^\W\d_](?:['’-])? ?(?:- )?){2,24})+(?!\S)")
_INITIAL = re.compile(r"[ \t][A-Z]\.(?![\w.])")

# --- labelers' knowledge ------------------------------------------------------------------------------------------------

_TLDS = set("com org net edu gov int mil info biz io ai dev app co uk de fr es it nl be ch at se no dk fi pl cz pt ie us ca mx br ar in jp cn au nz za example test invalid eu".split())
_PHONE_LABEL = re.compile(r"(?<![^\W\d_])(?:tel|phone|mobile|mob|cell|fax|handy|telefon|telephone|téléphone|teléfono|móvil|call|t|m|whatsapp)\s?[.:#]*\s*$|[☎✆📞📱]\s*$", re.I)
_PHONE_FORM = re.compile(
    r"(?:\+|00)\s?\d{1,3}[\s.‑-]*(?:\(0\)[\s./‑-]*)?(?:\(?\d{1,5}\)?[\s./‑-]*){1,6}\d(?:\s?(?:ext\.?|extension|x)\s?\d+)?"
    r"|1?[\s.‑-]?\(?[2-9]\d\d\)?[\s.‑-]?\d{3}[\s.‑-]?\d{4}(?:\s?(?:ext\.?|extension|x)\s?\d+)?|0\d(?:[\s.]?\d\d){4}|0\d{2,4}[\s/-]\d{3,8}(?:[\s-]\d{2,5})?", re.I
)
_NOT_PHONE = re.compile(r"(?<![^\W\d_])(?:reference|ref|ticket|batch|invoice|order|build|version|case|no\.?|number|issue|processed|request|worker|incident|of|item|release|id|nr\.?)\s?[.:#]*\s*$", re.I)
_DATES = re.compile(r"^\(?(?:19|20)\d\d(?:[-/.]\d{1,2})?\s*(?:[–-]|to)\s*(?:19|20)\d\d|^(?:19|20)\d\d[-/.]\d{1,2}(?:[-/.]\d{1,2})?$|^\d{1,3}(?: \d{3}){2,}$|^\d{1,2}[./]\d{1,2}[./]\d{2,4}$")
_YEARS = re.compile(r"\(?(?:19|20)\d\d(?:[-/.]\d{1,2})?\s*(?:[–-]|to)\s*(?:19|20)\d\d")
_ID_LABEL = re.compile(
    r"(?<!\w)(?:ssn|social\s+security(?:\s+(?:no|number|nr))?|soc\.?\s*sec\.?(?:\s*(?:no|number|nr))?|national\s+insurance(?:\s+(?:no|number))?|ni\s+(?:number|no)|nino|passport(?:\s+(?:no|number|nr))?|reisepass(?:nummer)?|pasaporte|passeport"
    r"|travel\s+document(?:\s+(?:no|number))?|driv(?:ing|er['’]?s?)\s+licen[cs]e(?:\s+(?:no|number))?|führerschein|tax\s+(?:id|no|number|identification\s+number)|steuer-?(?:id|nummer|nr)|steueridentifikationsnummer|id\s+(?:card|no|number)(?:\s+(?:no|number))?"
    r"|identity\s+(?:card|no|number)(?:\s+(?:no|number))?|personalausweis|ausweis(?:nummer|nr)?|dni|nie|tin|insee|sozialversicherungsnummer)\s?[.:#]*\s*(?:no\.|nr\.)?\s*$", re.I
)
_ID_FORM = re.compile(r"\d{3}[- ]?\d{2}[- ]?\d{4}|[A-Z]\d{3}-\d{4}-\d{4}|[A-Z]{1,2}\d{7,9}|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|\d\d ?\d{3} ?\d{3} ?\d{3}|\d{8}-?[A-Z]", re.I)
_DOCUMENTS = re.compile(r"(?:documents|work eligibility|eligibility|identification|ausweise|papers|id)\s*:", re.I)
_ADDRESS_LABEL = re.compile(r"(?<!\w)(?:address(?: until \w+)?|home|(?:send|sent|deliver\w*|ship\w*|parcels?|post|mail|write)\s(?:\w+\s){0,2}to|(?:lives?|living|resid\w+) (?:at|in)|adresse|anschrift|dirección|domicilio|indirizzo|wohnhaft|street|residence|at)\s?:?\s*$", re.I)
_AFTER_ADDRESS = re.compile(r"\s*(?:,\s*(?:apt|unit|floor|suite|#|ste|flat)|#\s?\d|,\s*\d{4,5}\b|,\s*[A-ZÀ-Ý][\w .'-]+(?:,\s*[A-Z]{2}\b|$|\s*[|·•])|\s[\d]{5}\b|\s*$|\s*[|·•]|\s{2,})", re.I | re.M)
_PROSE = {"to", "the", "a", "an", "on", "in", "of", "and", "for", "with", "from", "at", "by", "ways", "or", "as", "per", "days", "hours", "people", "users", "years", "months", "more", "steps"}
_TITLE = re.compile(r"(?:\b(?:mr|mrs|ms|miss|dr|prof|herr|frau|señor|señora|sr|sra|mme|m|ing|dipl)\.?\s+)+$", re.I)
_NAME_LABEL = re.compile(
    r"(?:report(?:ed|s|ing) to|(?:mentor|supervis|manag|train|coach|interview|hir|recruit|recommend|refer|le)\w*d? by|manager:|(?:work|partner|team|pair|collaborat)\w*(?: \w+)? with|(?:took|taken|hand|pass)\w* over (?:from|to)|curriculum vitae of|(?:resume|résumé) of|lebenslauf von|cv of|page \d+ of \d+ [–—-]"
    r"|name:|contact:|referee:|reference:|supervisor:|together with|signed,?|candidate:)\s*$",
    re.I,
)
#: Last words of titles and labels; anything else before a pair of capitalised words needs no closer look.
_CUE_ENDS = frozenset("mr mrs ms miss dr prof herr frau señor señora sr sra mme m ing dipl to by manager with from of – — - name contact referee reference supervisor together signed candidate von".split())
_AFTER_NAME = re.compile(r"\s*(?:\((?:client|manager|colleague|former)|,\s*(?:former|client|my|our|head|line|then)\b|[–-]\s*[\d+(]|,\s*[+(\d])", re.I)
# Words before or after persons, and before places.
_DEALT = frozenset(
    """with by to from met meet thank thanks dear hello hi cc supervisor manager boss mentor colleague coach teacher professor advisor adviser director partner friend wife husband son daughter brother sister
    With By Dear Hello Hi Thank Met under alongside between and interviewed called hired mentored joined asked told mit von bei chef kollege kollegin con señor por avec par chez""".split()
)
_SAID = re.compile(r",?\s+(?:who|said|says|told|asked|wrote|writes|approved|agreed|led|leads|managed|manages|recommended|joined|left|called|signed|confirmed|replied|explained|thinks|thought|suggested|offered|introduced|trained|taught|helped|and I)\b")
_PLACED = frozenset("in at near inside across around outside throughout the a an im in der bei en dans à a at".split())
# Words of organisations, trades, towns and sections, none of them part of a person's name.
_NOT_NAME = set(
    """engineer analyst consultant manager lead intern developer specialist officer director architect administrator scientist technician assistant coordinator designer
    software data senior junior site reliability support business technical solutions integration implementation platform forward deployed qa team product project security network web mobile
    labs cloud systems group retail payments freight logistics health energy foods insurance robotics analytics partners works holdings inc ltd gmbh llc bank university college institute polytechnic hochschule school state
    bachelor master associate phd degree electrical engineering networking informatics mechatronics economics physics computer science
    street avenue road lane drive court way place terrace close crescent bay bend harbour heights hill north south east west
    january february march april may june july august september october november december present profile summary experience education skills about work history employment technologies technical professional
    curriculum vitae page tel mobile phone email the and for documents passport second home""".split()
)
_HEAD = re.compile(r"\s*(?:#{1,3}\s|\*\*|Curriculum vitae of\s)?", re.I)


def plain(text: str) -> str:
    """Lower case, letters and digits only."""
    return "".join(c for c in text.lower() if c.isalnum())


@lru_cache(maxsize=100_000)
def fold(word: str) -> str:
    return unicodedata.normalize("NFC", word).casefold().replace("’", "'")


def _line(text: str, start: int, end: int) -> tuple[str, str]:
    """What stands before and after a span in its line."""
    a, b = text.rfind("\n", 0, start) + 1, text.find("\n", end)
    return text[a:start], text[end : len(text) if b < 0 else b].rstrip("\r")


def _contact(before: str, after: str) -> bool:
    """The span is a line of its own, or a cell of a contact line."""
    return (not before.strip(" \t*#-•>") or re.search(r"(?:[|·•]|\s{2})\s*\S{0,8}\s*$", before) is not None) and (not after.strip(" \t*>)") or re.match(r"[>)]?\s*(?:[|·•]|\s{2})", after) is not None)


class Finder:
    """Proposes spans with votes and features; ``first`` and ``last`` are folded names."""

    def __init__(self, first: frozenset[str], last: frozenset[str]) -> None:
        self.first, self.last = first, last

    def spans(self, text: str) -> list[tuple[int, int, int, tuple[int, ...], int]]:
        """(start, end, kind, votes, features) of a text, without overlaps, in order."""
        found: list[tuple[int, int, int, tuple[int, ...], int]] = []
        self._emails(text, found)
        self._numbers(text, found)
        self._addresses(text, found)
        self._names(text, found)
        if len(found) < 2:
            return found
        # A piece inside another isn't one; of two that overlap the earlier finder's, then the longer, stays. Those taken are apart, so only neighbours can overlap.
        taken: list[tuple[int, int, int, tuple[int, ...], int]] = []
        for span in sorted(found, key=lambda s: (s[2] == 4, -(s[1] - s[0]))):
            at = bisect_left(taken, span)
            if (at == 0 or taken[at - 1][1] <= span[0]) and (at == len(taken) or taken[at][0] >= span[1]):
                taken.insert(at, span)
        return taken

    def _emails(self, text: str, found: list) -> None:
        anchors = [(m.start(), m.end(), m[0]) for m in _AT_MARK.finditer(text)]
        for form, mark in zip(_AT_WORD, ("dot", "DOT"), strict=True):
            if mark in text or mark == "dot":
                anchors += ((m.start(), m.end(), " at ") for m in form.finditer(text))
        for left, right, sign in anchors:
            left -= left > 0 and text[left - 1].isspace()
            right += right < len(text) and text[right].isspace()
            local = _LOCAL.search(text, max(0, left - 64), left)  # 64 characters are the most an address may have before its sign
            domain = _DOMAIN.match(text, right)
            if not local or not domain or not any(c.isalnum() for c in local[0]):
                continue
            start, end = local.start(), domain.end()
            while end > domain.start() and text[end - 1] in "-.":
                end -= 1
            before, after = _line(text, start, end)
            strict = sign == "@" and right - left == 1 and re.search(r"[(\[]| dot ", domain[0], re.I) is None
            last = plain(re.split(r"\W+|_", domain[0])[-1])
            own = _contact(before, after) or before.rstrip().endswith((":", "<", ",", "–", "-"))
            votes = (YES if strict else ABSTAIN, ABSTAIN if strict else (YES if "dot" in domain[0].lower() or sign != " at " else NO), YES if last in _TLDS else NO, YES if own else ABSTAIN)
            found.append((start, end, 0, votes, int(len(local[0]) > 2) | 2 * int(text[start].isalnum())))

    def _numbers(self, text: str, found: list) -> None:
        for m in _DIGITS.finditer(text):
            start, end = m.start(), m.end()
            value = text[start:end]
            if value.startswith("(") and ")" not in value:
                start += 1
                value = value[1:]
            if value.count("(") < value.count(")") and value.endswith(")"):
                value = value[:-1]
                end -= 1
            digits = sum(c.isdigit() for c in value)
            if digits < 7:
                continue
            if _YEARS.match(value):
                found.append((start, end, 1, (NO, YES if 9 <= digits <= 15 else NO, NO, NO), 0))
                continue
            before, after = _line(text, start, end)
            label = _ID_LABEL.search(before)
            if label or (digits in (9, 11) and _DOCUMENTS.search(before) and _ID_FORM.fullmatch(value)):
                self._id(start, end, value, before, label is not None, found)
                continue
            tagged = _PHONE_LABEL.search(before) is not None
            contact = tagged or _contact(before, after) or before.rstrip().endswith(("–", ",", "-")) and len(before) < 60
            against = not tagged and (_NOT_PHONE.search(before) is not None or _DATES.match(value) is not None)
            main = re.split(r"(?i)\s?(?:ext|x)", value)[0]
            size = sum(c.isdigit() for c in main)
            votes = (YES if _PHONE_FORM.fullmatch(value) else NO, YES if 9 <= size <= 15 else NO, YES if contact else NO, NO if against else ABSTAIN)
            found.append((start, end, 1, votes, int(value.startswith(("+", "00"))) | 2 * int(tagged) | 4 * int(size != digits)))
        for m in _CODES.finditer(text):
            start = m.start()
            code = _CODE.match(m[0])
            if not code or m[0][code.end() : code.end() + 1].strip(" "):
                continue
            before, _ = _line(text, start, start + code.end())
            label = _ID_LABEL.search(before) is not None
            if label or code[0][0].isalpha():
                self._id(start, start + code.end(), code[0], before, label, found)

    @staticmethod
    def _id(start: int, end: int, value: str, before: str, label: bool, found: list) -> None:
        size = sum(c.isalnum() for c in value)
        lead = before.strip(" \t#*-•")
        alone = label and len(lead) < 45 and not re.search(r"[.!?]\s", lead[:-4])
        votes = (YES if _ID_FORM.fullmatch(value) else NO, YES if label else NO, YES if 8 <= size <= 14 else NO, YES if _DOCUMENTS.search(before) or alone else ABSTAIN)
        found.append((start, end, 2, votes, int(value[0].isalpha())))

    @staticmethod
    def _addresses(text: str, found: list) -> None:
        places = []
        for house in _HOUSE.finditer(text):
            for form, pattern in enumerate((_US, _FR)):
                if m := pattern.match(text, house.start()):
                    places.append((form, m.start(), m.end()))
        for number in _BEHIND.finditer(text):
            at = number.start()
            lead = text[_words_before(text, at, 7) : at]
            if m := _DE.search(lead) or _ROAD_FIRST.search(lead):
                places.append((2, at - len(lead) + m.start(), number.end()))
        if any(mark in text for mark in _BOX_MARKS):
            places += ((3, m.start(), m.end()) for m in _BOX.finditer(text))
        for form, start, end in places:
            before, after = _line(text, start, end)
            words = re.findall(r"[^\W\d_]+", text[start:end].lower()) if form == 0 else []
            prose = any(w in _PROSE for w in words[:-1])
            placed = _AFTER_ADDRESS.match(after) is not None
            known = _ADDRESS_LABEL.search(before) is not None or _contact(before, after) or (not before.strip(" \t*#-•>|·") and placed)
            votes = (NO if prose else YES, YES, YES if placed or known else NO, NO if prose or not (known or re.search(r"(?:[|·•]|\s{2})\s*$|^\s*[#*-]*\s*$", before)) else ABSTAIN)
            found.append((start, end, 3, votes, 1 << form))

    def _name(self, text: str, start: int, end: int, a: str, b: str, heading: bool, found: list) -> None:
        first, last = fold(a), fold(b)
        low = {first, last, *first.split("-"), *last.split("-")}
        before, after = _line(text, start, end)
        title = _TITLE.search(before) is not None
        cue = title or _NAME_LABEL.search(before) is not None or _AFTER_NAME.match(after) is not None
        is_first, is_last = first in self.first, last in self.last
        known = is_first or is_last
        # The lists speak against a pair of which they have one half; of one they don't have at all they know nothing.
        listed = (YES if is_first else NO, YES if is_last else NO) if known or heading else (ABSTAIN, ABSTAIN)
        words = before.rsplit(None, 1)
        last_word = words[-1].strip(",.;:(\"'") if words else ""  # as written: "my manager, A B", not "Manager, A B"
        dealt = YES if last_word in _DEALT or _SAID.match(after) else NO if last_word in _PLACED else ABSTAIN
        votes = (*listed, YES if cue or heading and known else ABSTAIN, NO if low & _NOT_NAME else ABSTAIN, dealt)
        if heading and not known and not cue:
            return
        found.append((start, end, 4, votes, int(heading) | 2 * int(title) | 4 * int(cue) | 8 * int(known)))

    def _unknown(self, text: str, run: list[re.Match], found: list) -> None:
        """Proposes two to five words in a row that no list has; longer runs are headings and titles."""
        if 2 <= len(run) <= 5:
            start, end = run[0].start(), run[-1].end()
            if text[start:end].isupper():  # in a line of capitals these tell nothing
                before, after = _line(text, start, end)
                if (before + after).isupper():
                    return
            self._name(text, run[0].start(), run[-1].end(), run[0][0], run[-1][0], False, found)

    def _names(self, text: str, found: list) -> None:
        first, last = self.first, self.last
        head_start, head_end = _heading(text)
        previous = None
        skip_to = -1
        run: list[re.Match] = []  # capitalised words in a row of which no list and no trade knows any
        for m in _TOKEN.finditer(text):
            if not (run and run[-1] is previous and _joins(text, previous.end(), m.start())):
                self._unknown(text, run, found)
                run = []
            word = fold(m[0])
            if word in _NOT_NAME:
                run = []  # with a trade's word behind it, it is an organisation's name
            elif len(word) > 1 and word not in first and word not in last:
                run.append(m)
            else:
                self._unknown(text, run, found)
                run = []
            if previous is not None and previous.start() >= skip_to:
                a, b = previous[0], m[0]
                between = text[previous.end() : m.start()]
                heading = head_start <= previous.start() < head_end
                if len(between) < 14:
                    if _GAP.fullmatch(between) and len(a) > 1:
                        fa, fb = fold(a), fold(b)
                        if fa in first or fb in last or heading:
                            if len(b) > 1:
                                self._name(text, previous.start(), m.end(), a, b, heading, found)
                                if fa in first and fb in last:
                                    skip_to = m.end()
                    elif between[0] == "," and _COMMA.fullmatch(between) and fold(a) in last and fold(b) in first:
                        end = m.end()
                        initial = _INITIAL.match(text, end)
                        before, after = _line(text, previous.start(), end)
                        if not before.strip(" \t#*") and (initial or not after.strip(" \t*")):
                            self._name(text, previous.start(), initial.end() if initial else end, b, a, heading, found)
                            skip_to = end
            previous = m
        self._unknown(text, run, found)
        for m, parts in _spaced(text, head_start, head_end):
            end = m.start() + len(m[0].rstrip())
            self._name(text, m.start() + len(m[0]) - len(m[0].lstrip()), end, parts[0], parts[-1], True, found)


class _Either:
    """The names of two sets, without a copy of either."""

    def __init__(self, common: frozenset[str], rare: frozenset[str]) -> None:
        self.common, self.rare = common, rare

    def __contains__(self, name: str) -> bool:
        return name in self.common or name in self.rare


def _heading(text: str) -> tuple[int, int]:
    """Where the heading is, the first line with a letter: from that letter to the end of the line."""
    start, stop = 0, len(text)
    while start < stop and not text[start].isalpha():
        start += 1
    end = text.find("\n", start)
    return start, stop if end < 0 else end


def _spaced(text: str, start: int, end: int) -> Iterator[tuple[re.Match, list[str]]]:
    """Names in spaced letters in a heading, with their parts."""
    if end - start > 4 and text[start + 1 : start + 2] == " ":
        for m in _SPACED.finditer(text, start, min(len(text), end + 1)):
            parts = [p.replace(" ", "") for p in re.split(r"\s{2,}", m[0].strip())]
            if len(parts) >= 2:
                yield m, parts


def name_words(text: str) -> set[str]:
    """Every word of a text that the finder looks up among names, folded."""
    return {fold(m[0]) for m in _TOKEN.finditer(text)} | {fold(p) for _, parts in _spaced(text, *_heading(text)) for p in (parts[0], parts[-1])}


def _joins(text: str, end: int, start: int) -> bool:
    """Two words belong together: a blank between them, or an initial and particles of names."""
    return start - end < 14 and _GAP.fullmatch(text, end, start) is not None


def _words_before(text: str, at: int, words: int) -> int:
    """Where the last ``words`` words of a line before ``at`` begin."""
    start, at = text.rfind("\n", 0, at) + 1, at
    for _ in range(words):
        at = text.rfind(" ", start, at)
        if at < 0:
            return start
    return at + 1


# --- gazetteer, counts, fits ----------------------------------------------------------------------------------------------


def gazetteer(people: DataFrame, column: str) -> tuple[frozenset[str], DataFrame | None]:
    """All names in ``column``, folded: the GAZETTEER most frequent as a set, and the others as a table (name), or None where there are none."""
    clean = F.trim(F.regexp_replace(column, r"\s+", " "))
    named = people.select(clean.alias("name")).filter(F.col("name").rlike(r"^[\p{L}][\p{L}'’ -]{1,40}$"))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([fold(x) for x in batch.column(0).to_pylist()], pa.string()), batch.column(1)], names=["name", "n"])

    spelled = named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).mapInArrow(folded, "name string, n bigint")
    counted = cut_lineage(spelled.groupBy("name").agg(F.sum("n").alias("n")))
    top = counted.orderBy(F.desc("n"), "name").limit(GAZETTEER + 1).collect()
    if len(top) <= GAZETTEER:
        return frozenset(r.name for r in top), None
    least = top[GAZETTEER - 1]
    rest = counted.filter((F.col("n") < least.n) | ((F.col("n") == least.n) & (F.col("name") > least.name))).select("name")
    return frozenset(r.name for r in top[:GAZETTEER]), rest


def _named(texts: DataFrame, people: DataFrame) -> tuple[DataFrame, frozenset[str], frozenset[str]]:
    """``texts`` (src, id, text) with the names in them that no task holds (rare_first, rare_last), and the names that every task holds.

    Where there are no more names than GAZETTEER the two columns are null. Else the texts' words are joined to the other names, so no name is left out.
    """
    (first, more_first), (last, more_last) = gazetteer(people, "first_name"), gazetteer(people, "last_name")
    none = F.lit(None).cast("array<string>")
    if more_first is None and more_last is None:
        return texts.select("src", "id", "text", none.alias("rare_first"), none.alias("rare_last")), first, last
    held = texts.sparkSession.sparkContext.broadcast(first & last)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], []]
            for src, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for word in name_words(text or "") - held.value:
                    for column, x in zip(rows, (src, key, word), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["src", "id", "name"])

    sorts = [more.select("name", F.lit(sort).alias("sort")) for more, sort in ((more_first, "first"), (more_last, "last")) if more is not None]
    rest = sorts[0] if len(sorts) == 1 else sorts[0].unionByName(sorts[1])
    hits = texts.select("src", "id", "text").mapInArrow(words, "src string, id bigint, name string").join(rest, "name")
    rare = hits.groupBy(F.col("src").alias("s"), F.col("id").alias("i")).agg(*[F.collect_set(F.when(F.col("sort") == x, F.col("name"))).alias(f"rare_{x}") for x in ("first", "last")])
    joined = texts.join(rare, F.col("src").eqNullSafe(F.col("s")) & F.col("id").eqNullSafe(F.col("i")), "left")
    return joined.select("src", "id", "text", "rare_first", "rare_last"), first, last


def _finders(batch: pa.RecordBatch, finder: Finder) -> Iterator[Finder]:
    """For each row (src, id, text, rare_first, rare_last), ``finder`` or one that has the row's other names too."""
    for rare in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
        yield Finder(_Either(finder.first, frozenset(rare[0] or ())), _Either(finder.last, frozenset(rare[1] or ()))) if rare[0] or rare[1] else finder


def find(texts: DataFrame, first: frozenset[str], last: frozenset[str]) -> DataFrame:
    """(src, id, kind, votes, features, value) of every proposed span of ``texts`` (src, id, text, rare_first, rare_last)."""
    shared = texts.sparkSession.sparkContext.broadcast((first, last))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(*shared.value)
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for src, key, text, one in zip(*(batch.column(i).to_pylist() for i in range(3)), _finders(batch, finder), strict=True):
                for start, end, kind, votes, features in one.spans(text):
                    for column, x in zip(rows, (src, key, kind, packed(votes), features, plain(text[start:end])), strict=True):
                        column.append(x)
            types = (pa.string(), pa.int64(), pa.int8(), pa.int16(), pa.int16(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["src", "id", "kind", "votes", "features", "value"])

    return texts.mapInArrow(run, "src string, id bigint, kind tinyint, votes smallint, features smallint, value string")


def packed(votes: tuple[int, ...]) -> int:
    return sum(v << (2 * i) for i, v in enumerate(votes))


def unpacked(votes: int) -> tuple[int, ...]:
    return tuple((votes >> (2 * i)) & 3 for i in range(VOTES))


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """EM over vote patterns: posterior of each pattern, share of true spans, and P(vote | truth) as [labeler, truth, vote].

    Two classes, labelers independent given the class (an abstention carries no weight). Starts from labelers that are
    right nine times in ten, which also is a prior worth a few votes: it tells the classes apart and keeps a labeler that
    never votes no from becoming certain.
    """
    labelers = patterns.shape[1]
    start = np.zeros((labelers, 2, 3))
    start[:, 1, YES], start[:, 1, NO] = 0.9, 0.1
    start[:, 0, YES], start[:, 0, NO] = 0.1, 0.9
    theta, share = start.copy(), 0.5
    posterior = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        score = np.log(np.array([1 - share, share]))[None, :].repeat(len(patterns), 0)
        for k in range(labelers):
            voted = patterns[:, k] != ABSTAIN
            score[voted] += np.log(theta[k][:, patterns[voted, k]].T)
        posterior = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -50, 50)))
        weight = np.stack([1 - posterior, posterior], 1) * counts[:, None]
        share = float((weight[:, 1].sum() + 1) / (counts.sum() + 2))
        for k in range(labelers):
            for truth in (0, 1):
                mass = np.array([0.0, *(weight[patterns[:, k] == v, truth].sum() for v in (YES, NO))])
                prior = 10 * start[k, truth]
                theta[k, truth] = (mass + prior) / (mass + prior).sum()
                theta[k, truth, ABSTAIN] = 1
    return posterior, share, theta


def classifier(x: np.ndarray, soft: np.ndarray, counts: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression on soft labels (Newton steps); every pattern weighs as the root of its count, so rare ones are heard."""
    weight, w = np.sqrt(counts), np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - soft)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _design(votes: np.ndarray, features: np.ndarray) -> np.ndarray:
    columns = [np.ones(len(votes))]
    for k in range(votes.shape[1]):
        columns += [(votes[:, k] == YES).astype(float), (votes[:, k] == NO).astype(float)]
    columns += [((features >> b) & 1).astype(float) for b in range(4)]
    return np.stack(columns, 1)


def decide(counts: list[tuple[int, int, int, int]], threshold: float = 0.5) -> tuple[dict[tuple[int, int, int], float], dict[str, dict]]:
    """Probability of each (kind, votes, features) from rows (kind, votes, features, n), and what was learned per kind."""
    chances, learned = {}, {}
    for kind in sorted({row[0] for row in counts}):
        rows = [row for row in counts if row[0] == kind]
        votes = np.array([unpacked(row[1]) for row in rows])
        n = np.array([row[3] for row in rows], dtype=float)
        patterns, which = np.unique(votes, axis=0, return_inverse=True)
        posterior, share, theta = reliabilities(patterns, np.bincount(which.ravel(), weights=n))
        x = _design(votes, np.array([row[2] for row in rows]))
        w = classifier(x, posterior[which.ravel()], n)
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        for row, chance in zip(rows, p, strict=True):
            # Without a single labeler for it a span stays text, however common such spans are.
            chances[row[:3]] = float(chance) if YES in unpacked(row[1]) else 0.0
        learned[KINDS[kind]] = {"share": share, "labelers": {name: (float(theta[k, 1, YES]), float(theta[k, 0, NO])) for k, name in enumerate(LABELERS[KINDS[kind]])}}
    return {k: v for k, v in chances.items() if not math.isnan(v)}, learned


def _accepted(spans: DataFrame) -> tuple[list[tuple[int, int, int]], dict[str, dict]]:
    """The accepted (kind, votes, features): at most 5 * 3**5 * 2**4 of them."""
    rows = spans.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n")).collect()
    chances, learned = decide(sorted((r.kind, r.votes, r.features, r.n) for r in rows))
    return [k for k, p in chances.items() if p >= 0.5], learned


def texts_of(parsed: DataFrame, redacted: DataFrame) -> DataFrame:
    """(src, id, text) of both tables; null ids, null and empty texts hold nothing."""
    both = parsed.select(F.lit("parsed").alias("src"), "id", F.col("markdown").alias("text")).unionByName(redacted.select(F.lit("redacted").alias("src"), "id", "text"))
    return both.filter("id IS NOT NULL AND text <> ''")


def personal_data(texts: DataFrame, people: DataFrame) -> DataFrame:
    """(src, id, kind, value): distinct pieces of personal data of each record. Empty tables give an empty result."""
    spans = cut_lineage(find(*_named(texts, people)))
    accepted, _ = _accepted(spans)
    spark = texts.sparkSession
    chosen = spark.createDataFrame(accepted, "kind tinyint, votes smallint, features smallint")
    named = F.element_at(F.lit(list(KINDS)), F.col("kind") + 1)
    return spans.join(F.broadcast(chosen), ["kind", "votes", "features"]).filter("value <> ''").select("src", "id", named.alias("kind"), "value").distinct()


def redact(texts: DataFrame, people: DataFrame) -> DataFrame:
    """``texts`` (src, id, text) with text replaced: personal data by placeholders, the rest unchanged; and kinds, a map of the replacements per kind.

    Null and empty texts stay as they are, with no kinds. Repeated rows give repeated results.
    """
    named, first, last = _named(texts, people)
    names = texts.sparkSession.sparkContext.broadcast((first, last))
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int8()), ("votes", pa.int16()), ("features", pa.int16())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(*names.value)
        for batch in batches:
            rows = []
            for text, one in zip(batch.column(2).to_pylist(), _finders(batch, finder), strict=True):
                rows.append([(a, b, kind, packed(votes), features) for a, b, kind, votes, features in one.spans(text)] if text else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, spans_type)], names=["src", "id", "text", "spans"])

    # Texts are searched once; what was found is kept beside them until the votes are judged.
    marked = written(named.mapInArrow(search, "src string, id bigint, text string, spans array<struct<start:int,end:int,kind:tinyint,votes:smallint,features:smallint>>"))
    accepted, _ = _accepted(marked.filter("id IS NOT NULL").select(F.inline("spans")))
    good_of = texts.sparkSession.sparkContext.broadcast(frozenset(accepted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = good_of.value
        for batch in batches:
            texts_out, kinds_out = [], []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                kinds: dict[str, int] = {}
                if text:
                    parts, at = [], 0
                    for span in spans:
                        if (span["kind"], span["votes"], span["features"]) in good:
                            parts += [text[at : span["start"]], PLACEHOLDERS[KINDS[span["kind"]]]]
                            at = span["end"]
                            kinds[KINDS[span["kind"]]] = kinds.get(KINDS[span["kind"]], 0) + 1
                    text = "".join([*parts, text[at:]])
                texts_out.append(text)
                kinds_out.append(list(kinds.items()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts_out, pa.string()), pa.array(kinds_out, pa.map_(pa.string(), pa.int32()))], names=["src", "id", "text", "kinds"]
            )

    return marked.mapInArrow(run, "src string, id bigint, text string, kinds map<string,int>")
