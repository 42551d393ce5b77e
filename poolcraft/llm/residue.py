"""Template residue, filler and error pages instead of content (problem 6).

One pass of a multi-pattern automaton (Aho-Corasick) over the lower-cased text finds known phrases in several languages. What they mean depends on how much of the
text they cover:

* Error pages and script notices stand for a whole document. Their phrases, and beside them the small words such pages are made of, must cover most of the
  letters of the whole text, whatever its lines; phrases alone at least a part. So a sentence about "404 Not Found" in a CV is nothing, nor is a line that happens to say
  "denied.". In a longer text only a line that is a full notice counts.
* Template text and filler may sit in one line of a real document. A text is read in units: its lines, and the sentences of a line, without list, heading and
  quote marks. Delimited fields (``[Your Name]``, ``{{city}}``, ``%JOB_TITLE%``) count as matched when they name something a template asks its
  user for. A unit is residue when the matched letters are most of its letters, or when its words are pseudo-Latin, keys in a row or the same words over and over.

Only units around a match are looked at more closely; the rest of a text costs the automaton's pass and a look at repeated words.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of the letters of a unit, or of a whole page, that must be matched; share of a page's letters that phrases alone must cover.
COVERAGE, PAGE_CORE = 0.6, 0.3
#: Share of a line's letters, and words in phrases (without a status number), that make it a notice in a longer text.
NOTICE, NOTICE_WORDS = 0.9, 3

# What servers, browsers and script frameworks say, and what templates and layout fillers say. Digits are written 0 and match any run of digits;
# everything is lower case, apostrophes are straight.
PAGES = """
    0 not found|0 page not found|error 0|http error 0|http 0|status code 0|0 forbidden|0 unauthorized|0 bad request|0 gone|0 internal server error|internal server error|0 bad gateway|bad gateway|0 gateway timeout|0 gateway time-out|gateway timeout|gateway time-out|0 too many requests|0 service unavailable|service unavailable
    service temporarily unavailable|temporarily unavailable|the server encountered an internal error|the upstream|did not answer|too many requests|rate limit exceeded|request could not be satisfied|method not allowed|request timed out|proxy error|bandwidth limit exceeded
    the requested url|the requested file|the requested page|the requested resource|was not found on this server|could not be found|can't be found|cannot be found|page not found|file not found|nothing was found at this location|the page you requested|the page you are looking for|the page you were looking for|no longer exists|no longer available
    page can't be displayed|page cannot be displayed|this site can't be reached|this page isn't working|this webpage is not available|took too long to respond|refused to connect|having trouble finding that site|unable to connect|server not found|your connection is not private|dns address could not be found
    access denied|access to this page has been denied|access to this resource|you do not have permission|you don't have permission|permission to access|permission to view|directory listing of|you are not authorized|you have been blocked|forbidden
    your session has expired|session has timed out|session expired|please sign in|please log in|sign in again|log in again|login required|you must be logged in|redirecting in|you are being redirected|this link has expired|link is no longer valid|redirecting you
    something went wrong|an error occurred|an unexpected error|an error has occurred|unexpected error|fatal error|error establishing a database connection|database connection was refused|connection refused|connection timed out|could not connect|under maintenance|down for maintenance|scheduled maintenance|we'll be back soon
    traceback (most recent call last)|traceback:|unhandled exception|stack trace|exit status 0|conversion worker 0 stopped|error while rendering page|stream object missing|conversion failed|failed to load|could not be loaded|could not load|cannot be opened|could not be opened
    not supported by the viewer|file type of|preview of|preview is not available|no preview available|is not available|may be damaged or protected|file is damaged|file is corrupted|try again in 0 minutes|try again later|contact the operator|contact the administrator|contact your administrator|contact the webmaster
    seite nicht gefunden|seite wurde nicht gefunden|konnte nicht gefunden werden|wurde nicht gefunden|die angeforderte seite|die gewünschte seite|der angeforderte inhalt|ist nicht verfügbar|nicht mehr verfügbar|dieser link ist abgelaufen|zugriff verweigert|interner serverfehler|es ist ein fehler aufgetreten|ein fehler ist aufgetreten
    bitte versuchen sie es später|ihre sitzung ist abgelaufen|bitte melden sie sich|dienst nicht verfügbar|wartungsarbeiten|keine berechtigung
    página no encontrada|la página solicitada|la página que busca|no se ha encontrado|no se pudo encontrar|no existe|no se encuentra|error interno del servidor|acceso denegado|este enlace ha caducado|su sesión ha caducado|la sesión ha expirado|inténtelo de nuevo más tarde|no está disponible|ha ocurrido un error|se ha producido un error|en mantenimiento
    page introuvable|page non trouvée|la page demandée|la page que vous recherchez|n'existe pas|n'existe plus|n'est pas disponible|est introuvable|accès refusé|erreur interne du serveur|ce lien a expiré|votre session a expiré|une erreur est survenue|une erreur s'est produite|veuillez réessayer plus tard|en cours de maintenance
    pagina non trovata|la pagina richiesta|non esiste|accesso negato|errore interno del server|sessione scaduta|si è verificato un errore|página não encontrada|acesso negado|ocorreu um erro|não está disponível
    enable javascript|enable scripts|you need to enable|requires javascript|requires scripts|javascript is required|javascript is disabled|javascript is turned off|javascript is not enabled|javascript must be enabled|javascript has been disabled|javascript to be enabled|without javascript|turn on javascript|activate javascript|allow javascript|javascript and cookies|enable cookies|cookies are disabled
    javascript enabled|enable it to continue|turn them on and reload|please enable it|switch it on|scripts are blocked|scripts must be allowed|allow scripts|to view this document|to view this page|to run this app|to use this site|could not load the résumé viewer|we could not load
    checking your browser|checking if the site connection is secure|verify you are human|verifying you are human|before opening the file|before accessing|your browser does not support|browser is not supported|unsupported browser|outdated browser|update your browser|does not support scripting|does not support javascript|ddos protection by
    javascript ist deaktiviert|javascript ist ausgeschaltet|schalten sie javascript ein|aktivieren sie javascript|aktivieren sie es im browser|javascript aktivieren|javascript muss aktiviert sein|benötigt javascript|ihr browser unterstützt
    activez javascript|activer javascript|active javascript|active il javascript|le document ne peut pas s'afficher|javascript est désactivé|nécessite javascript|votre navigateur ne prend pas en charge
    habilite javascript|habilitar javascript|activar javascript|activa javascript|javascript está desactivado|javascript está deshabilitado|requiere javascript|su navegador no admite|para ver este documento
    abilita javascript|attiva javascript|javascript è disattivato|javascript è disabilitato|ative o javascript|habilite o javascript
    """
FILLER = """
    lorem ipsum|ipsum dolor|dolor sit amet|consectetur adipiscing|consectetur adipisicing|replace this text|replace this with|with a short summary of yourself|this is dummy content|dummy content|dummy text|used to show the layout|placeholder text|sample text|example text|this is a sample|this is placeholder
    sample bullet one|sample bullet two|sample bullet three|sample bullet|bullet point one|describe your responsibilities|describe your role|describe your experience|describe your achievements|responsibilities and results in this box|your text here|your text goes here|text goes here|type your text|type here|enter text here|insert text here|content goes here
    click here to edit|click to edit|click or tap here to enter text|click or tap to enter|click here to enter text|click here to add|company name here|job title here|your name here|city, state|todo: add|todo: replace|todo:|add numbers before sending|to be filled in|fill this in|fill in here
    write a short summary|add your summary here|add your text|add text here|delete this line|delete this text|remove this line|tbd
    blindtext|hier steht ihr text|hier text einfügen|text hier einfügen|beispieltext|platzhaltertext|texto de ejemplo|texto de relleno|escriba aquí|escribe aquí tu|texte d'exemple|texte de remplissage|votre texte ici|testo di esempio|testo segnaposto|texto de exemplo
    """
#: Small words of error pages and notices; beside a phrase they are covered too.
BESIDE = set("""
    error errors page pages request requested reference incident code status id ray server browser document file files oops sorry please again later site website app application viewer link url address
    because need the a an this that your you it is was are not to of on in for at and or we we're our can could be been has have with from by if then but back home now there
    contact quote wait seconds second minutes minute reload refresh retry continue support administrator operator webmaster hmm whoops ups looks like first end their permission view download sign go return click here turn switch
    vorgang bitte seite inhalt datei fehler der die das ist im sie es ein nicht zu und ihr ihre wir browser página solicitud por favor la el en su no se que puede para page demande veuillez votre le les il est pour pagina richiesta per favore
    """.split())  # fmt: skip

# Words of the usual pseudo-Latin filler (stems).
LATIN = """
    lorem ipsum dolor dolore amet consect adipis elit eiusmod tempor incididunt labor magna aliqu enim venia venit quis nostr exercitation ullam nisi commodo consequat
    duis aute irure reprehenderit volupta velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum
    perspiciatis perit unde omnis iste ista natus error errat accusantium laudantium totam aperiam eaque ipsa inventore veritatis architecto beatae vitae dicta explicabo sed sit sine fine tur et ut ad in
    """.split()  # fmt: skip

#: What a template asks for, as words of a delimited field.
FIELDS = set("""
    your name names first last middle full surname forename given family candidate applicant vorname nachname familienname nombre nombres apellido apellidos nom prénom prenom nome cognome
    phone telephone mobile cell number telefon telefonnummer teléfono telefono numéro email e mail adresse address dirección direccion street straße strasse plz ort stadt city ciudad ville town state zip postcode country location
    company companies firma empresa entreprise employer employers arbeitgeber organisation organization job title titles role roles position puesto stelle beruf cargo department
    degree degrees abschluss título titulo university universität universidad school college major field study graduation achievement achievements accomplishment metric metrics result results responsibility responsibilities skill skills summary headline profile objective
    insert add enter fill type replace write describe here hier aquí ici date dates datum fecha month months monat mes year years jahr año start end from to project projects xx xxx your's dein ihr ihre su tu in text linkedin url link website contact block endblock photo reference references certification language languages hobby hobbies interests salary of birth geburtsdatum firmenname einsetzen eintragen einfügen ausfüllen nacimiento fecha
    """.split())  # fmt: skip

_WORD = re.compile(r"[^\W\d_]+")
_FIELD = re.compile(
    r"\[\[?\s*([^\[\]\n]{2,}?)\s*\]\]?|\{[{%]?\s*([^{}\n]{2,}?)\s*[}%]?\}|<<?\s*([^<>\n]{2,}?)\s*>>?|«\s*([^«»\n]{2,}?)\s*»|@@\s*([^@\n]{2,}?)\s*@@"
    r"|\$\$?([A-Za-zÀ-ÿ][^$\n{}]+)\$|%%?([A-Za-zÀ-ÿ][^%\n]{2,})%|##?([A-Za-zÀ-ÿ][^#\n]{2,})#|\(\(\s*([^()\n]{2,}?)\s*\)\)|\(([^()\n]{2,}?)[ ,–-]+fill in\)|(_{4,}\s*\([^()\n]{2,}\))"
)
_NUMBER_FIELD = re.compile(r"(?<![\w%])(?:[xX]{1,3}|[nN]{2,3})\s?%")
_YOUR_HERE = re.compile(r"\b(?:type|insert|enter|add|write|put)\s+(?:your|the|a|an)?\s*([\w ]{2,30}?)\s+here\b|^\W*[\w ]{2,30} name here\b", re.I)
_LINE = re.compile(r"[\r\n\v\f\x1c-\x1e\x85  ]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\s*\|\s*")
_MARKS = re.compile(r"^(?:[\s>*+•–·|-]|#+(?=\s))*(?:\d+[.)]\s+)?|[\s*_|]+$")
_ITEM = re.compile(r"\s*(?:[-*+•–·]|\d+[.)])\s")
_TAG = re.compile(r"</?(?:html|body|noscript|div|p|title|h[1-6]|head|br|center|hr|span|pre|meta|style|script)\b[^<>]*>", re.I)
_ZEROS = {ord(d): "0" for d in "123456789"}
#: File names, paths, addresses and incident numbers, which differ from page to page.
_VARIABLE = re.compile(r"\S*(?:://|\.(?:pdf|docx?|odt|rtf|html?|php|aspx?|jsp)\b|/\S*\d)\S*|(?<!\w)(?=[0-9a-f-]*\d)[0-9a-f][0-9a-f-]{2,}(?!\w)|(?<!\w)tr\d\w*", re.I)
#: Marks without which no field can be there; they ride on the automaton's pass.
_HINTS = ("[", "{", "<", "«", "$", "%", "#", "@@", "((", "____", "fill in", " here")
_KEYS = {"asdf", "asd", "qwer", "qwerty", "jkl", "jklö", "blah", "bla", "foo", "bar", "baz", "xxx"}
#: Values of the automaton: the length of a phrase of pages, the same plus FILL for filler, 0 for a mark, STEM for a word that tells nothing alone.
FILL, STEM = 1 << 16, -1


@lru_cache(maxsize=1)
def automaton():
    """The automaton over all phrases, marks and stems of filler words."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrases, more in ((PAGES, 0), (FILLER, FILL)):
        for phrase in phrases.replace("\n", "|").split("|"):
            if phrase := phrase.strip():
                found.add_word(phrase, len(phrase) + more)
                # In a whole text, where digits aren't zeros, the longest part without one stands for the phrase.
                part = max(phrase.split("0"), key=len).strip()
                if "0" in phrase and part not in found:
                    found.add_word(part, 0)
    for mark in _HINTS:
        found.add_word(mark, 0)
    for word in (*LATIN, *_KEYS, "xxxx"):
        if len(word) > 3 and word not in found:
            found.add_word(word, STEM)
    found.make_automaton()
    return found


def _low(text: str) -> str:
    """Lower case with straight apostrophes; of the same length, or left as it is."""
    low = text.lower().replace("’", "'")
    return low if len(low) == len(text) else text


def _letters(text: str) -> int:
    return sum(map(len, _WORD.findall(text)))


def _repeated(words: list[str]) -> bool:
    """A few words over and over."""
    return len(words) >= 4 and len(set(words)) <= max(2, len(words) // 3)


def _filler_words(words: list[str]) -> bool:
    """A few words over and over, runs of one letter, keys in a row, or pseudo-Latin."""
    words = [w for w in words if len(w) > 1]
    if _repeated(words):
        return True
    if len(words) >= 3 and sum(len(set(w)) == 1 for w in words) >= 0.8 * len(words):
        return True
    if len(words) >= 3 and sum(w in _KEYS for w in words) >= 0.7 * len(words):
        return True
    latin = sum(any(w.startswith(stem) if len(stem) > 3 else w == stem for stem in LATIN) for w in words)
    return len(words) >= 4 and latin >= 0.6 * len(words)


def is_field(content: str) -> bool:
    """The content of a delimited field names only things that a template asks for."""
    if re.match(r"(?:block|endblock|if|for)\s", content):
        content = content.split(None, 1)[1]
    words = [w.lower() for w in _WORD.findall(re.sub(r"([a-zß-ÿ])([A-ZÀ-Þ])", r"\1 \2", content))]
    return bool(words) and all(w in FIELDS for w in words) and any(len(w) > 2 for w in words)


def _marked(plain: str, hit: bytearray) -> int:
    """Letters of ``plain`` where ``hit`` is set."""
    return sum(sum(hit[m.start() : m.end()]) for m in _WORD.finditer(plain))


def _covered(unit: str) -> float:
    """Share of the letters of ``unit`` that filler phrases and fields match."""
    plain = _TAG.sub(" ", unit)
    hit = bytearray(len(plain))
    for m in _FIELD.finditer(plain):
        content = next((g for g in m.groups() if g is not None), "")
        if is_field(content):
            hit[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    for m in _YOUR_HERE.finditer(plain):
        hit[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    for end, n in automaton().iter(_low(plain).translate(_ZEROS)):
        if n > FILL:
            hit[end + 1 - n + FILL : end + 1] = b"\1" * (n - FILL)
    plain = _VARIABLE.sub(lambda m: m[0] if any(hit[m.start() : m.end()]) else " " * len(m[0]), plain)
    total = _letters(plain)
    return _marked(plain, hit) / total if total else 0.0


def _page(text: str) -> tuple[float, float, int]:
    """Of a text's letters, the share that phrases of pages cover, the same with the small words beside them, and the words in phrases (a status number counts for all it takes)."""
    plain = _VARIABLE.sub(_blanked, _TAG.sub(lambda m: " " * len(m[0]), text))
    low = re.sub(r"0+", lambda m: "0" + " " * (len(m[0]) - 1), _low(plain).translate(_ZEROS))
    # Digits and blanks are drawn together as the phrases have them; ``at`` leads back to the letters.
    squeezed, at, last = [], [], " "
    for i, c in enumerate(low):
        c = " " if c.isspace() else c
        if c != " " or last != " ":
            squeezed.append(c)
            at.append(i)
        last = c
    hit, status = bytearray(len(plain)), False
    line = "".join(squeezed)
    for end, n in automaton().iter(line):
        if 0 < n < FILL:
            for i in range(end + 1 - n, end + 1):
                hit[at[i]] = 1
            status |= "0" in line[end + 1 - n : end + 1]
    total = _letters(plain)
    if not total or not any(hit):
        return 0.0, 0.0, 0
    core, words, beside = _marked(plain, hit), sum(any(hit[m.start() : m.end()]) for m in _WORD.finditer(plain)), 0
    for m in re.finditer(r"[^\W\d_]+(?:'[^\W\d_]+)?", _low(plain)):
        if m[0] in BESIDE and not any(hit[m.start() : m.end()]):
            beside += _letters(m[0])
    return core / total, (core + beside) / total, words + NOTICE_WORDS * status


def _blanked(m: re.Match) -> str:
    """Blanks in place of what differs from page to page; a number stays a number."""
    return "0" + " " * (len(m[0]) - 1) if m[0][-1].isalnum() and "." not in m[0] and "/" not in m[0] else " " * len(m[0])


def is_page(text: str) -> bool:
    """The whole text is an error page or a script notice; two words of a phrase are enough only where there is hardly anything else."""
    core, both, words = _page(text)
    return core >= PAGE_CORE and both >= COVERAGE and (words >= NOTICE_WORDS or core >= NOTICE)


def unit_is_residue(unit: str) -> bool:
    """One line or sentence is template text or filler."""
    unit = _MARKS.sub("", unit)
    if not unit:
        return False
    if _NUMBER_FIELD.search(unit):
        return True
    if _filler_words([w.lower() for w in _WORD.findall(unit)]):
        return True
    return _covered(unit) >= COVERAGE


def _is_notice(line: str) -> bool:
    """A line of a longer text is a notice in full: it starts like a sentence, and hardly a letter is left over."""
    core, both, words = _page(line)
    first = next((c for c in _VARIABLE.sub(" ", _TAG.sub(" ", line)) if c.isalpha()), "a")
    return core >= PAGE_CORE and both >= NOTICE and words >= NOTICE_WORDS and not first.islower()


def _tail(line: str) -> str:
    """What follows real content in a heading or contact line, from the first field or capitalised filler on."""
    starts = [m.start() for m in _FIELD.finditer(line) if is_field(next((g for g in m.groups() if g is not None), ""))]
    starts += [at for end, n in automaton().iter(_low(line)) if n > FILL and line[(at := end + 1 - n + FILL)].isupper()]
    first = min(starts, default=0)
    return line[first:] if first else ""


def is_residue(text: str | None) -> bool:
    """The text is or contains residue. Null, empty and blank texts aren't and don't; texts are read whole."""
    if not text:
        return False
    low = _low(text)
    spots, pages = [], 0
    for end, n in automaton().iter(low):
        # "%" and "#" only where a word follows: not in "33%." and "## Skills".
        if n or low[end] not in "%#" or low[end + 1 : end + 2].isalpha() or low[end - 1 : end] in ("x", "n"):
            spots.append((end, n))
            pages += 0 <= n < FILL
    # Even where every phrase had 80 letters there would have to be some for a page of this length.
    if pages and len(text) <= 400 + 400 * pages and is_page(text):
        return True
    start, k = 0, 0
    for m in (*_LINE.finditer(text), None):
        stop = m.start() if m else len(text)
        line, stems, close, notice = text[start:stop], 0, False, False
        while k < len(spots) and spots[k][0] < stop:
            n = spots[k][1]
            stems += n == STEM
            close |= n == 0 or n > FILL
            notice |= 0 < n < FILL
            k += 1
        start = m.end() if m else stop
        if not close and stems < 3:
            words = line.lower().split()
            if len(words) >= 4 and len(set(words)) <= max(4, len(words) // 2) and unit_is_residue(line):
                return True
        else:
            if unit_is_residue(line):
                return True
            sentences = _SENTENCE.split(line)
            if len(sentences) > 1 and any(unit_is_residue(s) for s in sentences):
                return True
            if not _ITEM.match(line) and (tail := _tail(line)) and unit_is_residue(tail):
                return True
        if notice and not _ITEM.match(line) and _is_notice(line):
            return True
    return False


def residue(text: Column) -> Column:
    """Boolean column: the text is or contains residue; false for null."""

    @F.arrow_udf("boolean")
    def judge(texts: pa.Array) -> pa.Array:
        return pa.array([is_residue(t) for at in range(0, len(texts), 500) for t in texts.slice(at, 500).to_pylist()], type=pa.bool_())

    return judge(text)


def residue_records(parsed: DataFrame, prechecks: DataFrame) -> DataFrame:
    """(src, id): distinct records to exclude. Null ids, texts, lists and matches aren't cases."""
    texts = parsed.filter("id IS NOT NULL AND markdown IS NOT NULL").select(F.lit("parsed").alias("src"), "id", F.col("markdown").alias("text"))
    matches = prechecks.filter("candidate_id IS NOT NULL").select(F.lit("prechecks").alias("src"), F.col("candidate_id").alias("id"), F.explode("placeholders.match").alias("text"))
    both = texts.unionByName(matches.filter("text <> ''"))
    return both.filter(residue(F.col("text"))).select("src", "id").distinct()
