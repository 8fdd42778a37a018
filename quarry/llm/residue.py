"""Template residue, filler, error messages and script notices in place of content.

A multi-pattern automaton finds all phrases of all kinds and languages and all openings of template slots in one pass
over a text; the kind with the largest share of the text is reported where that share is high.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

# Phrases in lower case, digits written as #. A text made up of such phrases has no content of its own.
ERROR_PAGE = """
# not found|page not found|error # - |error #:|error # while|http error #|status code #|request # failed|the page you asked for|does not exist on this server
internal server error|the operation could not be completed|bad gateway|gateway timeout|the upstream gateway|sent an invalid reply
service temporarily unavailable|service unavailable|temporarily unavailable|please try again later|try again in a few minutes|please try again
access denied|forbidden|your session has expired|session expired|please sign in again|you do not have permission
something went wrong|our team has been told|an unexpected problem occurred|an unexpected error occurred|unexpected error|an error occurred|while loading this content|go back to the start page
traceback (most recent call last)|traceback:|keyerror|valueerror|typeerror|timeouterror|runtimeerror|nullpointerexception|exception in thread|null reference at|stack trace:|segmentation fault
timed out after|connection to the database|connection refused|connection reset|connection timed out|too many requests|"error":|"status": #|retry_after|rate limit reached|rate limit exceeded|quota exceeded
model is overloaded|was dropped from the queue|back-end fetch failed|backend fetch failed|<title>#</title>|maximum number of free views|you have reached the maximum
seite nicht gefunden|bitte prüfen sie die adresse|kehren sie zur startseite zurück|interner serverfehler|versuchen sie es später|zugriff verweigert|ihre sitzung ist abgelaufen|es ist ein fehler aufgetreten|dienst nicht verfügbar|zeitüberschreitung der anfrage
page introuvable|vérifiez l'adresse|revenez à l'accueil|erreur interne du serveur|réessayez plus tard|veuillez réessayer|accès refusé|votre session a expiré|une erreur est survenue|service indisponible
gateway time-out|upstream server did not|http status #|fatal error:|uncaught exception|unhandled exception|err_connection|err_name_not_resolved|dns_probe|core dumped|out of memory error|cuda out of memory|the requested url|could not be resolved on this server|this page isn't working|this site can't be reached|an internal error|server error in
connection was interrupted|page you are looking for|no longer exists on this server|request could not be processed|request timed out|maintenance mode|down for maintenance|we'll be back soon|your request was blocked|incident id:|ray id:|error code:|invalid api key|unauthorized (#)|# unauthorized|# forbidden|# bad request|exit code #|npm err!|undefined is not a function|cannot read properties of
wurde nicht gefunden.|konnte nicht verarbeitet werden|ein interner fehler|etwas ist schiefgelaufen|wartungsarbeiten|bitte versuchen sie es erneut|le serveur a rencontré|n'a pas pu être traitée|une erreur interne|page demandée n'existe pas|en cours de maintenance|un problème est survenu|temps d'attente dépassé|el servidor ha encontrado|no se pudo procesar|error inesperado|la página solicitada no existe|en mantenimiento|tiempo de espera agotado|algo salió mal
econnrefused|etimedout|is currently unavailable|session timed out|session has timed out|please log in again|fehler ist aufgetreten|laden sie die seite neu|erreur s'est produite|rechargez la page|ha ocurrido un error|recargue la página|vuelva a cargar la página
página no encontrada|compruebe la dirección|vuelva al inicio|error interno del servidor|inténtelo más tarde|inténtelo de nuevo|acceso denegado|su sesión ha caducado|se ha producido un error|servicio no disponible
"""
SCRIPT_NOTICE = """
please enable javascript|enable javascript to|enable javascript in your browser|javascript is disabled|javascript is required to|requires javascript to|you need to enable javascript|works best with javascript enabled|please turn on javascript
turn on scripts|scripts are required|scripts and cookies are required|scripts are switched off|scripts are disabled|activate them and reload|your browser does not support|browser does not support scripting|so this content cannot be shown
your browser blocked scripts|we're checking your browser|checking your browser before|enable cookies|<noscript>|</noscript>|in your browser to continue|please enable scripts
this site requires javascript|this page requires javascript|this application requires javascript|this website requires javascript|only with scripts enabled|javascript must be enabled to|javascript has been disabled|javascript needs to be enabled to|turn javascript on|allow scripts|enable js and|without javascript|javascript not detected|switch on javascript|cookies and javascript
javascript einschalten|schalten sie javascript ein|javascript wird benötigt|diese seite benötigt javascript|ohne javascript|ce site nécessite javascript|javascript est requis|javascript doit être activé|sans javascript|este sitio requiere javascript|javascript es necesario|debe habilitar javascript|sin javascript
aktivieren sie javascript|aktivieren sie bitte javascript|javascript ist deaktiviert|javascript muss aktiviert sein, um|um diese seite anzuzeigen|ihr browser unterstützt kein|skripte sind erforderlich
activer javascript|activez javascript|javascript est désactivé|pour afficher cette page|votre navigateur ne prend pas en charge|les scripts sont nécessaires
active javascript|activar javascript|habilite javascript|javascript está desactivado|en su navegador para ver|su navegador no admite|se necesitan scripts
"""
FILLER = """
lorem ipsum|dolor sit amet|consectetur|adipiscing elit|sed do eiusmod|tempor incididunt|ut labore et dolore|ut enim ad minim veniam|quis nostrud exercitation|ullamco laboris|duis aute irure|in reprehenderit|in voluptate velit|esse cillum|excepteur sint|occaecat cupidatat
placeholder copy|placeholder text|used only to show the layout|your content goes here|your text goes here|text goes here|content coming soon|sample text|replace this paragraph|with your own words|dummy text|filler text
sample question about|replace me|to be written later|question text goes here|insert text here|coming soon
blindtext|mustertext|platzhaltertext|hier steht später|der eigentliche inhalt|er zeigt nur, wie die seite|beispieltext
texte de remplissage|texte factice|à remplacer avant la publication|votre contenu ici|votre texte ici|faux texte
texto de relleno|texto de ejemplo|se debe sustituir antes de publicar|aquí va el contenido|su texto aquí|contenido de ejemplo
text will follow|content will follow|to be announced soon|this space intentionally left blank|this page intentionally left blank|nothing here yet|more text here|some text here|add your text|write something here|type your text here|test content|example text|exemple de texte|texte d'exemple|texte à venir|contenu à venir|texto provisional|próximamente|contenido próximamente|text folgt|inhalt folgt|fülltext|demnächst hier
the quick brown fox jumps over the lazy dog|hello world|asdf|jkl|qwerty|qwertz|xxxx|blah|bla bla|test test|foo bar
"""
PLACEHOLDER = """
todo:|fixme:|tbd:|xxx to be|to be completed by|insert your answer|enter your answer here|answer goes here|question goes here|antwort hier eintragen|hier die antwort|réponse à compléter|votre réponse ici|respuesta por completar|escriba aquí su respuesta
"""
SLOT_OPENINGS = ("%%", "#[", "{{", "{%", "${", "{", "<%", "<", "%(", "%s", "%d", "__", "[", "«", "xx,x", "xx.x")
SLOT = re.compile(
    r"""\{\{.{0,80}?\}\}|\{%.{0,80}?%\}|\$\{[^{}]{1,60}\}|\{(?:\d{1,2}|[^\W\d][\w.]{0,40})\}|<%.{0,80}?%>
    |<(?!/?(?:html|head|title|body|noscript|p|br|div|span|a|b|i|em|strong|ul|ol|li|h\d|table|tr|td|th|img|sub|sup|code|pre)\b)[^\W\d][^<>\n]{1,40}>
    |%\(\w+\)[sd]|(?<![\w%])%[sd](?!\w)|__[^\W\d_][^\W_]*(?:_[^\W_]+)*__|«[a-z]+(?:_[a-z]+)*»|(?<!\w)[Xx]{2,}[.,][Xx]+(?!\w)
    |\[(?:[^\W\d_a-zß-öø-ÿ]{3,}(?:[ _-][^\W\d_a-zß-öø-ÿ]+)*)\]
    |%%[^\W\d_][\w .-]{0,40}%%|\[\[[^\[\]\n]{1,60}\]\]|\#\[[^\[\]\n]{1,40}\]|_{2,}[^\W\d_][^\W_]*(?:[ _][^\W_]+){0,4}_{2,}
    |\[[^\[\]\n]{0,40}\b(?:insert|enter|your|add|fill|type|einfügen|eintragen|eingeben|ausfüllen|ihr|ihre|ihren|insérer|saisir|compléter|votre|indiquer|insertar|introducir|rellenar|completar|su|escriba)\b[^\[\]\n]{0,40}\]""",
    re.X | re.S,
)
#: Words that name a slot instead of leaving it unfilled ("the field {serial}").
NAMING = frozenset("field fields variable variables token tokens tag key column placeholder feld feldes variable platzhalter spalte champ champs balise campo campos etiqueta marcador".split())
KINDS = ("placeholder", "filler", "error_page", "script_notice")
#: Least share of a text. A slot counts as SLOT_CHARS characters at least, which its filling would have.
PHRASE_SHARE, SLOT_SHARE, SLOT_CHARS = 0.15, 0.05, 8

_DIGITS = re.compile(r"\d+")
_WORDISH = re.compile(r"[^\W_]+")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, lines in (("placeholder", PLACEHOLDER), ("filler", FILLER), ("error_page", ERROR_PAGE), ("script_notice", SCRIPT_NOTICE)):
        for p in lines.replace("\n", "|").split("|"):
            if p.strip():
                a.add_word(p.strip(), (kind, len(p.strip())))
    for o in SLOT_OPENINGS:
        a.add_word(o, ("slot", len(o)))
    a.make_automaton()
    return a


def _named(text: str, start: int, end: int) -> bool:
    before, after = _WORDISH.findall(text[max(0, start - 60) : start].lower())[-3:], _WORDISH.findall(text[end : end + 40].lower())[:1]
    return not NAMING.isdisjoint(before + after)


def kind_of(text: str | None) -> tuple[str, float] | None:
    """(kind, share of the text) of the residue that a text consists of, or None.

    Null, empty and blank texts have none. A text that names a slot ("the field {serial}") or speaks of an error or of
    scripts has none; a long text with one such phrase has too small a share.
    """
    if not text or not text.strip():
        return None
    low = _DIGITS.sub("#", text.lower())
    size = len(low.strip())
    spans: dict[str, list[tuple[int, int]]] = {}
    slots = False
    for end, (kind, n) in automaton().iter(low):
        start = end - n + 1
        if kind == "slot":
            slots = True
            continue
        if n <= 6 and low[start].isalnum() and start and low[start - 1].isalnum() and low[start - 1] != low[start]:
            continue
        spans.setdefault(kind, []).append((start, end + 1))
    share = {}
    for kind, s in spans.items():
        covered, upto = 0, 0
        for a, b in sorted(s):
            covered += max(0, b - max(a, upto))
            upto = max(upto, b)
        share[kind] = covered / size
    best = max(share, key=share.get) if share else None
    if slots:
        found = [m.span() for m in SLOT.finditer(text) if not _named(text, *m.span())]
        part = sum(max(SLOT_CHARS, b - a) for a, b in found) / size
        if found and part >= SLOT_SHARE and not (best and share[best] >= PHRASE_SHARE and share[best] >= part):
            return "placeholder", min(1.0, part)
    return (best, share[best]) if best and share[best] >= PHRASE_SHARE else None


def residue(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """row_id, residue, share: the rows whose text is residue instead of content, distinct.

    Null ids and texts have none; whole texts are read; repeated rows come out once, an empty table gives no rows.
    """
    ids = rows.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            got = [(i, *k) for i, t in zip(p.iloc[:, 0], p.iloc[:, 1]) if (k := kind_of(t))]
            yield pd.DataFrame(got, columns=["row_id", "residue", "share"])

    return rows.select(row_id, text).filter(rows[row_id].isNotNull() & rows[text].isNotNull()).mapInPandas(run, f"row_id {ids}, residue string, share double").distinct()
