"""Word lists and cue patterns by language. The Italian ones are fixed values of the summary and audit rules."""

from __future__ import annotations

from dataclasses import dataclass

# Italian words that carry no content, for summaries and for the audit.
STOP_IT = (
    "anche che chi come con cosa da dal dalla dalle dei del della delle di e ed era essere gli ha hai hanno i il in io la le lo ma nel nella nelle non o per più quale quali quando "
    "questo questa questi queste se si sia sono su tra un una uno al alla alle ai agli dai dagli dopo prima poi molto molti molte ogni solo sua suo sue suoi loro può puo viene vengono"
).split()
AUDIT_STOP_IT = [w for w in STOP_IT if w not in ("hai", "io")] + ["dello", "degli"]
# Cues of definitions, data, lists, things to remember, and examples.
DEFINES_IT = ("è", "sono", "significa", "definisce", "consiste", "si intende", "indica", "chiamato", "chiamata")
DATA_IT = ("secolo", "anno", "anni", "formula", "teorema", "legge", "causa", "conseguenza", "eccezione", "classificazione")
LISTS_IT = ("primo", "secondo", "terzo")
REMEMBER_IT = ("definisce", "significa", "causa", "conseguenza", "legge", "formula", "teorema", "principale", "fondamentale", "eccezione")
CONNECTIVES_IT = ("mentre", "poiché", "perché", "quindi", "tuttavia", "inoltre")
EXAMPLES_IT = ("ad esempio", "per esempio", "esempio", "come nel caso", "si pensi")
# Cues of important sentences, by kind.
IMPORTANT_IT = (
    "si definisce|è definito|e definito|si intende per|significa|consiste in|indica|corrisponde a",
    "causa|cause|provoca|determina|comporta|conseguenza|conseguenze|deriva|dipende|perché|perche|poiché|poiche|pertanto|quindi",
    "si divide|si distinguono|comprende|include|classifica|classificazione|tipi|categorie|fasi|elementi|caratteristiche",
    "eccezione|eccezioni|eccetto|tranne|salvo|tuttavia|a differenza|invece|diversamente",
    "principio|principi|legge|leggi|teorema|formula|regola|regole|definizione|fondamentale|essenziale|necessario|necessaria|obbligatorio|obbligatoria",
)

STOP_OTHERS = (
    # English
    "the and for with that this from are was were has have had not but you all any can its our out who what when which will would there their they them then than into onto over under been being also such some each other only more most very "
    # French
    "les des une est dans pour par sur avec qui que pas plus sont aux ses son elle elles ils nous vous leur leurs cette ces mais comme tout tous entre sans sous être avoir fait "
    # German
    "der die das und ist nicht ein eine einer eines einem einen mit von den dem des auf für als auch sich sind wird werden wurde bei nach aus über unter zwischen oder aber wenn wie noch nur "
    # Spanish
    "los las una unos unas del por para con que como más pero sus este esta estos estas ese esa son fue ser está están entre sobre sin también muy todo todos cuando donde"
).split()


@dataclass(frozen=True)
class Lexicon:
    stop: tuple[str, ...]
    audit_stop: tuple[str, ...]
    defines: tuple[str, ...] = DEFINES_IT
    data: tuple[str, ...] = DATA_IT
    lists: tuple[str, ...] = LISTS_IT
    remember: tuple[str, ...] = REMEMBER_IT
    connectives: tuple[str, ...] = CONNECTIVES_IT
    examples: tuple[str, ...] = EXAMPLES_IT
    important: tuple[str, ...] = IMPORTANT_IT


ITALIAN = Lexicon(tuple(STOP_IT), tuple(AUDIT_STOP_IT))
#: The five languages that the queries meet.
MIXED = Lexicon(
    stop=tuple(dict.fromkeys(STOP_IT + STOP_OTHERS)),
    audit_stop=tuple(dict.fromkeys(AUDIT_STOP_IT + STOP_OTHERS)),
    defines=DEFINES_IT + ("is", "are", "means", "est", "signifie", "ist", "bedeutet", "es", "significa"),
    data=DATA_IT + ("century", "year", "law", "cause", "siècle", "loi", "jahr", "gesetz", "siglo", "año", "ley"),
    remember=REMEMBER_IT + ("means", "cause", "law", "signifie", "loi", "bedeutet", "gesetz", "ley"),
    connectives=CONNECTIVES_IT + ("while", "because", "however", "mais", "parce", "während", "jedoch", "porque"),
    examples=EXAMPLES_IT + ("for example", "par exemple", "zum beispiel", "por ejemplo"),
    important=IMPORTANT_IT + ("is|are|est|ist|es",),
)


def levels() -> dict[str, tuple[float, int, int, str]]:
    """Ratio of sentences, least, most, and the label of each summary level."""
    return {"approfondito": (0.76, 3, 10, "Approfondimento"), "studio": (0.55, 2, 7, "Metodo di studio"), "ripasso": (0.34, 1, 5, "Riassunto")}
