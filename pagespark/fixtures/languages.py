"""The four languages of the derived sample tables."""

import string

from pagespark.functions.text import build_language

# Letters added per language and the accents folded to a base letter.
GERMAN = "äöüÄÖÜß"
FRENCH = "àâçéèêëîïôûù"
SPANISH = "áéíóúñü¿¡"
FOLDED = {"a": "àáâä", "e": "èéêë", "i": "ìíîï", "o": "òóôö", "u": "ùúûü", "n": "ñ", "c": "ç"}
ASCII = string.ascii_letters + string.digits + string.punctuation

LANGUAGES = {
    "latin": build_language("latin", ASCII),
    "german": build_language("german", ASCII + GERMAN),
    "french": build_language("french", ASCII, {k: list(v) for k, v in FOLDED.items()}),
    "spanish": build_language("spanish", ASCII + SPANISH, {"n": ["ñ"], "u": ["ú", "ü"]}),
}


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"
