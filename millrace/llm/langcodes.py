"""Names of languages: what the column lang may hold for each language that is told apart."""

from __future__ import annotations

import re

#: Two-letter code, three-letter codes, English and own name.
LANGUAGES = {
    "de": "deu ger german deutsch",
    "en": "eng english",
    "es": "spa spanish castilian español espanol",
    "fr": "fra fre french français francais",
    "it": "ita italian italiano",
    "nl": "nld dut dutch flemish nederlands",
    "pl": "pol polish polski",
    "pt": "por portuguese português portugues",
    "ru": "rus russian русский",
    "sv": "swe swedish svenska",
}
CODES = tuple(LANGUAGES)
_BY_NAME = {n: c for c, names in LANGUAGES.items() for n in (c, *names.split())}


def normal(lang: str | None) -> str | None:
    """The two-letter code of a language in another spelling (region, three letters, English or own name, case), or None."""
    if not lang:
        return None
    head = re.split(r"[-_.@ (]", lang.strip().casefold(), maxsplit=1)[0]
    return _BY_NAME.get(head)
