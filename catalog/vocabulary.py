"""Phrases, patterns and cues the catalog queries look for."""

# phrase, language it speaks for, score
LANGUAGE_PHRASES = [
    ("the", "en", 1.0),
    ("of", "en", 1.0),
    ("and", "en", 1.0),
    ("to", "en", 0.875),
    ("is", "en", 0.875),
    ("that", "en", 1.0),
    ("it", "en", 0.875),
    ("with", "en", 1.0),
    ("in", "en", 0.5),
    ("in", "de", 0.5),
    ("der", "de", 1.0),
    ("und", "de", 1.0),
    ("von", "de", 1.0),
    ("zu", "de", 0.875),
    ("das", "de", 0.875),
    ("mit", "de", 1.0),
    ("des", "de", 0.5),
    ("des", "fr", 0.5),
    ("le", "fr", 1.0),
    ("et", "fr", 1.0),
    ("les", "fr", 1.0),
    ("du", "fr", 1.0),
    ("une", "fr", 1.0),
    ("de", "fr", 0.5),
    ("de", "es", 0.5),
    ("la", "fr", 0.5),
    ("la", "es", 0.5),
    ("en", "fr", 0.5),
    ("en", "es", 0.5),
    ("el", "es", 1.0),
    ("los", "es", 1.0),
    ("del", "es", 1.0),
    ("las", "es", 1.0),
    ("por", "es", 1.0),
    ("of the", "en", 1.0),
    ("de la", "fr", 0.5),
    ("de la", "es", 0.5),
    ("de los", "es", 1.0),
    ("in der", "de", 1.0),
    ("is licensed under", "en", 0.75),
    ("released under the mit license", "en", 0.75),
    ("licensed under the gnu general public license", "en", 0.75),
]

LANGUAGE_WORDS = {
    "en": ["the", "of", "and", "to", "is", "that"],
    "de": ["der", "die", "und", "den", "von", "zu"],
    "fr": ["le", "et", "les", "des", "du", "une"],
    "es": ["el", "los", "se", "del", "las", "por"],
}

MENTION_PATTERNS = {
    "EMAIL": "[0-9A-Za-z._]+@[0-9A-Za-z.]+[A-Za-z]",
    "IPV4": "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}",
    "PERCENT": "[0-9]+%",
    "CARDINAL": "[0-9]+",
    "PROPER": "[A-Z][a-z]+ [A-Z][a-z]+",
}

LANGUAGE_CUES = (
    ("ñ", "es"),
    ("ß", "de"),
    ("ü", "de"),
    ("ä", "de"),
    ("ê", "fr"),
    ("ç", "fr"),
    ("è", "fr"),
    ("th", "en"),
)

NAME_CUES = (("STANDARD", "N"), ("of large", "Y."), ("of old", "N"))

NUMBER_PATTERN = "[0-9]+"
NAME_PATTERN = "[A-Z][a-z]+ [A-Z][a-z]+"

SIZE_CATEGORIES = {"small ring": "jewel", "large ring": "jewel", "red plate": "dish", "blue plate": "dish"}

# levels of agreement per comparison of account records, and rounds of learning their weights
COMPARED = {"number": 3, "balance": 3, "digit": 2}
LEARNING_ROUNDS = 3

# letters a word needs before a spelling one edit away links it
LINKED_LETTERS = 6

# phrases a tagger is taught with
SHOWN = {
    "the": "ARTICLE",
    "der": "ARTICLE",
    "die": "ARTICLE",
    "le": "ARTICLE",
    "les": "ARTICLE",
    "el": "ARTICLE",
    "los": "ARTICLE",
    "with": "WORD",
    "und": "WORD",
    "released under the mit license": "LICENSE",
    "licensed under the gnu general public license": "LICENSE",
    "is licensed under cc by": "LICENSE",
}

# digests of ids run from 0 to 255: those below this number are held out, as many more set the leads
HELD_OUT = 51
LEAST_PROBABILITY = 0.6
