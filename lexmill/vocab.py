"""Controlled vocabularies, in the order in which counts are reported."""

# They must equal the published schema for results to agree.
CATEGORIES = ("en_only", "es_only", "cs_within_utterance", "neutral_or_bivalent", "punctuation_or_empty", "mixed_or_uncertain", "metadata_or_noise")
LANGUAGE_CATEGORIES = CATEGORIES[:3]
EXCLUDED_CATEGORIES = CATEGORIES[3:]
CONDITIONS = ("CsCont", "EnglishMono", "MonoCont", "SpanishMono")
TOKEN_LABELS = ("eng", "spa", "eng&spa", "neutral", "punct", "other", "mixed_morpheme", "metadata")
SPLITS = ("train", "dev", "test")
POOL_SPLITS = ("train", "validation", "test")
SOURCES = {"callhome_eng": "eng", "callhome_spa": "spa"}
SCREENING_OUTCOMES = ("clean", "needs_review", "excluded")
EXCLUSION_REASONS = ("explicit_nonexpected_language", "explicit_mixed_language", "explicit_language_ambiguity", "conflicting_language_annotation")
BLOCKING_REASONS = ("parser_warning", "ambiguous_foreign_material", "possible_code_switching", "empty_or_nonlexical", "unsupported_language_label")
LANGUAGE_CODES = ("deu", "eng", "fra", "grn", "heb", "jpn", "mul", "pol", "spa", "und", "yid")
COVERAGE_OUTCOMES = ("all_covered", "has_uncovered", "no_lexical_tokens")
CATEGORY_ROLES = {
    "en_only": ("EnglishMono", "MonoCont", "CsCont"),
    "es_only": ("SpanishMono", "MonoCont", "CsCont"),
    "cs_within_utterance": ("CsCont",),
}
SOURCE_ROLES = {
    "callhome_eng": ("EnglishMono", "MonoCont-English", "CsCont-English-Monolingual-Filler"),
    "callhome_spa": ("SpanishMono", "MonoCont-Spanish", "CsCont-Spanish-Monolingual-Filler"),
}
EVIDENCE_ROLES = ("CsCont", "CsCont-Code-Switched-Evidence", "CsCont-Intrasentential-Switching-Evidence", "CsCont-Intersentential-Switching-Evidence", "CsCont-Mixed-Language-Evidence")

# Word lists of the toy annotator.
ENGLISH_WORDS = (
    "i", "the", "is", "are", "hello", "how", "you", "doing", "going", "go", "to", "for", "store", "want", "some", "coffee", "please",
    "dog", "ran", "fast", "yesterday", "friend", "school", "work", "today", "good", "morning", "thanks", "very", "much", "yes",
)
SPANISH_WORDS = (
    "el", "la", "es", "son", "un", "una", "hola", "como", "estas", "vas", "tienda", "quiero", "cafe", "café", "por", "favor", "perro",
    "corrio", "corrió", "rapido", "rápido", "muy", "ayer", "amigo", "escuela", "trabajo", "hoy", "buenos", "dias", "días", "gracias",
    "mucho", "si", "sí", "empanada", "fiesta",
)
NEUTRAL_WORDS = ("maria", "juan", "ok", "okay", "netflix", "wifi")
BIVALENT_WORDS = ("no", "a", "me")
DISFLUENCIES = ("um", "uh", "er", "erm", "hm", "hmm", "mm", "mhm", "mmhm", "mm-hm", "uh-huh", "uhuh")

# Transcript markers.
RESIDUE = ("xxx", "yyy", "www", "0")
TERMINATORS = ("+/.", "+//.", "+...", "+..?", "++", "+^", "+<", "+/?")
WORD_COLUMNS = ("word_id", "utterance_id", "location", "surface", "auto", "fix", "eng", "com", "speaker", "langid", "filename", "clause", "clauseno")

# Model input.
PAD, UNK, CLS, SEP, MASK = range(5)
VOCABULARY = 8000
LENGTH = 128
