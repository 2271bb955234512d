"""Classification: token labels, utterance categories, screening, eligibility, roles, switches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as V
from . import text as X

_META = r"(?U)^\s*[\[<][^\n]*[\]>]\s*$|^\s*[A-Z][A-Z0-9_]*\s*:\s*$|^\s*%\w+:"
_PUNCT_ONLY = r"(?U)^[\s.,!?¿¡\-–—'\"…]*$"
_PUNCT_TOKEN = r"^[.,!?¿¡\-–—'\"…:;()\[\]{}<>%&/\\]+$"


def _list(values) -> Column:
    return F.array(*map(F.lit, values))


def classify(text: Column | str) -> Column:
    """Category of a raw utterance."""
    t = F.coalesce(X.col(text), F.lit(""))
    w = X.words(t)
    en, es = F.arrays_overlap(w, _list(V.ENGLISH_WORDS)), F.arrays_overlap(w, _list(V.SPANISH_WORDS))
    unknown = F.size(F.array_except(w, _list(V.ENGLISH_WORDS + V.SPANISH_WORDS + V.NEUTRAL_WORDS))) > 0
    return (
        F.when(t.rlike(_META), "metadata_or_noise").when(t.rlike(_PUNCT_ONLY) | (F.size(w) == 0), "punctuation_or_empty")
        .when(en & es, "cs_within_utterance").when(en, "en_only").when(es, "es_only")
        .when(F.arrays_overlap(w, _list(V.NEUTRAL_WORDS)) & ~unknown, "neutral_or_bivalent").otherwise("mixed_or_uncertain")
    )


def token_label(token: Column) -> Column:
    """C2."""
    w = F.lower(token)
    both = tuple(sorted(set(V.ENGLISH_WORDS) & set(V.SPANISH_WORDS)))
    word = (
        F.when(X.one_of(w, V.BIVALENT_WORDS + both), "eng&spa").when(X.one_of(w, V.ENGLISH_WORDS), "eng")
        .when(X.one_of(w, V.SPANISH_WORDS), "spa").when(X.one_of(w, V.NEUTRAL_WORDS), "neutral").otherwise("other")
    )
    return F.when(token.rlike("(?iu)^[a-záéíóúñü]+$"), word).when(token.rlike(_PUNCT_TOKEN), "punct").otherwise("other")


def langid_label(langid: Column, surface: Column, exact_mixed: bool = False) -> Column:
    """Label of a word from its source tag; ``exact_mixed`` is the frozen variant, where only three tags are mixed (C17)."""
    tag, s = F.trim(F.coalesce(langid, F.lit(""))), F.coalesce(surface, F.lit(""))
    mixed = X.one_of(tag, ("eng+spa", "spa+eng", "eng&spa+eng")) if exact_mixed else tag.contains("+")
    return (
        F.when(F.lower(F.trim(s)) == "www", "metadata").when(X.one_of(tag, ("eng", "spa", "eng&spa")), tag).when(tag == "www", "metadata")
        .when(tag == "999", F.when(s.rlike(r"(?U)^[^\w\s]+$"), "punct").otherwise("other")).when(mixed, "mixed_morpheme").otherwise("other")
    )


def category_of_labels(labels: Column) -> Column:
    """C4."""
    has = lambda x: F.array_contains(labels, x)
    return (
        F.when(has("metadata"), F.when(F.forall(labels, lambda x: x.isin("metadata", "punct")), "metadata_or_noise").otherwise("mixed_or_uncertain"))
        .when(F.forall(labels, lambda x: x == "punct"), "punctuation_or_empty").when(has("eng") & has("spa"), "cs_within_utterance")
        .when(has("eng"), "en_only").when(has("spa"), "es_only").when(has("mixed_morpheme") | has("other"), "mixed_or_uncertain").otherwise("neutral_or_bivalent")
    )


def neutralized(surfaces: Column, labels: Column) -> Column:
    """Labels with exact disfluencies made neutral."""
    return F.zip_with(surfaces, labels, lambda s, x: F.when(x.isin("eng", "spa") & X.is_disfluency(s), "neutral").otherwise(x))


def label_counts(labels: Column) -> dict[str, Column]:
    """P5: the nine stored counts."""
    n = lambda *names: F.size(F.filter(labels, lambda x: x.isin(*names)))
    return {
        "n_tokens_including_punctuation": F.size(labels),
        "n_word_tokens_excluding_punctuation": n("eng", "spa", "neutral", "eng&spa", "other", "mixed_morpheme"),
        "n_english_word_tokens": n("eng"), "n_spanish_word_tokens": n("spa"), "n_neutral_bivalent_word_tokens": n("neutral", "eng&spa"),
        "n_other_word_tokens": n("other"), "n_punctuation_tokens": n("punct"), "n_mixed_morpheme_word_tokens": n("mixed_morpheme"), "n_metadata_tokens": n("metadata"),
    }


def transitions(labels: Column) -> tuple[Column, Column]:
    """(eng to spa, spa to eng) between neighbours once other labels are dropped."""
    kept = F.filter(labels, lambda x: x.isin("eng", "spa"))
    pairs = F.zip_with(kept, F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 1, F.lit(0))), lambda a, b: F.concat_ws(">", a, b))
    return F.size(F.filter(pairs, lambda p: p == "eng>spa")), F.size(F.filter(pairs, lambda p: p == "spa>eng"))


def switch(previous: Column, current: Column) -> tuple[Column, Column]:
    """(is a switch, direction); null unless both have one language."""
    clear = previous.isin("en_only", "es_only") & current.isin("en_only", "es_only")
    return (
        F.when(clear, previous != current),
        F.when(clear & (previous != current), F.when(previous == "en_only", "eng_to_spa").otherwise("spa_to_eng")),
    )


def candidates(category: Column, neutral: bool = False, mixed: Column | None = None) -> Column:
    """C9."""
    none = F.array().cast("array<string>")
    out = none
    rules = dict(V.CATEGORY_ROLES) | ({"neutral_or_bivalent": ("MonoCont", "CsCont")} if neutral else {})
    for name, roles in rules.items():
        out = F.when(category == name, _list(roles)).otherwise(out)
    return out if mixed is None else F.when(mixed, F.filter(out, lambda x: x == "CsCont")).otherwise(out)


def screen(language: Column, empty: Column, foreign: Column, warning: Column, override: Column) -> Column:
    """Struct of outcome and reasons."""
    none = F.array().cast("array<string>")
    review = F.concat(F.when(foreign, _list(("ambiguous_foreign_material", "possible_code_switching"))).otherwise(none), F.when(warning, _list(("parser_warning",))).otherwise(none))
    made = lambda o, r: F.struct(F.lit(o).alias("outcome"), r.alias("reasons"))
    return (
        F.when(~language.isin("eng", "spa"), made("excluded", _list(("unsupported_language_label",)))).when(empty, made("excluded", F.concat(_list(("empty_or_nonlexical",)), review)))
        .when(F.size(review) > 0, made("needs_review", review)).when(override, made("clean", _list(("source_language_expected",))))
        .otherwise(made("needs_review", _list(("default_unscreened",))))
    )


def open_for_clean(decision: Column) -> Column:
    """F4."""
    return (decision["outcome"] != "excluded") & ~F.arrays_overlap(decision["reasons"], _list(V.BLOCKING_REASONS))


def combine(decision: Column, validated: Column) -> Column:
    """C7."""
    return F.when(decision["outcome"] == "excluded", "excluded").when(open_for_clean(decision) & validated, "clean").otherwise("needs_review")


def validation(language: Column, explicit: Column) -> Column:
    """Struct of a source-validation decision."""
    return F.struct(
        explicit.alias("is_validated"), language.alias("expected_language"), F.when(explicit, "explicit_override").otherwise("not_validated").alias("validation_method"),
        F.array(F.when(explicit, "explicit_source_validation").otherwise("not_validated")).alias("reason_codes"),
    )


def precode_eligibility(text: Column, expected: Column) -> Column:
    """Struct of category, reason and error from the language precodes of an utterance."""
    marks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)(\[\s*-[^\[\]]*\])"), F.lit(1))
    payload = F.transform(marks, lambda m: F.when(m.rlike(r"^\[-[ \t]+[^ \t\[\]][^\[\]]*\]$"), F.lower(F.trim(F.regexp_extract(m, r"^\[-[ \t]+([^\[\]]*)\]$", 1)))))
    codes = lambda p: F.transform(F.split(p, ","), lambda c: F.regexp_replace(c, r"^[ \t]+|[ \t]+$", ""))
    ambiguous = lambda p: p.isin("?", "und")
    fine = lambda p: ambiguous(p) | (
        p.rlike(r"^[a-z]{3}(?:[ \t]*,[ \t]*[a-z]{3})*$") & (F.size(codes(p)) == F.size(F.array_distinct(codes(p)))) & (F.size(F.array_except(codes(p), _list(V.LANGUAGE_CODES))) == 0)
    )
    error = F.exists(payload, lambda p: ~F.coalesce(fine(p), F.lit(False)))
    first = F.get(payload, F.lit(0))
    reason = (
        F.when(F.size(marks) > 1, V.EXCLUSION_REASONS[3]).when(F.size(marks) == 0, F.lit(None).cast("string")).when(ambiguous(first), V.EXCLUSION_REASONS[2])
        .when(F.array_contains(codes(first), "mul") | (F.size(codes(first)) > 1), V.EXCLUSION_REASONS[1]).when(codes(first)[0] != expected, V.EXCLUSION_REASONS[0])
    )
    reason = F.when(~error, reason)
    return F.struct(F.when(~error, F.when(reason.isNull(), "eligible_annotation_clean").otherwise("excluded")).alias("category"), reason.alias("reason"), error.alias("error"))


def source_roles(source: Column, eligible: Column) -> Column:
    """C10."""
    out = F.array().cast("array<string>")
    for name, roles in V.SOURCE_ROLES.items():
        out = F.when((source == name) & eligible, _list(roles)).otherwise(out)
    return out


def role_violations(source: Column, eligible: Column, roles: Column) -> Column:
    """C11: names of the rules that an assignment of roles breaks."""
    expected = source_roles(source, eligible)
    return F.array_compact(F.array(
        F.when(F.size(roles) != F.size(F.array_distinct(roles)), "duplicate_roles"),
        F.when(~eligible & (F.size(roles) > 0), "roles_without_eligibility"),
        F.when((F.size(F.array_except(roles, expected)) > 0) | (F.size(F.array_except(expected, roles)) > 0), "unexpected_roles"),
        F.when(F.arrays_overlap(roles, _list(V.EVIDENCE_ROLES)), "evidence_role"),
    ))


def coverage(flags: Column) -> dict[str, Column]:
    """C14 over an array of membership flags."""
    n, hit = F.size(flags), F.size(F.filter(flags, lambda x: x))
    return {"n_tokens": n, "n_covered": hit, "n_uncovered": n - hit, "outcome": F.when(n == 0, "no_lexical_tokens").when(n == hit, "all_covered").otherwise("has_uncovered")}
