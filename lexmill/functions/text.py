"""String and Unicode functions. All but NFC and HMAC are built-in expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab as V

#: White space as a Unicode-aware split sees it.
SPACE = r"(?U)[\s\x1c-\x1f]+"
_WORD = "a-záéíóúñü"
_ASCII_PUNCT = r"!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def one_of(x: Column, values) -> Column:
    return x.isin(*values)


def split_words(text: Column | str) -> Column:
    """White-space tokens without empties; null gives an empty array."""
    return F.filter(F.split(F.coalesce(col(text), F.lit("")), SPACE), lambda t: t != "")


def tokenize(text: Column | str) -> Column:
    """Runs of letters of the two languages, or single characters outside them and white space."""
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(rf"(?iU)([{_WORD}]+|[^\s\x1c-\x1f{_WORD}])"), F.lit(1))


def words(text: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(rf"(?iu)([{_WORD}]+)"), F.lit(1)), F.lower)


def lexical_count(text: Column | str) -> Column:
    """White-space tokens with at least one letter."""
    return F.size(F.filter(split_words(text), lambda t: t.rlike(r"\p{L}")))


@F.pandas_udf(T.StringType())
def nfc(x: pd.Series) -> pd.Series:
    import unicodedata

    return x.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def is_nfc_safe(text: Column) -> Column:
    """No character that composition could change: then NFC is the identity and needs no UDF."""
    return ~text.rlike(r"[^\x00-\x{2FF}]")


def nfc_text(text: Column) -> Column:
    """The text in NFC; only a text that composition could change passes through the UDF."""
    safe = is_nfc_safe(text)
    return F.coalesce(F.when(safe, text), nfc(F.when(~safe, text)))


def normalize_token(raw: Column) -> Column:
    """X2 for text already in NFC (as it comes from ``nfc_text``): trim outer punctuation and separators, lower-case."""
    return F.lower(F.regexp_replace(raw, r"^[\p{P}\p{Z}]+|[\p{P}\p{Z}]+$", ""))


def lexical_tokens(text: Column | str) -> Column:
    """Normalized tokens that are no residue, event or scoped code and keep a letter."""
    raw = F.filter(split_words(nfc_text(col(text))), lambda t: ~(one_of(F.lower(t), V.RESIDUE) | t.startswith("&") | (t.startswith("[") & t.endswith("]")) | (t.startswith("(") & t.endswith(")"))))
    return F.filter(F.transform(raw, normalize_token), lambda t: t.rlike(r"\p{L}"))


def has_lexical_content(text: Column | str) -> Column:
    """F1."""
    def lexical(t: Column) -> Column:
        marked = one_of(F.lower(t), V.RESIDUE) | one_of(t, V.TERMINATORS) | t.startswith("&") | (t.startswith("[") & t.endswith("]")) | (t.startswith("(") & t.endswith(")"))
        return ~marked & F.regexp_replace(t, f"^[{_ASCII_PUNCT}]+|[{_ASCII_PUNCT}]+$", "").rlike(r"\p{L}")

    return F.exists(split_words(text), lexical)


def is_disfluency(surface: Column) -> Column:
    """F2."""
    return one_of(F.lower(F.trim(surface)), V.DISFLUENCIES)


def has_unresolved_control(text: Column | str) -> Column:
    """a control or format character, a bracket, or a token that starts with & or +."""
    t = F.coalesce(col(text), F.lit(""))
    return t.rlike(r"[\p{Cc}\p{Cf}]") | F.exists(split_words(t), lambda x: x.rlike(r"[\[\]<>]|^[&+]"))


def clean_surface(text: Column | str) -> Column:
    """Reviewed surface text in NFC; null without a letter. ``has_unresolved_control`` tells what to refuse."""
    t = F.regexp_replace(F.coalesce(nfc_text(col(text)), F.lit("")), "\x15[^\x15]*\x15", " ")
    t = F.regexp_replace(t, r"\[[<>]\]|\[//?\]|\[\s*(?:\?|=!?[ \t]+[^\[\]]*[^\[\]\s]|:[ \t]+[^\[\]]*[^\[\]\s]|-[ \t]+[^\[\]]*[^\[\]\s]|\+[ \t]+[^\[\]]*[^\[\]\s])\s*\]", " ")
    t = F.regexp_replace(t, "<([^<>]+)>", "$1")
    gone = lambda x: (
        one_of(F.lower(x), V.RESIDUE) | one_of(x, (*V.TERMINATORS, "[/]", "[//]", "[<]", "[>]", "+,")) | x.rlike(r"^\(\.{1,3}\)$|^&=|^&[+~].|^&[{}][ln]=\S+$")
    )
    kept = F.transform(F.filter(split_words(t), lambda x: ~gone(x)), lambda x: F.regexp_replace(x, r"(?U)^&-([\w\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+)$", "$1"))
    out = F.array_join(kept, " ")
    return F.when(out.rlike(r"\p{L}"), out)


def safe_ref(raw: Column, prefix: str, salt: Column | str = "") -> Column:
    """Prefix and 12 hex digits of SHA-1 over salt and value."""
    s = F.lit(salt) if isinstance(salt, str) else salt
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(F.concat_ws("\0", s, raw)), 1, 12))


def opaque_ref(raw: Column, domain: str, salt: Column | str = "") -> Column:
    """X11: domain and 16 hex digits of SHA-256 over domain, salt and value."""
    s = F.lit(salt) if isinstance(salt, str) else salt
    return F.concat(F.lit(domain + "_"), F.substring(F.sha2(F.concat_ws("\0", F.lit(domain), s, raw), 256), 1, 16))


def global_utterance_id(filename: Column, number: Column) -> Column:
    """X8."""
    return F.format_string("%s_%06d", filename, number)


def split_marker(line: Column) -> tuple[Column, Column]:
    """Marker and value around the first colon, both trimmed."""
    parts = F.split(line, ":", 2)
    strip = lambda x: F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return strip(parts[0]), F.coalesce(strip(F.get(parts, F.lit(1))), F.lit(""))


def first_language(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, "([A-Za-z]+)", 1), F.lit(""))


def percent(part: Column, whole: Column, digits: int = 4) -> Column:
    """Half-even percentage; 0 without a whole."""
    return F.when(whole > 0, F.bround(100.0 * part / whole, digits)).otherwise(0.0)


def hmac_hex(key: bytes):
    """A UDF of HMAC-SHA256 over a string, in hex."""

    @F.pandas_udf(T.StringType())
    def run(x: pd.Series) -> pd.Series:
        import hashlib
        import hmac

        return x.map(lambda t: None if t is None else hmac.new(key, t.encode(), hashlib.sha256).hexdigest())

    return run


def batches(tokens: Column, size: int = 256) -> Column:
    """Chunks of an array."""
    n = F.ceil(F.size(tokens) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(tokens, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))


def json_text(c: Column) -> Column:
    """A string as JSON with ASCII characters only, as canonical JSON has it; null as null."""
    code = F.ascii
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n.cast("long"))), 4, "0"))

    def one(ch: Column) -> Column:
        short = F.lit(None).cast("string")
        for raw, name in (("\b", "b"), ("\t", "t"), ("\n", "n"), ("\f", "f"), ("\r", "r"), ('"', '"'), ("\\", "\\")):
            short = F.when(ch == F.lit(raw), F.lit("\\" + name)).otherwise(short)
        n = code(ch)
        far = F.concat(unit(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), unit(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(0x3FF)))
        return F.coalesce(short, F.when((n >= 32) & (n <= 126), ch).when(n < 0x10000, unit(n)).otherwise(far))

    plain = c.rlike(r"\A[ !#-\[\]-~]*\z")
    return F.when(c.isNull(), "null").when(plain, F.concat(F.lit('"'), c, F.lit('"'))).otherwise(F.concat(F.lit('"'), F.array_join(F.transform(F.split(c, ""), one), ""), F.lit('"')))
