"""Scalar text functions as Column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.contracts import LABELS

#: White space as the sentence tools know it: Unicode spaces and the four ASCII separators.
WS = r"(?U)[\s\x1c-\x1f]+"


#: Fixed value: a page number between dashes.
PAGE_MARKER = r"[-\u2013\u2014]\s*\d+\s*[-\u2013\u2014]"


def squeeze_ends(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def squeeze(x: Column) -> Column:
    """Runs of white space to one space, outer white space off."""
    return F.trim(F.regexp_replace(x, WS, " "))


def with_value(x: Column, use) -> Column:
    """``use`` of the value of ``x``, which is evaluated once: a column put into an array function is evaluated anew for each element."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def normalize_sentence(x: Column) -> Column:
    """Lower case, everything but letters, digits, underscore and space to a space, white space squeezed."""
    return squeeze(F.regexp_replace(F.lower(x), r"(?U)[^\p{L}\p{N}_\s]+", " "))


def tokens(x: Column) -> Column:
    return F.filter(F.split(x, WS), lambda t: t != "")


def token_count(x: Column) -> Column:
    return F.size(tokens(x))


def length_bin(count: Column) -> Column:
    return F.when(count <= 12, "short").when(count <= 24, "medium").otherwise("long")


def stable_id(*parts: Column) -> Column:
    """16 hex digits of the SHA-1 of the parts joined by a bar."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def is_true(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin("1", "true", "t", "yes", "y"), F.lit(False)).cast("int")


def allowed_label(x: Column) -> Column:
    return F.when(F.trim(x).isin(*LABELS), F.trim(x))


def safe_int(x: Column) -> Column:
    """Truncated integer of a numeric text, else null."""
    d = F.trim(x).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < 2**31), d.try_cast("int"))


def integrity_flags(x: Column, min_tokens: int = 6) -> Column:
    """In check order: missing_terminal_punct, lowercase_start, short_sentence, page_fragment_like; empty text is short only."""
    s = squeeze_ends(F.coalesce(x, F.lit("")))
    flags = F.array_compact(
        F.array(
            F.when(~s.rlike(r"[.?!]$"), "missing_terminal_punct"),
            F.when(s.rlike(r"^\p{Ll}"), "lowercase_start"),
            F.when(token_count(s) < min_tokens, "short_sentence"),
            F.when(s.rlike(PAGE_MARKER), "page_fragment_like"),
        )
    )
    return F.when(s == "", F.array(F.lit("short_sentence"))).otherwise(flags)


def fragment_score(flags: Column) -> Column:
    return F.size(flags) / F.lit(4.0)


#: Company-name suffixes, stripped once each in this order.
SUFFIXES = (r"\s+inc\.?$", r"\s+corp\.?$", r"\s+corporation$", r"\s+ltd\.?$", r"\s+llc$", r"\s+plc$", r"\s+co\.?$", r"\s+company$", r"\s+holdings?$", r"\s+group$")


def clean_company(x: Column) -> Column:
    s = F.lower(F.coalesce(x, F.lit("")))
    for suffix in SUFFIXES:
        s = F.regexp_replace(s, suffix, "")
    return squeeze(F.regexp_replace(s, r"[^\p{L}\p{N}_\s]", ""))


def clean_org(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}_\s]", "")


def cik_padded(x: Column) -> Column:
    """Digits padded with zeros to ten; longer ones stay, none at all is null."""
    d = F.regexp_replace(x, r"[^0-9]", "")
    return F.when(F.length(d) > 0, F.when(F.length(d) < 10, F.lpad(d, 10, "0")).otherwise(d))


def cik_stripped(x: Column) -> Column:
    """Digits without leading zeros; a trailing ".0" counts as no digit; empty for none."""
    d = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), r"\.0$", ""), r"[^0-9]", "")
    return F.when(d == "", "").otherwise(F.coalesce(F.nullif(F.regexp_replace(d, "^0+", ""), F.lit("")), F.lit("0")))


#: A filing's file name, its quarter folder, suffixes of files derived from it.
FILING_NAME = r"(?i)(?:^|/)(\d{4})\d{4}_(10-[KQ](?:-A)?)_edgar_data_(\d+)_[^/]*\.txt$"
QUARTER_FOLDER = r"(?i)/QTR([1-4])/[^/]*$"
DERIVED_SUFFIXES = ("_ai_sentences.txt", "_classified.txt", "_scored.txt", "_scored_ai_sentences.txt")


def filing_parts(path: Column) -> Column:
    """year (of the file's date), quarter (of its folder), form, cik; null fields where the name doesn't match."""
    get = lambda i: F.nullif(F.regexp_extract(path, FILING_NAME, i), F.lit(""))
    quarter = F.nullif(F.regexp_extract(path, QUARTER_FOLDER, 1), F.lit(""))
    return F.struct(get(1).cast("int").alias("year"), F.when(get(1).isNotNull(), quarter).cast("int").alias("quarter"), F.upper(get(2)).alias("form"), get(3).alias("cik"))


def source_window(year: Column, first: int = 2021, last: int = 2024) -> Column:
    return F.when(year.between(first, last), "active_2021_2024").otherwise("historical_2000_2020")


#: Fama-French 12 buckets, first match wins; (code, name, inclusive SIC ranges).
FF12 = (
    (1, "NoDur", ((100, 999), (2000, 2399), (2700, 2749), (2770, 2799), (3100, 3199), (3940, 3989))),
    (2, "Durbl", ((2500, 2519), (2590, 2599), (3630, 3659), (3710, 3711), (3714, 3714), (3716, 3716), (3750, 3751), (3792, 3792), (3900, 3939), (3990, 3999))),
    (3, "Manuf", ((2520, 2589), (2600, 2699), (2750, 2769), (3000, 3099), (3200, 3569), (3580, 3629), (3700, 3709), (3712, 3713), (3715, 3715), (3717, 3749), (3752, 3791), (3793, 3799), (3830, 3839), (3860, 3899))),
    (4, "Enrgy", ((1200, 1399), (2900, 2999))),
    (5, "Chems", ((2800, 2829), (2840, 2899))),
    (6, "BusEq", ((3570, 3579), (3660, 3692), (3694, 3699), (3810, 3829), (7370, 7379))),
    (7, "Telcm", ((4800, 4899),)),
    (8, "Utils", ((4900, 4949),)),
    (9, "Shops", ((5000, 5999), (7200, 7299), (7600, 7699))),
    (10, "Hlth", ((2830, 2839), (3693, 3693), (3840, 3859), (8000, 8099))),
    (11, "Money", ((6000, 6999),)),
    (12, "Other", ()),
)


def ff12_code(sic: Column) -> Column:
    n = sic.cast("string").try_cast("double").try_cast("int")
    out = F.lit(12)
    for code, _, ranges in reversed(FF12[:-1]):
        hit = F.lit(False)
        for lo, hi in ranges:
            hit = hit | n.between(lo, hi)
        out = F.when(hit, code).otherwise(out)
    return out


def ff12_name(code: Column) -> Column:
    return F.get(F.array(*[F.lit(name) for _, name, _ in FF12]), code - 1)


def sic2(sic: Column) -> Column:
    """First two digits of a four-digit industry code as a number (truncated hundredths); null where it isn't a number."""
    n = sic.cast("string").try_cast("double").try_cast("int")
    return F.when(n.isNotNull(), F.floor(n / 100)).cast("int")


#: Fixed value: words that mark a sentence as an edge case.
EDGE_WORDS = r"(?i)\b(may|might|could|intend|plan|expect|future|transform|revolution|generative ai|risk|uncertain|aim|seek|hope)\b"


def edge_case(x: Column) -> Column:
    return F.coalesce(x.rlike(EDGE_WORDS), F.lit(False))


def strip_quotes(x: Column) -> Column:
    """Outer quotes off, then white space squeezed."""
    return squeeze(F.regexp_replace(squeeze_ends(x), "^[\"“”‘’']+|[\"“”‘’']+$", ""))


def validity_reason(x: Column, min_tokens: int = 6, min_chars: int = 30, max_non_letters: float = 0.6) -> Column:
    """The first failed check of a sentence, '' if none."""
    letters = F.length(F.regexp_replace(x, r"[^\p{L}]", ""))
    return (
        F.when(token_count(x) < min_tokens, f"tokens<{min_tokens}")
        .when(F.length(x) < min_chars, f"chars<{min_chars}")
        .when(~x.rlike(r"^[^A-Za-z]*[A-Z]"), "no_initial_cap")
        .when(~x.rlike("[.!?][)\\]\"'”’]*\\s*$"), "no_terminal_punct")
        .when(1 - letters / F.greatest(F.length(x), F.lit(1)) >= max_non_letters, "mostly_non_letters")
        .otherwise("")
    )


def looks_fragmented(x: Column) -> Column:
    """The seven-rule fragment heuristic of the data-quality sensors."""
    s = squeeze_ends(F.coalesce(x, F.lit("")))
    first_letter_low = s.rlike(r"^[^\p{L}]*\p{Ll}")
    return (s == "") | (token_count(s) < 5) | ~s.rlike("[.!?]$") | first_letter_low | s.rlike(r"^[(\[]?[a-z0-9][)\]]?\s") | s.rlike("[;:,]$")


#: Patterns of API keys.
SECRET_PATTERNS = (r"\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}\b", r"\bsk-ant-[A-Za-z0-9_-]{20,}\b")


def redact(x: Column) -> Column:
    for p in SECRET_PATTERNS:
        x = F.regexp_replace(x, p, "[REDACTED_SECRET]")
    return x


def has_secret(x: Column) -> Column:
    out = F.lit(False)
    for p in SECRET_PATTERNS:
        out = out | x.rlike(p)
    return F.coalesce(out, F.lit(False))


def command_stem(message: Column) -> Column:
    """Program name of "Step command failed: <command>", else the message, else "unknown"."""
    command = F.regexp_extract(message, r"Step command failed: \s*(\S+)", 1)
    program = F.coalesce(F.nullif(F.regexp_extract(command, r"([^/]+)/*$", 1), F.lit("")), command)
    return F.when(command != "", program).when(F.coalesce(message, F.lit("")) != "", message).otherwise("unknown")
