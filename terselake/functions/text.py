"""Scalar text functions as Spark columns (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: patterns, in Java syntax; `(?U)` makes \w, \b and \d Unicode-aware ----
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
TOKENS_PER_WORD = 1.3
CHARS_PER_TOKEN = 5
NUMBER = r"(?U)\d+(?:\.\d+)?"
IDENTIFIER = (
    r"(?U)\b(?:[A-Za-z_]\w*(?:\.\w+)+|[A-Za-z_][A-Za-z0-9_]*(?:_[A-Za-z0-9_]+)+|[a-z]+[A-Z]\w*|[A-Z][A-Z0-9]{2,}(?:_[A-Z0-9]+)*)\b"
)
FENCED = r"(?s)^```[^\n]*\n(.*?)\n?```$"
SECRETS = (
    r"(?i)\b(?:sk|gsk|xai|sk-or|sk-proj)[-_][A-Za-z0-9\-_]{12,}",
    r"\bAIza[0-9A-Za-z\-_]{20,}",
    r"(?i)\bBearer\s+[A-Za-z0-9\-._~+/]{12,}=*",
    r"(?<=[?&]key=)[A-Za-z0-9\-._~]{12,}",
)
PLACEHOLDER_KEY = r"(?i)^(?:\s*|your[-_ ].*|.*(?:placeholder|changeme|example|xxxx|<.*>).*|\.\.\.|todo)$"
TOO_LARGE = (
    "413", "request too large", "too large", "context length", "maximum context", "exceeds", "reduce the length",
    "too many tokens",
)
SETTLED = ("429", "401", "403", "404", "quota", "invalid api key", "credit", "billing", "not found")
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "eg", "ie", "fig", "no", "inc", "ltd", "co", "corp",
    "dept", "est", "al", "approx", "min", "max", "avg", "ref", "vol", "cf", "resp",
)
LOG_START = (
    r"(?U)^\s*(?:\[?\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}|\[?\d{2}:\d{2}:\d{2}[.,]?\d*\]?|[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
    r"|\[?(?:TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|FATAL|CRITICAL|SEVERE)\b|\{\".*\}\s*$|<\d+>)"
)
LOG_CONTINUES = r"(?U)^(?:\s+|Traceback|\s*at\s|\s*Caused by:|\s*\.\.\.\s*\d+\s+more|\s*File\s\")"
LOG_TRACE = r"(?U)^(?:Traceback \(most recent call last\)|\s*at\s+\S+|\s*Caused by:|\s*File\s\")"
LOG_LEVEL = r"(?U)\b(TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|FATAL|CRITICAL|SEVERE)\b"
TEMPLATE_RULES = (
    (r"(?U)\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<TS>"),
    (r"(?U)\b\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\b", "<TIME>"),
    (r"(?U)\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    (r"(?U)\b0x[0-9a-fA-F]+\b", "<HEX>"),
    (r"(?U)\b[0-9a-fA-F]{16,}\b", "<HASH>"),
    (r"(?U)\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b", "<IP>"),
    (r"(?U)[\w.+-]+@[\w-]+\.[\w.]+", "<EMAIL>"),
    (r"(?U)\b[A-Za-z][A-Za-z]*[-_][0-9a-fA-F]{4,}\b", "<ID>"),
    (r"(?Ui)(?<![-\w.])\d+(?:\.\d+)?(?:ms|s|kb|mb|gb|%)?\b", "<NUM>"),
)
TEMPLATE_MARKS = r"<(?:TS|TIME|UUID|HEX|HASH|IP|EMAIL|ID|NUM|STR|PATH)>"
ENTITY_PATTERNS = {
    "numbers": r"(?U)(?<![\w.])\d+(?:,\d{3})*(?:\.\d+)?(?![\w.]*[A-Za-z_])",
    "measurements": r"(?Ui)(?<![\w.])\d+(?:,\d{3})*(?:\.\d+)?\s?(?:ms|us|ns|s|m|h|d|kb|mb|gb|tb|kib|mib|gib|b|%|x|px|rps|qps|req/s)\b",
    "snake": r"(?U)\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b",
    "camel": r"(?U)\b[a-z]+[A-Z]\w*\b",
    "constants": r"(?U)\b[A-Z][A-Z0-9]{2,}(?:_[A-Z0-9]+)*\b",
    "signatures": r"(?U)\b(?:def|class|function|async\s+def|interface|struct|impl)\s+\w+|\b\w+\s*\([^)]*\)\s*(?:->|\{|:)",
    "dotted": r"(?U)\b\w+(?:\.\w+){1,}\b",
    "urls": r"(?U)https?://\S+|/(?:[\w.-]+/)+[\w.-]+|[\w.+-]+@[\w-]+\.[\w.]+",
    "proper_nouns": r"(?U)\b[A-Z][a-z]{2,}\b",
}
ENTITY_WEIGHTS = {
    "entities": 2.0, "signatures": 3.0, "numbers": 1.0, "measurements": 2.5, "identifiers": 1.0, "dotted": 0.75, "urls": 1.0,
    "proper_nouns": 0.5,
}
TERM = r"(?U)\b\w[\w.\-]*\b"
# ---- end of fixed values ----


def _s(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_matches(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(_s(c), F.lit(pattern))


def word_count(c: Column | str) -> Column:
    """Words and punctuation marks: what token estimates are made of; additive over pieces split at white space."""
    return count_matches(c, TOKEN)


def tokens_of(words: Column) -> Column:
    return F.greatest(F.lit(1), F.rint(words * F.lit(TOKENS_PER_WORD)).cast("int"))


def token_count(c: Column | str) -> Column:
    """Estimated tokens: 0 for an empty text, at least 1 for any other; null stays null."""
    return F.when(_s(c) == "", 0).otherwise(tokens_of(word_count(c)))


def token_list(c: Column | str) -> Column:
    return F.regexp_extract_all(_s(c), F.lit(TOKEN), F.lit(0))


def truncate(c: Column | str, limit: int) -> Column:
    """The text if it fits ``limit`` tokens, else its first characters at the estimate's rate."""
    text = _s(c)
    if limit <= 0:
        return F.when(text.isNotNull(), F.lit(""))
    return F.when(token_count(text) <= limit, text).otherwise(F.substring(text, 1, int(limit / TOKENS_PER_WORD * CHARS_PER_TOKEN)))


def squeeze(c: Column | str) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(_s(c), r"(?U)\s+", " "))


def preview(c: Column | str, width: int = 80) -> Column:
    flat = squeeze(c)
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.substring(flat, 1, width - 1), F.lit("…")))


def fact_form(c: Column | str) -> Column:
    """Lower case, single spaces, digit separators gone."""
    return F.translate(F.regexp_replace(F.lower(_s(c)), r"(?U)\s+", " "), ",_", "")


def fact_present(text: Column | str, alternatives: Column | str) -> Column:
    """Whether any alternative occurs: numbers not inside numbers, short words whole, others anywhere."""
    hay = fact_form(text)

    def one(alt: Column) -> Column:
        needle = fact_form(alt)
        literal = F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        number = F.concat(F.lit(r"(?U)(?<![\d.])"), literal, F.lit(r"(?!\d)"))
        word = F.concat(F.lit(r"(?U)(?<!\w)"), literal, F.lit(r"(?!\w)"))
        return F.when(F.trim(needle) == "", False).when(needle.rlike(r"(?U)^\d+$"), F.rlike(hay, number)).when(
            F.length(needle) <= 4, F.rlike(hay, word)
        ).otherwise(F.contains(hay, needle))

    return F.exists(_s(alternatives), one)


def numbers_in(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_s(c), F.lit(NUMBER), F.lit(0)))


def critical_tokens(c: Column | str) -> Column:
    """Identifiers and numbers that a rewrite has to keep."""
    return F.array_union(F.array_distinct(F.regexp_extract_all(_s(c), F.lit(IDENTIFIER), F.lit(0))), numbers_in(c))


def strip_fences(c: Column | str) -> Column:
    text = F.regexp_replace(_s(c), r"(?U)^\s+|\s+$", "")
    inner = F.regexp_extract(text, FENCED, 1)
    return F.when(text.rlike(FENCED), F.regexp_replace(inner, r"(?U)^\s+|\s+$", "")).otherwise(text)


def redact(c: Column | str, known: tuple[str, ...] = ()) -> Column:
    """Key-shaped strings, and known secrets of 12 or more characters, to ``[redacted]``."""
    out = _s(c)
    for pattern in SECRETS:
        out = F.regexp_replace(out, pattern, "[redacted]")
    for secret in known:
        if len(secret.strip()) >= 12:
            out = F.replace(out, F.lit(secret.strip()), F.lit("[redacted]"))
    return out


def is_placeholder_key(c: Column | str) -> Column:
    return F.coalesce(_s(c).rlike(PLACEHOLDER_KEY), F.lit(True))


def _any(c: Column | str, markers: tuple[str, ...]) -> Column:
    low = F.lower(_s(c))
    return F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(low, m))


def is_too_large(c: Column | str) -> Column:
    return _any(c, TOO_LARGE)


def is_retryable(c: Column | str) -> Column:
    return ~_any(c, SETTLED)


def infer_filename(c: Column | str) -> Column:
    """A name for pasted text, by its first 4,000 characters."""
    head = F.substring(_s(c), 1, 4000)
    lines = F.slice(F.filter(F.split(head, "\n"), lambda x: F.trim(x) != ""), 1, 40)
    log = r"^\s*\[?(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}|\d{2}:\d{2}:\d{2})|^\s*\[?(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL)\b"
    n = F.size(lines)
    return (
        F.when((n >= 3) & (F.size(F.filter(lines, lambda x: x.rlike(log))) >= n * 0.4), "pasted.log")
        .when(head.rlike(r"(?m)^\s*(def |class |from \s*\w+ import|import \w+)"), "pasted.py")
        .when(head.rlike(r"(?m)^\s*(function |const |let |export |import .* from )"), "pasted.js")
        .when(head.rlike(r"(?m)^#{1,6}\s+\S"), "pasted.md")
        .otherwise("pasted.txt")
    )


def log_template(c: Column | str) -> Column:
    """A record with its volatile fields replaced by their kinds."""
    out = F.regexp_replace(_s(c), r"(?U)^\s+|\s+$", "")
    for pattern, mark in TEMPLATE_RULES:
        out = F.regexp_replace(out, pattern, mark)
    return squeeze(out)


def log_level(c: Column | str) -> Column:
    level = F.regexp_extract(F.split_part(_s(c), F.lit("\n"), F.lit(1)), LOG_LEVEL, 1)
    return F.when(level != "", F.upper(level))


def looks_like_log(c: Column | str) -> Column:
    """Of the first 200 lines that aren't blank, three at least and two in five start a record."""
    lines = F.slice(F.filter(F.split(_s(c), "\n"), lambda x: ~x.rlike(r"(?U)^\s*$")), 1, 200)
    n = F.size(lines)
    return (n >= 3) & (F.size(F.filter(lines, lambda x: x.rlike(LOG_START))) >= n * 0.4)


def sentence_pieces(c: Column | str) -> Column:
    """Split after ``.``, ``!`` or ``?`` with closing quotes and white space; before abbreviations are joined again."""
    marked = F.regexp_replace(_s(c), "(?U)(?<=[.!?])([\"')\\]]*)\\s+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda x: ~x.rlike(r"(?U)^\s*$"))


def ends_in_abbreviation(c: Column) -> Column:
    word = F.replace(F.regexp_extract(c, "([A-Za-z](?:\\.?[A-Za-z])*)\\.[\"')\\]]*\\s*$", 1), F.lit("."), F.lit(""))
    return F.lower(word).isin(*ABBREVIATIONS) | word.rlike("^[A-Z]$")


def sentences(c: Column | str) -> Column:
    """Sentences of a text, pieces after an abbreviation or an initial joined with a space."""
    return F.aggregate(
        sentence_pieces(c),
        F.array().cast("array<string>"),
        lambda done, piece: F.when(
            (F.size(done) > 0) & ends_in_abbreviation(F.element_at(done, -1)),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit(" "), piece))),
        ).otherwise(F.concat(done, F.array(piece))),
    )


#: Whether a text may match one of ENTITY_PATTERNS: each match holds what is looked for here, which is found sooner.
_MAY_MATCH = {
    "numbers": lambda c: c.rlike(r"(?U)\d"),
    "measurements": lambda c: c.rlike(r"(?U)\d"),
    "snake": lambda c: F.contains(c, F.lit("_")),
    "camel": lambda c: c.rlike("[a-z][A-Z]"),
    "constants": lambda c: c.rlike("[A-Z][A-Z0-9]{2}"),
    "signatures": lambda c: F.contains(c, F.lit("(")) | c.rlike("def|class|function|interface|struct|impl"),
    "dotted": lambda c: c.rlike(r"(?U)\w\.\w"),
    "urls": lambda c: F.contains(c, F.lit("/")) | F.contains(c, F.lit("@")),
    "proper_nouns": lambda c: c.rlike("[A-Z][a-z]{2}"),
}


def entity_counts(c: Column | str) -> Column:
    """Counts of the patterns, as a struct; names aren't recognised without a model and count 0."""
    n = {k: F.when(may(_s(c)), count_matches(c, ENTITY_PATTERNS[k])).when(_s(c).isNotNull(), 0) for k, may in _MAY_MATCH.items()}
    return F.struct(
        F.lit(0).alias("entities"),
        n["signatures"].alias("signatures"),
        n["numbers"].alias("numbers"),
        n["measurements"].alias("measurements"),
        (n["snake"] + n["camel"] + n["constants"]).alias("identifiers"),
        n["dotted"].alias("dotted"),
        n["urls"].alias("urls"),
        n["proper_nouns"].alias("proper_nouns"),
    )


def entity_weight(counts: Column) -> Column:
    total = F.lit(0.0)
    for k, w in ENTITY_WEIGHTS.items():
        total = total + counts[k] * w
    return total


def register(spark: SparkSession) -> None:
    """The same functions for SQL, as session-level SQL functions without Python."""
    pattern = TOKEN.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION token_estimate(t STRING) RETURNS INT "
        f"RETURN IF(t = '', 0, greatest(1, CAST(rint(regexp_count(t, '{pattern}') * 1.3D) AS INT)))"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION squeeze_text(t STRING) RETURNS STRING RETURN trim(regexp_replace(t, '(?U)\\\\s+', ' '))"
    )
