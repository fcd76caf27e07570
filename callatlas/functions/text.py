"""Column functions that extract evidence from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns.
URL = r"(?i)https?://[^\s\"'<>]+"
IPV4 = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
#: A domain of a run of letters, digits, dots and hyphens: a match begins where the run does, and is tried once.
DOMAIN = r"(?<![A-Za-z0-9_.-])[.-]*+(\b[a-zA-Z0-9][a-zA-Z0-9.-]*\.[a-zA-Z]{2,}\b)"
BASE64 = r"^[A-Za-z0-9+/]{20,}={0,2}$"
TOKEN = r"[a-zA-Z0-9_.$]+"
QUOTED = r'"([^"]*)"'
FIELD = r"<([a-zA-Z0-9_.$]+):\s*java\.lang\.String\s+([A-Za-z_][A-Za-z0-9_]*)>"
#: Texts of platform fields.
FIELD_VALUES = {
    "android.provider.Settings.ACTION_ACCESSIBILITY_SETTINGS": "android.settings.ACCESSIBILITY_SETTINGS",
    "android.provider.Settings.ACTION_NOTIFICATION_LISTENER_SETTINGS": "android.settings.ACTION_NOTIFICATION_LISTENER_SETTINGS",
    "android.provider.Settings.ACTION_USAGE_ACCESS_SETTINGS": "android.settings.USAGE_ACCESS_SETTINGS",
    "android.provider.Settings.ACTION_MANAGE_OVERLAY_PERMISSION": "android.settings.action.MANAGE_OVERLAY_PERMISSION",
    "android.provider.Settings.ACTION_REQUEST_IGNORE_BATTERY_OPTIMIZATIONS": "android.settings.REQUEST_IGNORE_BATTERY_OPTIMIZATIONS",
    "android.provider.Settings.ACTION_MANAGE_UNKNOWN_APP_SOURCES": "android.settings.MANAGE_UNKNOWN_APP_SOURCES",
    "android.provider.Settings.ACTION_APPLICATION_DETAILS_SETTINGS": "android.settings.APPLICATION_DETAILS_SETTINGS",
}
KEYWORDS = ("dex", "payload", "update", "socket", "telegram", "c2", "command", "shell", "root", "accessibility", "overlay")


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def sorted_distinct(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def strip(text: Column) -> Column:
    """All white space at both ends goes, not only spaces."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def urls(text: Column) -> Column:
    return sorted_distinct(_all(text, URL))


def ipv4s(text: Column) -> Column:
    return sorted_distinct(_all(text, IPV4))


def is_version_like(ip: Column) -> Column:
    """First part 0 or above 223: rather a version number than an address."""
    first = F.substring_index(ip, ".", 1).try_cast("int")
    return first.isNull() | (first == 0) | (first > 223)


def addresses(text: Column) -> Column:
    return F.filter(ipv4s(text), lambda ip: ~is_version_like(ip))


def domains(text: Column) -> Column:
    return sorted_distinct(_all(text, DOMAIN, 1))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))


def is_base64(value: Column) -> Column:
    return value.rlike(BASE64)


def words_like(text: Column, pattern: str) -> Column:
    """White-space separated parts that match a pattern as a whole, sorted and distinct."""
    return sorted_distinct(F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w.rlike(pattern)))


def is_keyword(value: Column) -> Column:
    return F.lower(value).isin(*KEYWORDS)


def tokens(text: Column) -> Column:
    """Lower-case tokens of more than two characters, distinct, sorted."""
    return sorted_distinct(F.filter(_all(F.lower(text), TOKEN), lambda t: F.length(t) > 2))


def quoted(text: Column) -> Column:
    return _all(text, QUOTED, 1)


def field_values(stmt: Column) -> Column:
    """Texts of the platform fields that a statement reads."""
    known = F.create_map(*(F.lit(x) for pair in FIELD_VALUES.items() for x in pair))
    names = F.zip_with(_all(stmt, FIELD, 1), _all(stmt, FIELD, 2), lambda c, f: F.concat_ws(".", c, f))
    return F.filter(F.transform(names, lambda n: known[n]), lambda v: v.isNotNull())


def statement_strings(stmt: Column) -> Column:
    """Quoted texts of a statement and those of the fields it reads."""
    return F.array_distinct(F.concat(quoted(stmt), field_values(stmt)))


def likely_domain(value: Column) -> Column:
    return ~value.startswith(".") & ~F.lower(value).isin("example.com", "test.com", "localhost.local") & (F.length(value) >= 4)


def ascii_runs(content: Column, least: int = 4) -> Column:
    """Printable ASCII runs of binary content."""
    return _all(F.decode(content, "ISO-8859-1"), f"[\\x20-\\x7e]{{{least},}}")


def quote_regex(literal: Column) -> Column:
    return F.regexp_replace(literal, r"([\\\[\](){}.*+?^$|])", r"\\$1")


def has_indicator(text: Column, indicator: Column) -> Column:
    """An indicator within boundaries. A neighbour must not be a letter or digit; beside one without a slash, which is like a
    domain, nor a dot or hyphen."""
    low, quoted_ = F.lower(text), quote_regex(F.lower(indicator))
    domain = F.rlike(low, F.concat(F.lit(r"(^|[^a-z0-9.\-])"), quoted_, F.lit(r"($|[^a-z0-9.\-])")))
    path = F.rlike(low, F.concat(F.lit(r"(^|[^a-z0-9])"), quoted_, F.lit(r"($|[^a-z0-9])")))
    return F.when(F.contains(indicator, F.lit("/")), path).otherwise(domain)


def first_line_with(text: Column, query: Column) -> Column:
    return F.get(F.filter(F.split(text, r"\r\n|\n|\r"), lambda line: F.contains(line, query)), F.lit(0))


def strip_comments(source: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(source, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")


def statement_kind(stmt: Column) -> Column:
    s = strip(stmt)
    return (F.when(s.rlike(r"\b(virtual|static|special|interface|dynamic)invoke\b"), "invoke").when(s.startswith("if "), "if").when(s.startswith("goto "), "goto")
            .when(s.startswith("return"), "return").when(s.contains(" = "), "assign").otherwise("other"))


def invoked_signature(stmt: Column) -> Column:
    return F.nullif(F.regexp_extract(stmt, r"(<[^<>:]+: [^<>]+ (?:[^<>\s(]+|<(?:cl)?init>)\([^)]*\)>)", 1), F.lit(""))


def is_branch(stmt: Column) -> Column:
    s = strip(stmt)
    return s.startswith("if ") | s.startswith("switch ") | s.contains("lookupswitch") | s.contains("tableswitch")


def safe_id(text: Column) -> Column:
    """Characters that are safe in a path, at most 60."""
    return F.left(F.btrim(F.regexp_replace(text, "[^a-zA-Z0-9._-]+", "_"), F.lit("._-")), F.lit(60))


def first_integer(*values: Column) -> Column:
    return F.coalesce(*(v.try_cast("int") for v in values))


def tolerant_json(text: Column) -> Column:
    """VARIANT of a text: as it is, else within a fence, else from its first to its last brace or bracket."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    span = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.nullif(fenced, F.lit(""))), F.try_parse_json(F.nullif(span, F.lit(""))))
