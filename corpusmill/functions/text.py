"""Column functions over text. All of them are built-in expressions, so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Literal repairs, applied in this order.
PUNCTUATION = (
    ("—", "--"),
    ("–", "-"),
    ("“", '"'),
    ("”", '"'),
    ("‘", "'"),
    ("’", "'"),
    ("…", "..."),
    (" ", " "),
    ("â\u0080\u0099", "'"),
    ("â\u0080\u0098", "'"),
    ("â\u0080\u009c", '"'),
    ("â\u0080\u009d", '"'),
    ("â\u0080\u0094", "--"),
    ("â\u0080\u0093", "-"),
    ("â\u0080¦", "..."),
    ("î\u0088\u0084î\u0088\u0086", ""),
    ("\\n", "\n"),
)
# Kinds of a graph node, in the order in which a name is tried.
KINDS = ("ethic", "concept", "process", "axiom", "system")


def strip(text: Column) -> Column:
    """Without white space of any sort at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def repaired(text: Column) -> Column:
    """Smart punctuation and its misread bytes as ASCII, and literal backslash-n as a line end."""
    for old, new in PUNCTUATION:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"))


def terms(text: Column) -> Column:
    """Runs of letters, digits, underscores and hyphens, as written."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_-]+)"))


def whole_terms(text: Column) -> Column:
    """Those terms() of four or more letters a to z, in either case, and hyphens."""
    return F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_-])([A-Za-z-]{4,}+)(?![\p{L}\p{N}_-])"))


def parts(text: Column) -> Column:
    """Pieces between white space; an empty text has none."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """Four tokens for three words, rounded down."""
    return F.floor(F.size(parts(text)) * 4 / F.lit(3)).cast("long")


def slug(label: Column) -> Column:
    """Lower-cased, with - for every run of other characters than a-z and 0-9, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def title(text: Column, path: Column) -> Column:
    """The first line that begins with one # after white space, else the file's stem with spaces for - and _."""
    heading = F.when(F.contains(text, F.lit("# ")), F.regexp_extract(text, r"(?m)^[ \t]*# ([^\n]*)$", 1)).otherwise("")
    return F.when(F.length(heading) > 0, strip(heading)).otherwise(F.translate(stem(path), "-_", "  "))


def kind(path: Column, name: Column) -> Column:
    """The deepest folder that is a kind; else the first kind that a word of the stem or title begins with; else concept."""
    folders = F.reverse(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1))
    folder = F.get(F.filter(folders, lambda x: x.isin(*KINDS)), F.lit(0))
    both = F.lower(F.concat(stem(path), F.lit(" "), name))
    named = F.coalesce(*(F.when(both.rlike(rf"\b{k}"), F.lit(k)) for k in KINDS))
    return F.coalesce(folder, named, F.lit("concept"))


def questions(completion: Column) -> Column:
    """Questions of a completion: after each marker, up to the first question mark, without enumeration."""
    chunks = F.transform(F.split(completion, "[Qq]?>"), strip)
    cut = F.transform(F.filter(chunks, lambda c: c.contains("?")), lambda c: F.concat(F.substring_index(c, "?", 1), F.lit("?")))
    bare = F.transform(cut, lambda c: strip(F.regexp_replace(c, r"^\s*\d+[.)]?\s*", "")))
    return F.filter(bare, lambda q: (F.length(q) > 1) & q.endswith("?"))


def rating(reply: Column) -> Column:
    """The digit after RATING:, 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(reply, r"(?i)RATING:\s*([0-5])", 1), F.lit("")).cast("int"), F.lit(0))


def synthesis(reply: Column) -> Column:
    """Everything after SYNTHESIS:, empty without it."""
    return F.coalesce(strip(F.regexp_extract(reply, r"(?is)SYNTHESIS:\s*(.+)", 1)), F.lit(""))


def listed_terms(reply: Column) -> Column:
    """Terms that a model lists behind ##, a line each: stripped, ending with a letter, distinct in order."""
    found = F.transform(F.regexp_extract_all(reply, F.lit(r"##\s*([^\n]+)")), strip)
    return F.array_distinct(F.filter(found, lambda x: x.rlike(r"\p{L}$")))


def html_paragraphs(html: Column) -> Column:
    """The text of each p element up to its first tag that isn't strong, em, code or span."""
    plain = F.regexp_replace(html, r"(?i)</?(?:strong|em|code|span)(?:\s[^>]*)?>", "")
    return F.filter(F.transform(F.regexp_extract_all(plain, F.lit(r"<p(?:\s[^>]*)?>([^<]*)")), strip), lambda p: p != "")


def tokens(text: Column) -> Column:
    """The lower-cased text as words and what stands between them, in turn."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"))


def pairs(text: Column) -> Column:
    """Each two neighbouring words of the lower-cased text, with what stands between them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}_])(?=([\p{L}\p{N}_]+[^\p{L}\p{N}_]+[\p{L}\p{N}_]+))"))


#: A character of a word, and one that isn't.
WORD, OTHER = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"


def edges(text: Column, tight: bool, blank: bool = True) -> Column:
    """Each word of the lower-cased text with what stands before it, and after it, up to another word.

    tight: none with white space between, so that the distinct pieces between white space tell them. blank: those, too, that have
    nothing but white space between, as most words of a text do.
    """
    some = "" if blank else rf"(?!\s++{WORD})"
    before, after = F.lit(rf"(?<={WORD})({some}{OTHER}++{WORD}++)"), F.lit(rf"(?<!{WORD})({WORD}++{some}{OTHER}++)(?={WORD})")
    both = lambda x: F.concat(F.regexp_extract_all(x, before), F.regexp_extract_all(x, after))
    if not tight:
        return both(F.lower(text))
    pieces = F.array_distinct(F.split(F.translate(F.lower(text), "\t\n\x0b\f\r", "     "), " "))
    found = F.flatten(F.transform(F.filter(pieces, lambda x: x.rlike(rf"{WORD}{OTHER}+{WORD}")), both))
    # Most texts have none and need no pieces.
    return F.when(F.lower(text).rlike(rf"{WORD}[^\p{{L}}\p{{N}}_\t\n\x0b\f\r ]++{WORD}"), found).otherwise(F.array().cast("array<string>"))


#: Stand before and after each word of a marked text.
OPEN, CLOSE = "\u0001", "\u0002"


def marked(text: Column) -> Column:
    """The lower-cased text with a mark at either end of every word."""
    return F.regexp_replace(F.translate(F.lower(text), OPEN + CLOSE, "  "), r"([\p{L}\p{N}_]+)", OPEN + "$1" + CLOSE)


def wanted(label: Column) -> Column:
    """What marked(text) contains if label stands in text between word boundaries, in either case.

    At an end that is no word character, a boundary asks for a word beside it. One plain search decides: no pattern is
    compiled a row.
    """
    return F.concat(F.when(label.rlike(r"^[^\p{L}\p{N}_]"), CLOSE).otherwise(""), marked(label), F.when(label.rlike(r"[^\p{L}\p{N}_]$"), OPEN).otherwise(""))
