"""Sections of markdown texts, and their root paragraphs, each up to its first inline element that isn't emphasis, code or a span.

Lines between blank ones are joined first, so every block is one line. Blocks are told apart in one pass over the lines: fenced
code (fences on lines of their own), raw HTML up to the end of its first element, headings, rules, lists, quotes, definitions of
links, notes and abbreviations, and definition lists are no paragraphs; all else is. Inside a paragraph code spans and escapes
come first, then links, images and tags, then emphasis, whose marks go where they stand in pairs.

Defined cases: a null text has no paragraphs (null); an element that is never closed holds the rest of the text; marks, brackets
and tags that don't fit together are text. Attribute lists and markdown inside HTML aren't read.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from corpusmill.shipping import bounded

# Elements that make a block of raw HTML, elements without an end, and inline elements that are taken off.
BLOCK_ELEMENTS = frozenset(
    """address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr
    main menu nav ol p pre search section table ul canvas colgroup dd body dt group html iframe li legend math map noscript
    output object option progress tbody td tfoot th thead tr video script style summary center""".split()
)
EMPTY_ELEMENTS = frozenset(("hr",))
TAKEN_OFF = frozenset(("strong", "em", "code", "span"))

# Patterns of blocks and of inline marks.
FENCE = re.compile(r"(`{3,}|~{3,})[ ]*(?:\{[^\n]*\}|(?:\.?[\w#.+-]*[ ]*)?(?:hl_lines=(\"|').*?\2[ ]*)?)$")
NOT_PARAGRAPH = re.compile(r"#|(?:(?:-+ {0,2}){3,}|(?:_+ {0,2}){3,}|(?:\*+ {0,2}){3,})$|\d+\. |[*+-] |>")
NOTE = re.compile(r"\[\^([^\]]*)\]:")
ABBREVIATION = re.compile(r"\*\[([^\\]*?)\] ?: *(.*)$")
REFERENCE = re.compile(r"\[([^\[\]]*)\]: *(\S+) *(?:([\"']).*\3 *|\(.*\) *)?$")
DEFINITION = re.compile(r": {1,3}(.*)$")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s<>/@]*)((?:\s[^<>]*)?)>")

CODE = re.compile(r"(?<!\\)((?:\\\\)+)(?=`+)|(?<!\\)(`+)(.+?)(?<!`)\2(?!`)", re.S)
ESCAPED = re.compile(r"\\([\\`*_{}\[\]()>#+.!-])")
INLINE_TAG = re.compile(r"<(/?[a-zA-Z][^<>@ ]*(?: [^<>]*)?|!--(?:(?!<!--|-->).)*--)>", re.S)
AUTOLINK = re.compile(r"<((?:[Ff]|[Hh][Tt])[Tt][Pp][Ss]?://[^<>]*|[^<> !]+@[^@<> ]+)>")
ENTITY = re.compile(r"&(?:#[0-9]+|#x[0-9a-fA-F]+|[0-9a-zA-Z]+);")
ALONE = re.compile(r"(?:^|(?<=\s))(?:\*{1,3}|_{1,3})(?=\s|$)")
STARS = tuple(re.compile(p, re.S) for p in (r"(\*)\1{2}(.+?)\1(.*?)\1{2}", r"(\*)\1{2}(.+?)\1{2}(.*?)\1", r"(\*)\1(?!\1)([^*]+?)\1(?!\1)(.+?)\1{3}", r"(\*{2})(.+?)\1", r"(\*)([^*]+)\1"))
LINES = tuple(re.compile(p, re.S) for p in (r"(?<!\w)(_)\1{2}(.+?)\1(.*?)\1{2}(?!\w)", r"(?<!\w)(_)\1{2}(.+?)\1{2}(.*?)\1(?!\w)", r"(?<!\w)(_{2})(?!_)(.+?)(?<!_)\1(?!\w)", r"(?<!\w)(_)(?!_)(.+?)(?<!_)\1(?!\w)"))
#: Stand for an inline element, and for kept text by its number.
CUT, KEPT = "\ue000", "\ue001"


def joined(text: str) -> list[str]:
    """The blocks of lines between blank ones, a line each without white space at its ends."""
    blocks: list[list[str]] = [[]]
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if line := line.strip():
            blocks[-1].append(line)
        elif blocks[-1]:
            blocks.append([])
    return [" ".join(b) for b in blocks if b]


def unfenced(lines: list[str]) -> list[str]:
    """lines without fenced code; a fence that no equal line closes is text."""
    places: dict[str, list[int]] = {}
    for i, line in enumerate(lines):
        if line[:3] in ("```", "~~~") and not line.strip(line[0]):
            places.setdefault(line, []).append(i)
    out, i = [], 0
    while i < len(lines):
        found = FENCE.match(lines[i])
        ends = places.get(found[1], []) if found else []
        at = bisect.bisect_right(ends, i)
        if at < len(ends):
            i = ends[at]
        else:
            out.append(lines[i])
        i += 1
    return out


def element(lines: list[str], i: int) -> tuple[int, str, str] | None:
    """Where the raw element that begins line i ends: its last line, its text, and what follows it there. None: no raw element."""
    first = TAG.match(lines[i])
    if not first or first[2].lower() not in BLOCK_ELEMENTS or first[1]:
        return None
    name, depth, own = first[2].lower(), 0, []
    for k in range(i, len(lines)):
        for tag in TAG.finditer(lines[k]):
            if tag[2].lower() == name:
                depth += -1 if tag[1] else 0 if tag[3].endswith("/") or name in EMPTY_ELEMENTS else 1
                if depth <= 0:
                    return k, "\n\n".join([*own, lines[k][: tag.end()]]), lines[k][tag.end() :].strip()
        own.append(lines[k])
    return len(lines) - 1, "\n\n".join(own), ""


def raw_paragraph(own: str) -> str:
    """The text of a raw p element up to its first inner element; empty for other elements."""
    first = TAG.match(own)
    if first[2].lower() != "p":
        return ""
    inner = re.sub(r"</[pP]>$", "", own[first.end() :])
    bare = TAG.sub(lambda t: "" if t[2].lower() in TAKEN_OFF else CUT, re.sub(r"<!--.*?-->", "", inner, flags=re.S))
    return html.unescape(bare.split(CUT, 1)[0])


def blocks(lines: list[str]) -> Iterator[tuple[str, str]]:
    """What each block is, in order: paragraph, raw (text of a raw p), link, note, abbreviation (with their names), definition, other."""
    lines, i = list(lines), 0
    while i < len(lines):
        line = lines[i]
        if (raw := element(lines, i)) is not None:
            i, own, rest = raw
            yield ("raw", text) if (text := raw_paragraph(own)) else ("other", "")
            if rest:
                lines[i] = rest
                continue
        elif NOT_PARAGRAPH.match(line):
            yield "other", ""
        elif found := NOTE.match(line):
            yield "note", found[1]
        elif found := ABBREVIATION.match(line):
            yield "abbreviation", found[1].strip()
        elif found := REFERENCE.match(line):
            yield "link", found[1].strip().lower()
        elif DEFINITION.match(line):
            yield "definition", line
        else:
            yield "paragraph", line
        i += 1


def closing(text: str, at: int, left: str, right: str) -> int:
    """The place after the bracket that closes the one at place at; -1 if none does."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == left) - (text[i] == right)
        if depth == 0:
            return i + 1
    return -1


def unlinked(text: str, links: set[str], notes: set[str]) -> str:
    """text with links, images and marks of notes as CUT."""
    out, i = [], 0
    while (at := text.find("[", i)) >= 0:
        begin = at - 1 if at > i and text[at - 1] == "!" else at
        end = closing(text, at, "[", "]")
        name = text[at + 1 : end - 1]
        after = -1
        if end > 0 and name.startswith("^") and name[1:] in notes:
            begin, after = at, end
        elif end > 0 and text[end : end + 1] == "(":
            after = closing(text, end, "(", ")")
        if end > 0 and after < 0:
            second = re.compile(r" ?\[([^\]]*)\]").match(text, end)
            if second and (second[1].strip() or name).lower() in links:
                after = second.end()
            elif name.strip().lower() in links:
                after = end
        out.append(text[i : begin if after > 0 else at + 1] + CUT * (after > 0))
        i = after if after > 0 else at + 1
    return "".join([*out, text[i:]])


def unmarked(text: str, mark: str = "*", patterns: tuple[re.Pattern, ...] = STARS) -> str:
    """text without the marks of emphasis that stand in pairs."""
    out, i = [], 0
    while (at := text.find(mark, i)) >= 0:
        out.append(text[i:at])
        found = next((m for p in patterns if (m := p.match(text, at))), None)
        if found:
            out += [unmarked(part, mark, patterns) for part in found.groups()[1:]]
            i = found.end()
        else:
            out.append(mark)
            i = at + 1
    return "".join([*out, text[i:]])


def lead(line: str, links: set[str], notes: set[str], short: re.Pattern | None) -> str:
    """A paragraph's text up to its first element that isn't emphasis, code or a span."""
    kept: list[str] = []

    def keep(text: str) -> str:
        kept.append(text)
        return f"{KEPT}{len(kept) - 1}{KEPT}"

    line = line.replace(CUT, "").replace(KEPT, "")
    line = CODE.sub(lambda m: keep("\\" * (len(m[1]) // 2)) if m[1] else keep(m[3].strip()), line)
    line = ESCAPED.sub(lambda m: keep(m[1]), line)
    line = unlinked(line, links, notes)
    line = AUTOLINK.sub(CUT, line)
    line = INLINE_TAG.sub(lambda m: "" if m[1].startswith("!--") or m[1].lstrip("/").split(" ")[0].rstrip("/").lower() in TAKEN_OFF else CUT, line)
    line = ENTITY.sub(lambda m: keep(html.unescape(m[0])), line)
    line = ALONE.sub(lambda m: keep(m[0]), line)
    line = unmarked(unmarked(line), "_", LINES)
    if short is not None:
        line = short.sub(CUT, line)
    line = line.split(CUT, 1)[0]
    return re.sub(f"{KEPT}(\\d+){KEPT}", lambda m: kept[int(m[1])], line)


def leads(text: str) -> list[str]:
    """The texts of a document's root paragraphs; those that begin with an element have none."""
    found: list[tuple[str, str]] = []
    names: dict[str, set[str]] = {"link": set(), "note": set(), "abbreviation": set()}
    for what, own in blocks(unfenced(joined(text))):
        if what in names:
            names[what].add(own)
            continue
        if what == "definition":  # its term is the paragraph before; without anything before it is text
            if not found:
                what = "paragraph"
            elif found[-1][0] == "paragraph":
                found.pop()
        found.append((what, own))
    short = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, names["abbreviation"]), key=len, reverse=True)) + r")\b") if names["abbreviation"] else None
    texts = (own if what == "raw" else lead(own, names["link"], names["note"], short) for what, own in found if what in ("raw", "paragraph"))
    return [t for t in texts if t]


HEADING = re.compile(r"(#{1,6})\s+(.*)$")


def sectioned(text: str) -> list[dict]:
    """header, headers_path, content of what stands before, between and after the heading lines."""
    out: list[dict] = []
    header, above, lines = "Introduction", [], []
    for line in [*text.split("\n"), None]:
        found = HEADING.match(line) if line is not None else None
        if line is not None and not found:
            lines.append(line)
            continue
        out.append({"header": header, "headers_path": [name for _, name in above if name], "content": "\n".join(lines).strip()})
        if found:
            header, lines = found[2].strip(), []
            above = [h for h in above if h[0] < len(found[1])] + [(len(found[1]), header)]
    return out


def sections(text: Column) -> Column:
    """The sections of a markdown text, in order, empty ones too."""
    bounded(SparkSession.active())

    @F.pandas_udf("array<struct<header: string, headers_path: array<string>, content: string>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else sectioned(t))

    return found(text)


def paragraphs(text: Column) -> Column:
    """The root paragraphs of a markdown text."""
    bounded(SparkSession.active())

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else leads(t))

    return found(text)
