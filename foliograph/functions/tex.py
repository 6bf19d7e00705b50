"""One text's TeX structure: masks, environments, displays, section commands, blocks. Plain functions, each linear in the text.

Masks keep lengths and newlines, so places in a masked text are places in the source. They are laid on in this order: comments,
bodies of literal environments, inline verbatim.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Collection
from typing import NamedTuple

#: Environments whose body is literal text.
LITERAL = [
    "verbatim", "verbatim*", "Verbatim", "Verbatim*", "BVerbatim", "LVerbatim", "SaveVerbatim", "lstlisting", "minted", "comment",
    "alltt", "filecontents", "filecontents*", "luacode", "luacode*", "pycode",
]
#: Levels of section commands.
LEVELS = {"chapter": 0, "section": 1, "subsection": 2, "subsubsection": 3}

_COMMENT = re.compile(r"(?<!\\)((?:\\\\)*)(%[^\n]*)")
_TOKEN = re.compile(r"\\(begin|end)\s*\{([^{}]*)\}")
_VERB = re.compile(r"\\verb\*?([^a-zA-Z\s\\])")
_DISPLAY = re.compile(r"\\\[|\$\$")
_SECTION = re.compile(r"\\(chapter|section|subsection|subsubsection)\b")
_FORMULA = {"$$": "$$", "$": "$", r"\(": r"\)", r"\[": r"\]"}
_BRACE_STEP = re.compile(r"\$\$|\$|\\\(|\\\[|[{}]")
_BRACKET_STEP = re.compile(r"\$\$|\$|\\\(|\\\[|[\[\]]")
_NOT_NEWLINE = re.compile(r"[^\n]")


class Pair(NamedTuple):
    name: str
    begin: int
    begin_end: int
    end: int
    end_end: int
    depth: int


class Section(NamedTuple):
    cmd: str
    title: str
    starred: bool
    level: int
    start: int
    end: int
    parent: int  # place in the list; -1 without one


class Block(NamedTuple):
    kind: str  # preamble, env, verbatim, displaymath, para
    name: str
    first: int
    last: int
    in_env: tuple[str, ...]


def newlines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def blank(text: str) -> str:
    return _NOT_NEWLINE.sub(" ", text)


def _blank_spans(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out += [text[at:s], blank(text[s:e])]
            at = e
    return "".join([*out, text[at:]])


def without_comments(text: str) -> str:
    """Comments blanked: a marker behind an even number of backslashes, to the end of its line."""
    return _COMMENT.sub(lambda m: m[1] + " " * len(m[2]), text)


def environments(text: str, literal: Collection[str] = LITERAL) -> tuple[list[Pair], list[tuple[str, int]], list[tuple[str, int]]]:
    """Pairs in order of their beginnings, openers left and closers refused (name and place), by a strict stack: a closer that
    doesn't fit the top pops nothing. In a literal environment only its own closer counts."""
    literal, stack, pairs, refused = set(literal), [], [], []
    for m in _TOKEN.finditer(text):
        name, opens = m[2], m[1] == "begin"
        top = stack[-1][0] if stack else None
        if top in literal:
            if opens or name != top:
                continue
        if opens:
            stack.append((name, m.start(), m.end()))
        elif top == name:
            _, s, e = stack.pop()
            pairs.append(Pair(name, s, e, m.start(), m.end(), len(stack)))
        else:
            refused.append((name, m.start()))
    return sorted(pairs, key=lambda p: (p.begin, p.end)), [(n, s) for n, s, _ in stack], refused


def without_inline_verbatim(text: str) -> str:
    """What ``\\verb`` quotes is blanked, its marks stay; the first one left open ends the search."""
    spans, at = [], 0
    while m := _VERB.search(text, at):
        end = text.find(m[1], m.end())
        if end < 0:
            break
        spans.append((m.end(), end))
        at = end + 1
    return _blank_spans(text, spans)


def masked(text: str, literal: Collection[str] = LITERAL) -> str:
    """All masks; newlines are LF."""
    plain = without_comments(newlines(text))
    bodies = [(p.begin_end, p.end) for p in environments(plain, literal)[0] if p.name in set(literal)]
    return without_inline_verbatim(_blank_spans(plain, bodies))


def displays(text: str) -> list[tuple[int, int]]:
    r"""Spans of ``\[..\]`` and ``$$..$$``, not nested; the first one left open ends the search."""
    out, at = [], 0
    while m := _DISPLAY.search(text, at):
        end = text.find("$$" if m[0] == "$$" else r"\]", m.end())
        if end < 0:
            break
        at = end + 2
        out.append((m.start(), at))
    return out


def _closing(text: str, at: int, steps: re.Pattern, opener: str) -> int:
    """The place behind the bracket that closes the one in front of ``at``; formulas are passed over. -1 without one."""
    depth = 1
    while m := steps.search(text, at):
        at = m.end()
        if m[0] in _FORMULA:
            end = text.find(_FORMULA[m[0]], at)
            if end < 0:
                return -1
            at = end + len(_FORMULA[m[0]])
            continue
        depth += 1 if m[0] == opener else -1
        if not depth:
            return at
    return -1


_SPACE = re.compile(r"\s*")


def sections(text: str) -> list[Section]:
    """Section commands with a balanced title, and the last one before each that is less deep."""
    out, stack = [], []
    for m in _SECTION.finditer(text):
        at = _SPACE.match(text, m.end()).end()
        starred = text.startswith("*", at)
        at = _SPACE.match(text, at + starred).end()
        if text.startswith("[", at):
            at = _closing(text, at + 1, _BRACKET_STEP, "[")
            if at < 0:
                continue
            at = _SPACE.match(text, at).end()
        title, end = None, at
        while at >= 0 and text.startswith("{", at):
            begin, at = at + 1, _closing(text, at + 1, _BRACE_STEP, "{")
            if at < 0:
                title = None
                break
            if title is None:
                title = text[begin : at - 1].strip()
            end, at = at, _SPACE.match(text, at).end()
        if title is None:
            continue
        level = LEVELS[m[1]]
        while stack and out[stack[-1]].level >= level:
            stack.pop()
        out.append(Section(m[1], title, starred, level, m.start(), end, stack[-1] if stack else -1))
        stack.append(len(out) - 1)
    return out


def line_starts(text: str) -> list[int]:
    return [0, *[m.end() for m in re.finditer("\n", text)]]


def preamble(text: str, pairs: list[Pair], starts: list[int]) -> tuple[int, int] | None:
    """First and last line in front of the document environment, without blank ones at the end; from the document class, if there is one."""
    document = next((p for p in pairs if p.name == "document"), None)
    if document is None:
        return None
    declared = text.find(r"\documentclass")
    first = bisect_right(starts, declared) if declared >= 0 else 1
    before = text[: starts[bisect_right(starts, document.begin) - 1]].rstrip()
    last = bisect_right(starts, max(0, len(before) - 1))
    return (first, last) if before and first <= last else None


def blocks(text: str, plain: str, pairs: list[Pair], shown: list[tuple[int, int]], literal: Collection[str] = LITERAL) -> list[Block]:
    """Blocks in order of their places: the preamble, paired environments, literal bodies, displays, and paragraphs.

    ``plain`` is the masked text. A line that is blank after masking ends a paragraph, and so does one where a paired
    environment begins or ends, which belongs to none itself. Displays take their lines whole; one that begins on a line of an
    earlier one joins it. ``in_env`` has the names of the environments around, and an environment's own, from outside in.
    """
    literal, starts = set(literal), line_starts(text)
    line_of = lambda at: bisect_right(starts, at)
    begins: dict[int, list[int]] = {}
    ends: dict[int, list[int]] = {}
    for k, p in enumerate(pairs):
        begins.setdefault(line_of(p.begin), []).append(k)
        ends.setdefault(line_of(p.end), []).append(k)
    shows = {}
    for s, e in shown:
        shows.setdefault(line_of(s), line_of(e - 1))
    head = preamble(plain, pairs, starts)
    out: list[Block] = [] if head is None else [Block("preamble", "", *head, ())]
    active: dict[int, str] = {}
    paragraph = hidden = covered = 0  # a paragraph's first line; lines up to which a literal body, a display reaches

    def around() -> tuple[str, ...]:
        return tuple(n for n in active.values() if n != "document")

    for number, line in enumerate(plain.split("\n"), 1):
        inside_head = head is not None and head[0] <= number <= head[1]
        event = not inside_head and number >= hidden and (number in begins or number in ends)
        opens_display = not inside_head and number >= hidden and number > covered and number in shows
        text_line = not inside_head and number >= hidden and number > covered and not event and not opens_display and line.strip() != ""
        if paragraph and not text_line:
            out.append(Block("para", "", paragraph, number - 1, around()))
            paragraph = 0
        if inside_head or number < hidden:
            continue
        if event:
            for k in begins.get(number, ()):
                active[k] = pairs[k].name
                if pairs[k].name in literal:
                    hidden = line_of(pairs[k].end)
                    out.append(Block("verbatim", pairs[k].name, number, hidden, around()))
            for k in ends.get(number, ()):
                out.append(Block("env", pairs[k].name, line_of(pairs[k].begin), number, around()))
                active.pop(k, None)
        if opens_display:
            covered = shows[number]
            out.append(Block("displaymath", "", number, covered, around()))
        elif text_line and not paragraph:
            paragraph = number
    if paragraph:
        out.append(Block("para", "", paragraph, len(starts), around()))
    return sorted(out, key=lambda b: b.first)


#: Environments whose body is a formula.
FORMULAS = [
    "equation", "equation*", "align", "align*", "gather", "gather*", "multline", "multline*", "eqnarray", "eqnarray*",
    "alignat", "alignat*", "flalign", "flalign*",
]


def formula_bodies(text: str, names: Collection[str] = FORMULAS) -> list[str]:
    """Bodies of formula environments in masked text, white space collapsed."""
    return [" ".join(text[p.begin_end : p.end].split()) for p in environments(text)[0] if p.name in set(names)]


#: Combining marks of accent commands; fixed by TeX and Unicode.
ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "c": "\u0327", "v": "\u030c", "H": "\u030b", "u": "\u0306"}
#: Stands for a formula in visible text.
SENTINEL = "\ufffc"
_UNIT = re.compile(
    r"\$\$.*?\$\$|(?<!\\)\$[^$\n]*\$|\\\[.*?\\\]|\\\(.*?\\\)"  # formulas
    r"|\\(?:begin|end)\s*\{[^{}]*\}(?:\[[^\]]*\])?|\\(?:label|ref|cite|index)\s*\{[^{}]*\}"  # nothing to see
    r"|\\(?P<accent>['`^\"~]|[cvHu](?![A-Za-z]))\s*\{?(?P<letter>[A-Za-z])\}?"
    r"|\\(?P<quoted>[%&#_{}$])|\\(?:[A-Za-z]+\*?\s?|[^A-Za-z])|[{}]|(?P<space>[~\s]+)|(?P<text>[^\\{}~\s$]+|\$)",
    re.S,
)


def visible(text: str) -> list[tuple[str, int]]:
    """What a reader sees of a masked text, with the place that each piece comes from: accents composed, a formula as one sign, white space as one
    blank, commands and braces left out."""
    import unicodedata

    out: list[tuple[str, int]] = []
    for m in _UNIT.finditer(text):
        if m["accent"]:
            out.append((unicodedata.normalize("NFC", m["letter"] + ACCENTS[m["accent"]]), m.start()))
        elif m["quoted"]:
            out.append((m["quoted"], m.start()))
        elif m["space"]:
            if out and out[-1][0] != " ":
                out.append((" ", m.start()))
        elif m["text"]:
            out.append((m["text"], m.start()))
        elif m[0].startswith(("$", r"\[", r"\(")):
            out.append((SENTINEL, m.start()))
    return out[:-1] if out and out[-1][0] == " " else out
