"""Markup residue: HTML, Markdown, wiki and LaTeX to clean text that keeps its structure.

Markup is stripped by rule, innermost first; what stands for itself in prose (comparisons, products,
amounts, paths, field names) matches no rule. The lines that remain go through a line-block distribution:
the length of a line is what it says outside of links, in letters and digits; lengths are summed over a sliding window
of lines, and lines are kept from a surge (the sum rises to the threshold) to the dive (it falls below). So runs of
lines that are nothing but links, before, after or far from text, are navigation and go; a line that says
anything stays, as do headings, lists, tables, code and formulas, and a body that is nothing but links.

A record has markup residue if its clean blocks are not the text it had: some block is more than plain text, or
visible characters went.

A body is one row, so the work is per row and moves no data; Python is used since nested markup is beyond
regular expressions on columns.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WINDOW = 3
SURGE = 1

#: What :func:`clean` gives, as columns.
RESULT = {
    "text": "string",
    "residue": "boolean",
    "marks": "int",
    "kinds": "array<string>",
    "blocks": "array<struct<kind:string,level:int,text:string>>",
    "notes": "array<string>",
}

_TAG = r"</?[A-Za-z][A-Za-z0-9:-]*(?:\s+[A-Za-z_:][-\w:.]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?>"
# Signs of structure at the begin of a line, and of a link's begin and end: no letter, no white space.
_L, _T, _C, _M = "\x02\x17", "\x02\x18", "\x02\x19", "\x02\x1a"
_KIND = {"\x17": "list", "\x18": "table", "\x19": "code", "\x1a": "formula"} | {chr(0x10 + n): "heading" for n in range(1, 7)}
_LINK, _LINK_END = "\x04", "\x05"


def _head(level: int) -> str:
    return "\x02" + chr(0x10 + min(6, max(1, level)))


# Commands of LaTeX that print nothing of their argument, and those that stand without braces.
_SILENT = "label|ref|eqref|pageref|cite|citep|citet|index|bibliography|includegraphics|vspace|hspace|input|include|usepackage|documentclass"
_BARE = "noindent|par|newline|newpage|clearpage|maketitle|tableofcontents|centering|hline|toprule|midrule|bottomrule|bigskip|medskip|smallskip|ldots|dots|LaTeX|TeX"
_ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307"}
_MATH_ENV = "equation|align|gather|multline|eqnarray|displaymath|math"


def _rx(pattern: str, flags: int = 0) -> re.Pattern:
    return re.compile(pattern, flags)


_FENCE = _rx(r"^ {0,3}(`{3,}|~{3,})[^\n]*\n(.*?)(?:^ {0,3}\1[`~]*[ \t]*$|\Z)", re.M | re.S)
_FENCE_LINE = _rx(r"^ {0,3}(?:`{3,}|~{3,})[^\n]*$", re.M)
_PRE = _rx(r"<(pre|syntaxhighlight|source)\b[^<>]*>(.*?)</\1\s*>", re.I | re.S)
_VERB = _rx(r"\\begin\{(verbatim|lstlisting|minted)\}(?:\[[^\]\n]*\])?(.*?)\\end\{\1\}", re.S)
_NOWIKI = _rx(r"<nowiki>(.*?)</nowiki>", re.I | re.S)
_MATHS = [
    _rx(r"<math\b[^<>]*>(.*?)</math\s*>", re.I | re.S),
    _rx(rf"\\begin\{{((?:{_MATH_ENV})\*?)\}}(.*?)\\end\{{\1\}}", re.S),
    _rx(r"\$\$(.+?)\$\$", re.S),
    _rx(r"\\\[(.+?)\\\]", re.S),
    _rx(r"^[ \t]*\$(?=[^\s$])([^$\n]*[^\s$\\])\$[ \t]*$", re.M),
]
_INLINE_MATH = [_rx(r"(?<![\w$\\])\$(?=[^\s$])([^$\n]*[^\s$\\])\$(?!\d)"), _rx(r"\\\((.+?)\\\)", re.S)]
_COMMENT = _rx(r"<!--.*?-->", re.S)
_COMMENT_OPEN = _rx(r"<!--")
_GONE = [
    _rx(r"<(script|style|noscript)\b[^<>]*>.*?</\1\s*>", re.I | re.S),
    _rx(r"__[A-Z]{3,}__"),
]
_REF = _rx(r"<ref\b[^<>/]*>(.*?)</ref\s*>", re.I | re.S)
_FRONT = _rx(r"\A---[ \t]*\n(?:[\w.-]+:[^\n]*\n)+---[ \t]*(?:\n|\Z)")
_HTML_HEAD = _rx(r"<h([1-6])\b[^<>]*>(.*?)</h\1\s*>", re.I | re.S)
_HTML_ROW = _rx(r"<tr\b[^<>]*>(.*?)(?=<tr\b|</tr|</table|\Z)", re.I | re.S)
_HTML_CELL = _rx(r"</t[dh]\s*>\s*(?=<t[dh]\b)", re.I)
_HTML_ITEM = _rx(r"<li\b[^<>]*>", re.I)
_HTML_IMG = _rx(r"<img\b[^<>]*?\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)')[^<>]*>", re.I | re.S)
_HTML_BLOCK = _rx(r"</?(?:p|div|table|ul|ol|li|tr|thead|tbody|section|article|blockquote|hr|br|dl|dt|dd)\b[^<>]*>", re.I)
_HTML_LINK = _rx(r"<a\b[^<>]*>([^<\n]*(?:<(?!/?a\b)[^<\n]*)*)</a\s*>", re.I)
_HTML_TAG = _rx(_TAG)
_ENTITY = _rx(r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});")
_AUTOLINK = _rx(r"<((?:https?|ftp|mailto):[^\s<>]+)>")

_TEX_HEAD = _rx(r"\\(part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?\s*\{([^{}\n]*)\}")
# Levels of LaTeX headings.
_TEX_LEVELS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6}
_TEX_TABULAR = _rx(r"\\begin\{(tabular[x*]?|array)\}(?:\{[^{}\n]*\})*(.*?)\\end\{\1\}", re.S)
_TEX_ITEM = _rx(r"\\item\b(?:\[[^\]\n]*\])?[ \t]*")
_TEX_ENV = _rx(r"\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\])?")
_TEX_HREF = _rx(r"\\href\s*\{[^{}]*\}\s*\{([^{}]*)\}")
_TEX_SILENT = _rx(rf"[ ~]?\\(?:{_SILENT})\*?(?:\[[^\]\n]*\])?\{{[^{{}}]*\}}")
_TEX_NOTE = _rx(r"[ ~]?\\footnote\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}")
_TEX_WRAP = _rx(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}")
_TEX_GROUP = _rx(r"\{\\[A-Za-z]+\s+([^{}]*)\}")
_TEX_ACCENT = _rx(r"\\(['`^\"~=.])(?:\{\\?([A-Za-z])\}|([A-Za-z]))")
_TEX_QUOTE = _rx(r"``([^`'\n]+)''")
_TEX_BARE = _rx(rf"\\(?:{_BARE})\b(?:\{{\}})?[ \t]*")
_TEX_ESC = _rx(r"~?\\([%&$#_{}])")

_TEMPLATE = _rx(r"\{\{([^{}]*)\}\}")
_TEMPLATE_OPEN = _rx(r"\{\{|\}\}")
_WIKI_LINK = _rx(r"\[\[([^\[\]]*)\]\]")
_WIKI_OPEN = _rx(r"\[\[(?=[^\[\]\n])|(?<=[^\[\]\n])\]\]")
_WIKI_URL = _rx(r"\[(?:https?|ftp)://\S+(?:[ \t]+([^\[\]\n]*))?\]")
_WIKI_HEAD = _rx(r"^[ \t]*(={1,6})(?!=)[ \t]*(\S[^\n]*?)[ \t]*\1[ \t]*$", re.M)
_WIKI_TABLE = _rx(r"^[ \t]*(?:(?:\{\||\|\}|\|\+)[^\n]*|\|-+[^|\n]*)$", re.M)
_WIKI_CELL = _rx(r"^[ \t]*[|!](?![|\-}+])[ \t]*([^\n]*)$", re.M)
_WIKI_QUOTE = _rx(r"'{2,5}([^'\n]+(?:'[^'\n]+)*)'{2,5}")

_MD_IMAGE = _rx(r"!\[([^\[\]\n]*)\]\([^()\n]*\)")
_MD_LINK = _rx(r"\[([^\[\]\n]*)\]\([^()\n]*\)")
_MD_REF = _rx(r"\[([^\[\]\n]+)\]\[[^\[\]\n]*\]")
_MD_DEF = _rx(r"^ {0,3}\[[^\]\n]+\]:[ \t]*\S[^\n]*$", re.M)
_MD_NOTE = _rx(r"\[\^[^\]\s]+\]:?")
_MD_ATX = _rx(r"^ {0,3}(#{1,6})[ \t]+(\S[^\n]*?)[ \t]*#*[ \t]*$", re.M)
_MD_SETEXT = _rx(r"^(?!\x02)([^\s][^\n]*)\n {0,3}(={2,}|-{2,})[ \t]*$", re.M)
_MD_QUOTE = _rx(r"^ {0,3}(?:>[ \t]?)+(?=\S)", re.M)
_MD_RULE = _rx(r"^ {0,3}(?:-{3,}|\*{3,}|_{3,}|={4,})[ \t]*$", re.M)
_MD_TABLE_RULE = _rx(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*\|(?:[ \t:|-]*)$", re.M)
_MD_ROW = _rx(r"^[ \t]*\|(.+?)\|[ \t]*$", re.M)
_MD_ITEM = _rx(r"^([ \t]*)(?:[*#]{1,6}|[-+]|(\d{1,9}[.)]))[ \t]+(?:\[[ xX]\][ \t]+)?(?=\S)", re.M)
_MD_CODE = _rx(r"(`{1,2})(?!`)([^`\n]+)\1(?!`)")
_MD_ESC = _rx(r"\\([*_`\[\]~|>!])")
_EMPHASIS = [
    _rx(r"(?<![\w*\\])(\*{1,3})(?=[^\s*])([^*\n]*[^\s*\\])\1(?![\w*])"),
    _rx(r"(?<![\w\\])(_{1,3})(?=[^\s_])([^\n]*?[^\s\\_])\1(?!\w)"),
    _rx(r"()~~(?=\S)([^~\n]*\S)~~"),
    _rx(r"()==(?=[^\s=])([^=\n]*[^\s=])==(?!=)"),
]
_PLAIN = _rx(r"[<&*_`~=\[\]#>|'$\\{}+]|^[ \t]*(?:-|\d{1,9}[.)])|^ {0,3}-{2}", re.M)
# What a text must have for a rule to match: looked for first, as that is quick.
_NEEDS = {
    rule: marks
    for marks, rules in {
        ("---",): [_FRONT],
        ("```", "~~~"): [_FENCE, _FENCE_LINE],
        ("<",): [_PRE, _NOWIKI, _MATHS[0], _COMMENT, _COMMENT_OPEN, _GONE[0], _REF, _AUTOLINK, _HTML_LINK, _HTML_HEAD, _HTML_ROW, _HTML_ITEM, _HTML_IMG, _HTML_BLOCK, _HTML_TAG],
        ("&",): [_ENTITY],
        ("$",): [_MATHS[2], _MATHS[4], _INLINE_MATH[0]],
        ("\\",): [_VERB, _MATHS[1], _MATHS[3], _INLINE_MATH[1], _TEX_TABULAR, _TEX_ACCENT, _TEX_SILENT, _TEX_HREF, _TEX_HEAD, _TEX_ITEM, _TEX_ENV, _TEX_NOTE, _TEX_WRAP, _TEX_GROUP, _TEX_BARE, _TEX_ESC, _MD_ESC],
        ("`",): [_TEX_QUOTE, _MD_CODE],
        ("__",): [_GONE[1]],
        ("{{", "}}"): [_TEMPLATE, _TEMPLATE_OPEN],
        ("[[", "]]"): [_WIKI_LINK, _WIKI_OPEN],
        ("[",): [_WIKI_URL, _MD_DEF, _MD_NOTE, _MD_IMAGE, _MD_LINK, _MD_REF],
        ("|",): [_WIKI_TABLE, _MD_TABLE_RULE],
        ("=",): [_WIKI_HEAD],
        ("#",): [_MD_ATX],
        ("==", "--"): [_MD_SETEXT],
        ("---", "***", "___", "===="): [_MD_RULE],
        (">",): [_MD_QUOTE],
        ("''",): [_WIKI_QUOTE],
        ("*",): [_EMPHASIS[0]],
        ("_",): [_EMPHASIS[1]],
        ("~~",): [_EMPHASIS[2]],
        ("==",): [_EMPHASIS[3]],
    }.items()
    for rule in rules
}
_SPACES = _rx(r"[ \t]{2,}")
_SIGN = _rx(r"\x02[\x11-\x1a]|[\x04\x05]")
_LINKED = _rx(r"\x04[^\x05]*\x05")
_NUMBER = _rx(r"\d{1,9}[.)] ")
_OWN = _rx(r"[\x02-\x05]")
_HOLD = _rx(r"\x03(\d+)\x03")


def _template(m: re.Match) -> str:
    """Visible text of a wiki template: its unnamed arguments."""
    args = m.group(1).split("|")[1:]
    return " ".join(a.strip() for a in args if a.strip() and not re.match(r"\s*[\w -]+=", a))


def _wiki_link(m: re.Match) -> str:
    parts = m.group(1).split("|")
    return _LINK + (parts[-1] if len(parts) > 1 else parts[0].rpartition(":")[2]) + _LINK_END


def _linked(m: re.Match) -> str:
    return f"{_LINK}{m.group(1)}{_LINK_END}"


def _accent(m: re.Match) -> str:
    return unicodedata.normalize("NFC", (m.group(2) or m.group(3)) + _ACCENTS[m.group(1)])


def _line_ends(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


class _Page:
    """One text under conversion: the rules' hits are counted, code and formulas are held aside."""

    def __init__(self, text: str):
        self.text = _OWN.sub(" ", _line_ends(text))
        self.marks, self.kept, self.notes = 0, [], []

    def sub(self, pattern: re.Pattern, to) -> int:
        needs = _NEEDS.get(pattern)
        if needs and not any(x in self.text for x in needs):
            return 0
        self.text, n = pattern.subn(to, self.text)
        self.marks += n
        return n

    def inner(self, pattern: re.Pattern, to) -> None:
        """Innermost first, until none is left; each round removes a nesting level."""
        while self.sub(pattern, to):
            pass

    def hold(self, pattern: re.Pattern, kind: str, group: int, decode: bool = False) -> None:
        def keep(m: re.Match) -> str:
            body = m.group(group)
            if decode:
                body = html.unescape(_HTML_TAG.sub("", body))
            self.kept.append(body.strip("\n") if kind == _C else body.strip())
            mark = f"\x03{len(self.kept) - 1}\x03"
            return f"\n\n{kind}{mark}\n\n" if kind else mark

        self.sub(pattern, keep)

    def note(self, pattern: re.Pattern, strip) -> int:
        """Move notes out of the text, each stripped by the rules that are still to come."""

        def keep(m: re.Match) -> str:
            page = _Page("")
            page.text, page.kept, page.notes = m.group(1), self.kept, self.notes
            strip(page)
            text = " ".join(_SIGN.sub("", page.text).split())
            if text:
                self.notes.append(self.restore(text))
            return ""

        return self.sub(pattern, keep)

    def comments(self) -> None:
        """Comments go; one that is not closed loses its opener only."""
        end = self.text.rfind("-->") + 3 if "-->" in self.text else 0
        self.text, rest = self.text[:end], self.text[end:]
        self.sub(_COMMENT, "")
        self.text += rest
        self.sub(_COMMENT_OPEN, "")

    def restore(self, line: str) -> str:
        while _HOLD.search(line):
            line = _HOLD.sub(lambda m: self.kept[int(m.group(1))], line)
        return line


def _strip(p: _Page) -> None:
    p.sub(_FRONT, lambda m: m.group(0).strip().strip("-").strip() + "\n\n")
    p.hold(_FENCE, _C, 2)
    p.sub(_FENCE_LINE, "")
    p.hold(_PRE, _C, 2, decode=True)
    p.hold(_VERB, _C, 2)
    p.hold(_NOWIKI, "", 1)
    p.hold(_MATHS[0], _M, 1)
    p.hold(_MATHS[1], _M, 2)
    p.hold(_MATHS[2], _M, 1)
    p.hold(_MATHS[3], _M, 1)
    p.hold(_MATHS[4], _M, 1)
    for pattern in _INLINE_MATH:
        p.hold(pattern, "", 1)
    p.hold(_TEX_QUOTE, "", 1)
    p.hold(_MD_CODE, "", 2)
    p.comments()
    for pattern in _GONE:
        p.sub(pattern, "")
    p.note(_REF, _strip_html)
    _strip_html(p)


def _strip_html(p: _Page) -> None:
    """The rules from HTML on."""
    p.sub(_AUTOLINK, _linked)
    p.sub(_HTML_LINK, _linked)
    p.sub(_HTML_HEAD, lambda m: f"\n\n{_head(int(m.group(1)))}{' '.join(m.group(2).split())}\n\n")
    p.sub(_HTML_ROW, lambda m: f"\n{_T}" + _HTML_CELL.sub("\t", m.group(1).strip()).replace("\n", " ") + "\n")
    p.sub(_HTML_ITEM, f"\n{_L}")
    p.sub(_HTML_IMG, lambda m: m.group(1) or m.group(2) or "")
    p.sub(_HTML_BLOCK, "\n")
    p.sub(_HTML_TAG, "")
    for _ in range(3):  # entities may be escaped twice
        if not p.sub(_ENTITY, lambda m: html.unescape(m.group(0)).replace("\xa0", " ").replace(m.group(0), " ")):
            break
    _strip_tex(p)


def _strip_tex(p: _Page) -> None:
    """The rules from LaTeX on."""
    p.sub(
        _TEX_TABULAR,
        lambda m: "\n" + "\n".join(_T + "\t".join(c.strip() for c in r.split("&")) for r in re.split(r"\\\\", m.group(2)) if r.strip()) + "\n",
    )
    p.sub(_TEX_ACCENT, _accent)
    p.sub(_TEX_SILENT, "")
    p.sub(_TEX_HREF, _linked)
    p.sub(_TEX_HEAD, lambda m: f"\n\n{_head(_TEX_LEVELS[m.group(1)])}{m.group(2)}\n\n")
    p.sub(_TEX_ITEM, f"\n{_L}")
    p.sub(_TEX_ENV, "\n")
    while p.note(_TEX_NOTE, _strip_tex) + p.sub(_TEX_WRAP, r"\1"):  # a note once its own commands are stripped
        pass
    p.inner(_TEX_GROUP, r"\1")
    p.sub(_TEX_BARE, "")
    # wiki
    p.inner(_TEMPLATE, _template)
    p.inner(_WIKI_LINK, _wiki_link)
    p.sub(_WIKI_URL, lambda m: _linked(m) if m.group(1) else "")
    if p.sub(_WIKI_TABLE, ""):
        p.sub(_WIKI_CELL, lambda m: _T + "\t".join(c.strip() for c in re.split(r"\|\||!!", m.group(1))))
    p.sub(_WIKI_HEAD, lambda m: f"\n{_head(len(m.group(1)))}{m.group(2)}\n")
    # Markdown
    p.sub(_MD_DEF, "")
    p.sub(_MD_NOTE, "")
    p.sub(_MD_IMAGE, r"\1")
    p.inner(_MD_LINK, _linked)
    p.sub(_MD_REF, _linked)
    p.sub(_MD_ATX, lambda m: f"\n{_head(len(m.group(1)))}{m.group(2)}\n")
    if p.sub(_MD_TABLE_RULE, ""):
        p.sub(_MD_ROW, lambda m: _T + "\t".join(c.strip() for c in m.group(1).split("|")))
    p.sub(_MD_SETEXT, lambda m: f"\n{_head(1 if m.group(2)[0] == '=' else 2)}{m.group(1)}\n")
    p.sub(_MD_RULE, "")
    p.sub(_MD_QUOTE, "")
    p.sub(_MD_ITEM, lambda m: m.group(1) + _L + (f"{m.group(2)} " if m.group(2) else ""))
    p.sub(_WIKI_QUOTE, r"\1")
    for pattern in _EMPHASIS:
        p.inner(pattern, r"\2")
    p.sub(_MD_ESC, r"\1")
    p.sub(_TEX_ESC, lambda m: m.group(0)[:-2].replace("~", " ") + m.group(1))
    p.sub(_TEMPLATE_OPEN, "")
    p.sub(_WIKI_OPEN, "")


def surges(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """First and last line of each stretch from a surge to its dive: of consecutive windows whose lengths sum to ``surge`` or more."""
    out: list[tuple[int, int]] = []
    total, before = 0, False
    for i, n in enumerate(lengths):
        total += n - (lengths[i - window] if i >= window else 0)
        if total >= surge:
            out.append((out.pop()[0] if before else max(0, i - window + 1), i))
        before = total >= surge
    return out


def line_blocks(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[bool]:
    """Which lines lie in a stretch from a surge to its dive."""
    keep = [False] * len(lengths)
    for first, last in surges(lengths, window, surge):
        keep[first : last + 1] = [True] * (last + 1 - first)
    return keep


def kept_lines(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[bool]:
    """Of each stretch the lines from the first to the last that say something; all lines if there is no stretch, or no threshold."""
    stretches = surges(lengths, window, surge)
    if not stretches or surge <= 0:
        return [True] * len(lengths)
    keep = [False] * len(lengths)
    for first, last in stretches:
        says = [i for i in range(first, last + 1) if lengths[i]]
        keep[says[0] : says[-1] + 1] = [True] * (says[-1] + 1 - says[0])
    return keep


def _result(text: str | None, blocks: list[dict], residue: bool = False, marks: int = 0, notes: list[str] = ()) -> dict:
    return {"text": text, "residue": residue, "marks": marks, "kinds": sorted({b["kind"] for b in blocks}), "blocks": blocks, "notes": list(notes)}


def _shown(block: dict) -> str:
    """The text of a block; items of a list begin with their number or a bullet."""
    if block["kind"] != "list":
        return block["text"]
    return "\n".join(x if _NUMBER.match(x) else "• " + x for x in block["text"].split("\n"))


def _visible(text: str) -> str:
    return "".join(_OWN.sub(" ", text).split())


def clean(text: str | None, window: int = WINDOW, surge: int = SURGE) -> dict:
    """The columns of RESULT for one body.

    A null text gives null text and no marks; an empty one stays empty. ``marks`` is the number of marks removed. Headings
    have their ``level`` in ``blocks``, other blocks 0. List items begin with their number or a bullet sign, table cells
    are separated by tabs, code and formulas stay letter by letter. The contents of ``<ref>`` and then of
    ``\\footnote`` are the notes: they would break the sentences they hang on. Marks within a note are not counted.
    """
    if text is None:
        return _result(None, [])
    if not _PLAIN.search(_line_ends(text)):
        return _result(text, [{"kind": "text", "level": 0, "text": text}] if text.strip() else [])
    p = _Page(text)
    _strip(p)
    lines = p.text.split("\n")
    signs = [line[at + 1 : at + 2] if (at := line.find("\x02")) >= 0 else "" for line in lines]
    # Structure counts as text, links do not. A line without a link stays whatever its length.
    keep = [True] * len(lines)
    if _LINK in p.text:
        keep = kept_lines([sum(map(str.isalnum, x if sign else _LINKED.sub("", x))) for x, sign in zip(lines, signs)], window, surge)
    blocks: list[dict] = []
    gap = True
    for line, sign, wanted in zip(lines, signs, keep):
        kind = _KIND.get(sign, "text")
        body = _SIGN.sub("", line)
        if not body.strip():
            gap = True
            continue
        if kind == "text" and not wanted and _LINKED.search(line):
            continue
        body = p.restore(body.rstrip())
        if kind not in ("code", "formula"):
            body = _SPACES.sub(" ", body).strip() if kind != "table" else body.strip()
        last = blocks[-1] if blocks else None
        if last and last["kind"] == kind and (kind in ("list", "table") or kind == "text" and not gap):
            last["text"] += "\n" + body
        else:
            blocks.append({"kind": kind, "level": ord(sign) - 0x10 if kind == "heading" else 0, "text": body})
        gap = False
    residue = any(b["kind"] != "text" for b in blocks) or _visible("\n".join(b["text"] for b in blocks)) != _visible(text)
    return _result("\n\n".join(map(_shown, blocks)), blocks, residue, p.marks, p.notes)


def clean_bodies(entities: DataFrame, components: DataFrame, current, columns: tuple[str, ...] = tuple(RESULT), **options) -> DataFrame:
    """``src_table, id`` and ``columns`` of RESULT of the current entities and of the components.

    ``current`` picks the current row per entity. Exact copies of a component come out once; rows without
    an id are none; extra columns play no part; empty tables give no rows.
    """
    bodies = current(entities, "body").select(F.lit("entities").alias("src_table"), "id", "body")
    parts = components.filter(F.col("id").isNotNull()).select(F.lit("components").alias("src_table"), "id", "body")
    ddl = ", ".join(f"{c} {RESULT[c]}" for c in columns)
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # bodies may be long
                b = batch.slice(at, 256)
                rows = [clean(x, **options) for x in b.column(2).to_pylist()]
                made = [pa.array([r[c] for r in rows], schema.field(c).type) for c in columns]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=["src_table", "id", *columns])

    both = bodies.unionByName(parts.distinct()).select("src_table", "id", "body")
    return both.mapInArrow(convert, f"src_table string, id string, {ddl}")
