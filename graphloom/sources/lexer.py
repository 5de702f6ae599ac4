"""Tokens of source files, by a small state machine over characters that Spark runs file by file.

Comments, strings and templates may go over lines. A template's ``${`` opens a bracket, its code is
code like any other, and the ``}`` that closes it goes on with the template. Brackets carry a sign (1 opens, -1
closes); in Ruby so do the words that open and end blocks. A quote without an end on its line is a
mark, so broken files give tokens too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Rules(NamedTuple):
    """How a language writes comments and strings: line comments, whether block comments nest, quotes of strings on one
    line, quotes over lines, and quotes of single characters."""

    line: tuple[str, ...] = ("//",)
    block: bool = True
    nests: bool = False
    quotes: str = '"'
    long: tuple[str, ...] = ()
    char: bool = True


RULES = {
    "typescript": Rules(quotes="\"'", char=False), "go": Rules(long=("`",)), "java": Rules(long=('"""',)), "kotlin": Rules(nests=True, long=('"""',)), "csharp": Rules(long=('"""',)),
    "rust": Rules(nests=True), "swift": Rules(nests=True, long=('"""',), char=False), "c": Rules(), "cpp": Rules(), "php": Rules(line=("//", "#"), quotes="\"'", char=False), "ruby": Rules(line=("#",), block=False, quotes="\"'", char=False),
}
CLOSES = {"(": ")", "[": "]", "{": "}", "${": "}"}
FAMILIES = {"javascript": "typescript"}
_NAME = re.compile(r"[^\W\d][\w$]*|[$@#]+[^\W\d][\w$]*")
_NUMBER = re.compile(r"\d(?:[eEpP][+-]?|[\w.'](?!\.))*")
_MARK = re.compile(r"=>|->|::|\?\.|\.\.\.|[^\s]")
_CHAR = re.compile(r"'(?:\\[^\n]{1,10}?|[^\\'\n])'")
_LINE = {q: re.compile(rf"{q}(?:[^{q}\\\n]|\\.)*{q}", re.S) for q in "\"'"}
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_RAW = re.compile(r'R"([^()\\\s]{0,16})\(|b?r(#*)"|@"|\$@"|@\$"|#+"')
_HEREDOC = re.compile(r"<<<?[~-]?[ ]*(['\"]?)([A-Z_]\w*)\1")
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "void", "delete", "throw", "new", "else", "do"}
_RUBY_OPENS = {"class", "module", "def", "begin", "case", "do"}
_RUBY_IF = {"if", "unless", "while", "until", "for"}


def _quoted_end(text: str, at: int, close: str, escapes: bool) -> int:
    """The place after ``close``, from ``at`` on; the end of the text if there is none."""
    while at < len(text):
        if escapes and text[at] == "\\":
            at += 2
        elif text.startswith(close, at):
            return at + len(close)
        else:
            at += 1
    return len(text)


def _block_end(text: str, at: int, nests: bool) -> int:
    depth = 0
    for found in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if found[0] == "/*" and (nests or not depth) else -1 if found[0] == "*/" else 0
        if depth == 0:
            return found.end()
    return len(text)


def _template_end(text: str, at: int) -> tuple[int, bool]:
    """The place after what ends a template's text, and whether that is the start of code."""
    while at < len(text):
        if text[at] == "\\":
            at += 2
        elif text[at] == "`":
            return at + 1, False
        elif text.startswith("${", at):
            return at + 2, True
        else:
            at += 1
    return len(text), False


def lex(text: str, family: str) -> Iterator[tuple[str, int, int]]:
    """kind (name, number, string, mark, open, close, comment, directive), start and end of each token."""
    rules, at, last, depth, templates = RULES[family], 0, "", 0, []
    lines = {"": True}
    while at < len(text):
        c = text[at]
        if c.isspace():
            at += 1
            continue
        start, kind = at, "mark"
        raw = _RAW.match(text, at) if c in "Rbr@$#" and family in ("cpp", "rust", "csharp", "swift") else None
        own_line = text.rfind("\n", 0, at) + 1 == at or not text[text.rfind("\n", 0, at) + 1 : at].strip()
        if family == "ruby" and own_line and text.startswith("=begin", at):
            end = text.find("\n=end", at)
            kind, at = "comment", len(text) if end < 0 else end + 5
        elif family in ("c", "cpp", "csharp") and c == "#" and own_line:
            kind, at = "directive", re.compile(r"(?:[^\n\\]|\\\n|\\.)*").match(text, at).end()
        elif text.startswith(rules.line, at) and not (family == "php" and text.startswith("#[", at)):
            end = text.find("\n", at)
            kind, at = "comment", len(text) if end < 0 else end
        elif rules.block and text.startswith("/*", at):
            kind, at = "comment", _block_end(text, at, rules.nests)
        elif raw:
            verbatim = family == "csharp"
            close = {"cpp": f"){raw[1] or ''}\"", "rust": '"' + (raw[2] or ""), "swift": '"' + "#" * raw[0].count("#")}.get(family, '"')
            kind, at = "string", _quoted_end(text, raw.end(), close, False)
            while verbatim and text.startswith('"', at):  # "" is a quote inside
                at = _quoted_end(text, at + 1, '"', False)
        elif rules.long and text.startswith(rules.long, at):
            mark = next(x for x in rules.long if text.startswith(x, at))
            kind, at = "string", _quoted_end(text, at + len(mark), mark, mark != "`")
        elif family == "typescript" and c == "`":
            kind = "string"
            at, code = _template_end(text, at + 1)
            if code:
                yield kind, start, at - 2
                templates.append(depth)
                depth, kind, start = depth + 1, "open", at - 2
        elif family in ("ruby", "php") and c == "<" and (doc := _HEREDOC.match(text, at)):
            end = re.compile(rf"\n[ \t]*{doc[2]}\b").search(text, doc.end())
            rest = text.find("\n", doc.end())
            kind, at = "string", doc.end() if rest < 0 else end.end() if end else len(text)
        elif c in rules.quotes and (whole := _LINE[c].match(text, at)):
            kind, at = "string", whole.end()
        elif c == "'" and rules.char and (whole := _CHAR.match(text, at)):
            kind, at = "string", whole.end()
        elif family == "typescript" and c == "/" and (last in _BEFORE_REGEX or not re.match(r"[\w$)\]}\"'`]", last[-1:] or "(")) and (whole := _REGEX.match(text, at)):
            kind, at = "string", whole.end()
        elif whole := _NAME.match(text, at):
            kind, at = "name", whole.end()
            if family == "ruby" and at < len(text) and text[at] in "?!" and text[at + 1 : at + 2] != "=":
                at += 1
        elif c.isdigit() and (whole := _NUMBER.match(text, at)):
            kind, at = "number", whole.end()
        else:
            at = _MARK.match(text, at).end()
            if c in "([{":
                kind, depth = "open", depth + 1
            elif c in ")]}":
                kind, depth = "close", depth - 1
                if c == "}" and templates and depth == templates[-1]:
                    yield kind, start, at
                    templates.pop()
                    kind, start = "string", at
                    at, code = _template_end(text, at)
                    if code:
                        yield kind, start, at - 2
                        templates.append(depth)
                        depth, kind, start = depth + 1, "open", at - 2
        if family == "ruby" and kind == "name":
            kind = _ruby_kind(text, start, at, last, own_line, lines)
        if kind not in ("comment", "directive"):
            last = text[start:at]
        yield kind, start, at


def _ruby_kind(text: str, start: int, at: int, last: str, own_line: bool, lines: dict) -> str:
    """Whether a word opens or ends a block. A loop's own ``do`` opens none, nor does an ``if`` after a statement."""
    word = text[start:at]
    if last in (".", "def", ":") or text.startswith(":", at) and not text.startswith("::", at):
        return "name"
    heads = own_line or last in ("=", "(", "[", ",", "then", "else", "&&", "||", ";")
    if word in _RUBY_IF and heads:
        lines["loop"] = text.count("\n", 0, start) if word in ("while", "until", "for") else -1
        return "open"
    if word == "do" and lines.get("loop") == text.count("\n", 0, start):
        return "name"
    if word == "def" and re.compile(r"\s+[\w.?!]+(?:\([^()\n]*\))?\s+=\s").match(text, at):
        return "name"
    return "open" if word in _RUBY_OPENS else "close" if word == "end" else "name"


def tokens(sources: DataFrame) -> DataFrame:
    """file_id, family, n, line, end_line, start, end (offsets), kind, text, first (on its line), sign, doc (the comments
    right before the token) of the files (file_id, language, content) of known languages."""
    family = F.coalesce(*[F.when(F.col("language") == a, b) for a, b in FAMILIES.items()], F.col("language"))
    known = sources.withColumn("family", family).where(F.col("family").isin(*RULES) & F.col("content").isNotNull()).select("file_id", "family", "content")
    schema = "file_id string, family string, n int, line int, end_line int, start int, `end` int, kind string, text string, first boolean, sign int, doc string"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file_id, family, content in batch.itertuples(index=False):
                out, line, seen, before, ended, notes, open_now = [], 1, 0, 0, 0, [], []
                for kind, start, end in lex(content, family):
                    line += content.count("\n", seen, start)
                    seen = start
                    text = content[start:end]
                    if kind in ("comment", "directive"):
                        # a block is a note by itself, lines right below one another are one
                        apart = text.startswith(("/*", "=begin")) or not notes or notes[-1].startswith(("/*", "=begin")) or content.count("\n", ended, start) > 1
                        notes = [] if kind == "directive" else [text] if apart else [*notes, text]
                        ended = end
                        continue
                    last = line + text.count("\n")
                    if kind == "open":
                        open_now.append(text)
                    elif kind == "close" and open_now:
                        open_now.pop()
                    sign = {"open": 1, "close": -1}.get(kind, 0)
                    out.append((file_id, family, len(out), line, last, start, end, kind, '"' if kind == "string" else text if len(text) < 200 else text[:200], line != before, sign, "\n".join(notes) or None))
                    before, notes = last, []
                end = len(content)
                last = 1 + content.count("\n", 0, len(content.rstrip()))
                for opened in reversed(open_now):  # what a file leaves open ends with it
                    out.append((file_id, family, len(out), last, last, end, end, "close", CLOSES.get(opened, "end"), False, -1, None))
                if out:
                    yield pd.DataFrame(out, columns=["file_id", "family", "n", "line", "end_line", "start", "end", "kind", "text", "first", "sign", "doc"])

    return known.mapInPandas(rows, schema)
