"""Cutting articles in typesetting markup into the parts that a reader sees: title, authors, abstract, sections."""

from __future__ import annotations

import re

_BRACE = re.compile(r"[{}]")
_COMMENT = re.compile(r"(?<!\\)%[^\r\n]*")
_DISABLED = re.compile(r"\\iffalse\b.*?\\fi\b|\\begin\{comment\}.*?\\end\{comment\}", re.S)
_HEAD = re.compile(r"\\(title|author)\b\s*(?:\[[^\]]*\])?\s*\{")
_ABSTRACT = re.compile(r"\\begin\{abstract\}(.*?)(?:\\end\{abstract\}|\\(?:sub)*section\b|\\end\{document\}|\Z)", re.S)
_SECTION = re.compile(r"\\(?:sub)*section\*?\s*\{[^{}]*\}")
_TAIL = re.compile(r"\\begin\{thebibliography\}.*?(?:\\end\{thebibliography\}|\Z)|\\bibliography(?:style)?\{[^}]*\}|\\end\{document\}.*\Z", re.S)
_PREAMBLE = re.compile(r"\\(?:documentclass|usepackage|date|pagestyle|bibliographystyle|theoremstyle|newtheorem\*?|DeclareMathOperator\*?|(?:re|provide)?newcommand\*?|def)\b[^\n]*")
_MISSING = re.compile(r"\\(?:input|include|subfile|maketitle|label|tableofcontents|noindent|clearpage|newpage)\b\s*(?:\{[^}]*\})?|\\(?:begin|end)\{(?:document|center|quote|remark|lemma|theorem|proof)\}")
_HTML = re.compile(r"<(?:!doctype|html|head|body)\b", re.I)
_PAGE_HEAD = re.compile(r"<(title|script|style)\b.*?</\1>", re.I | re.S)
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>|<!--.*?-->|<!doctype[^>]*>", re.S | re.I)


def _braced(text: str, start: int) -> str:
    """What stands between the brace before ``start`` and its partner."""
    depth = 1
    for m in _BRACE.finditer(text, start):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return text[start : m.start()]
    return text[start:]


def _shown(text: str) -> str:
    """A section without bibliography and missing includes."""
    if "\\" not in text:
        return text
    if "\\bibliography" in text or "{thebibliography}" in text or "\\end{document}" in text:
        text = _TAIL.sub("", text)
    return _MISSING.sub("", text)


def parts(text: str) -> list[tuple[str, str]]:
    """``(kind, content)`` of every part; comments, disabled drafts, preamble, bibliography and missing includes are left out.

    A text without sections is one part of kind "body", as is what stands before the first section.
    """
    if "%" in text:
        text = _COMMENT.sub("", text)
    if "\\iffalse" in text or "{comment}" in text:
        text = _DISABLED.sub(" ", text)
    if "<" in text and _HTML.search(text):
        return [("body", _TAG.sub("\n", _PAGE_HEAD.sub("\n", text)))]
    out = []
    if "\\title" in text or "\\author" in text:
        spans = []
        for m in _HEAD.finditer(text):
            content = _braced(text, m.end())
            out.append((m[1], content))
            spans.append((m.start(), m.end() + len(content) + 1))
        for a, b in reversed(spans):
            text = text[:a] + "\n" + text[b:]
    if "abstract}" in text:
        between, end = [], 0
        for m in _ABSTRACT.finditer(text):
            out.append(("abstract", m[1]))
            between.append(text[end : m.start()])
            end = m.end()
        text = "\n".join([*between, text[end:]])
    head, *sections = _SECTION.split(text)
    head = _PREAMBLE.sub("", _TAIL.sub("", head))
    out.append(("body", _MISSING.sub("", head)))
    out += [("section", _shown(s)) for s in sections]
    return [(k, c) for k, c in out if c.strip()]
