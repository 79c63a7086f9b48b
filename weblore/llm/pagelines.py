"""Lines of a page and their visible text, shared by the operators on webpage.html."""

from __future__ import annotations

import html as entities
import re

COMMENT = re.compile(r"<!--.*?(?:-->|$)", re.S)
TAG = re.compile(r"<[a-zA-Z/!?][^<>]*(?:>|$)")
BODY = re.compile(r"<body\b", re.I)
H1 = re.compile(r"<h1\b[^>]*>(.*?)(?:</h1|\n|$)", re.I | re.S)
WORD = re.compile(r"[^\W\d_]+")


def visible(text: str) -> str:
    """The text without tags and comments, character references decoded."""
    if "<" in text:
        if "<!--" in text:
            text = COMMENT.sub(" ", text)
        text = TAG.sub("", text)
    return entities.unescape(text) if "&" in text else text


def words(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return WORD.findall(text.casefold())


def body_lines(page: str | None) -> tuple[list[str], int]:
    """All lines (split at line feeds) and the index of the first one after the `<body` line.

    A page without a `<body` line, an empty and a null page have no body lines.
    """
    if not page:
        return [], 0
    lines = page.split("\n")
    for i, line in enumerate(lines):
        if "<" in line and BODY.search(line):
            return lines, i + 1
    return lines, len(lines)


def heading(page: str) -> str:
    """Visible text of the page's first `<h1>`, '' without one."""
    found = H1.search(page)
    return visible(found.group(1)).strip() if found else ""
