"""Sections of wikitext pages: templates, links and tables are scanned with their nesting, headings count where they are not inside any of these."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import clean_text, kept_articles, strip_refs_and_comments

_MARKS = re.compile(r"\{\{|\}\}|\[\[|\]\]|\{\||\|\}|<nowiki\s*/?>|</nowiki>|^=+[^\n]*=+[ \t]*$", re.M)
_HEADING = re.compile(r"(=+)(.*?)(=+)\s*$", re.S)
_CLOSES = {"}}": "{{", "]]": "[[", "|}": "{|"}
#: Elements whose content is no prose.
_HIDDEN = re.compile(r"<(math|gallery|score|timeline|imagemap|syntaxhighlight|source|templatestyles)\b[^>]*>.*?</\1\s*>", re.S | re.I)


def _link(inner: str) -> str:
    """What a link shows: what stands behind its first bar, or all of it."""
    return inner.split("|", 1)[1] if "|" in inner else inner


def _cells(inner: str) -> str:
    """The texts of a table's cells, a line each, without attributes."""
    out = []
    for line in inner.split("\n")[1:]:
        line = line.strip()
        if line.startswith("|-"):
            continue
        if line.startswith("|+"):
            out.append(line[2:].strip())
        elif line[:1] in ("|", "!"):
            for cell in re.split(r"\|\||!!" if line[0] == "!" else r"\|\|", line[1:]):
                out.append(cell.split("|", 1)[1].strip() if "|" in cell else cell.strip())
        else:
            out.append(line)
    return "\n".join(out)


def _plain(text: str) -> str:
    """Text between marks without quotes for bold, elements' tags, external links' addresses, and entities."""
    text = re.sub(r"\[(?:https?|ftp)://\S+\s+([^\]\n]+)\]", r"\1", text)
    text = re.sub(r"\[(?:https?|ftp)://\S+\]", "", text)
    return html.unescape(re.sub(r"'{2,}", "", re.sub(r"</?[A-Za-z][^>]*>", "", text)))


def parts(text: str) -> list[tuple[int, str, str]]:
    """(level, heading, plain text) of the lead (level 0) and of what stands behind each heading, up to the next one of any level.

    Marks that are never closed, or close nothing, are text.
    """
    text = _HIDDEN.sub(" ", text)
    out: list[tuple[int, str, list[str]]] = [(0, "", [])]
    stack: list[tuple[str, list[str]]] = []  # open marks and what they hold so far

    def add(piece: str) -> None:
        (stack[-1][1] if stack else out[-1][2]).append(piece)

    at, literal = 0, False
    for m in _MARKS.finditer(text):
        add(text[at : m.start()])
        at, mark = m.end(), m[0]
        if mark.startswith("<"):
            literal = not literal if "/" not in mark[:2] and not mark.endswith("/>") else False
        elif literal:
            add(mark)
        elif mark.startswith("="):
            heading = _HEADING.match(mark)
            level = min(len(heading[1]), len(heading[3]), 6) if heading else 0
            if stack or not level or not mark.strip("= \t"):
                add(mark)
            else:
                name = mark.strip()[level:-level].strip() if len(mark.strip()) > 2 * level else ""
                out.append((level, name, []))
        elif mark in ("{{", "[[", "{|"):
            stack.append((mark, []))
        elif stack and stack[-1][0] == _CLOSES[mark]:
            opened, held = stack.pop()
            inner = "".join(held)
            add("" if opened == "{{" else _link(inner) if opened == "[[" else _cells(inner))
        elif mark == "|}" and any(o == "{|" for o, _ in stack):
            while stack[-1][0] != "{|":  # what a table's cells leave open
                opened, held = stack.pop()
                add(opened + "".join(held))
            add(_cells("".join(stack.pop()[1])))
        else:
            add(mark)
    add(text[at:])
    while stack:
        opened, held = stack.pop()
        add(opened + "".join(held))
    return [(level, _plain(name).strip(), _plain("".join(body))) for level, name, body in out]


def sections(texts: pd.Series) -> pd.Series:
    """(heading, text) of the lead, whose heading is null, and of each level-2 section up to its first heading of whatever level."""
    return pd.Series([None if t is None else [{"heading": name if level else None, "text": body} for level, name, body in parts(t) if level in (0, 2)] for t in texts])


def wikitext_sections(text: Column) -> Column:
    """An array of (heading, text) of wikitext without references and comments; null for null."""
    return F.pandas_udf(sections, "array<struct<heading:string,text:string>>")(strip_refs_and_comments(text))


def parsed_wikitext(pages: DataFrame, text: str, least_section: int = 1, least_article: int = 8) -> DataFrame:
    """pages with sentences and labels (1 where the next sentence begins a section), without `text`; as parsed_articles does for HTML."""
    found = pages.withColumn("_parts", wikitext_sections(F.col(text)))
    cleaned = F.transform("_parts", lambda s: F.struct(s["heading"].alias("heading"), clean_text(s["text"]).alias("text")))
    return kept_articles(found, cleaned, least_section, least_article).drop("_parts", text)
