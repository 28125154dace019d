"""Sentences, tokens, links and wiki markup.

Column expressions where the engine has them; Arrow-batched functions for nested markup, HTML
and markup links, which regular expressions of the engine can't rewrite.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from phraseweave.functions.uri import resource_uri


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n")


def sentences(paragraph: Column) -> Column:
    """A paragraph cut behind the spaces that follow a full stop, exclamation or question mark."""
    return F.filter(F.split(paragraph, "(?<=[.!?]) +"), lambda s: F.trim(s) != "")


def sentences_of_lines(text: Column) -> Column:
    """The sentences of each line of a text."""
    return F.flatten(F.transform(F.split(text, "\n"), sentences))


def tokens(sentence: Column) -> Column:
    return F.filter(F.split(sentence, " "), lambda t: t != "")


def cleaned(sentence: Column) -> Column:
    """One line of ASCII text without footnote marks and without one-letter words other than a, A and I."""
    text = F.regexp_replace(sentence, "\n", " ")
    text = F.regexp_replace(text, " +", " ")
    text = F.regexp_replace(text, "[^\\x00-\\x7F]", "")
    text = F.regexp_replace(text, "\\[[0-9]+\\]", "")
    words = F.filter(F.split(text, " "), lambda w: (F.length(w) > 1) | w.isin("a", "A", "I"))
    return F.array_join(words, " ")


def match_starts(sequence: Column, pattern: Column) -> Column:
    """0-based starts of every place, overlapping ones too, where ``pattern`` stands in ``sequence``; an empty pattern has none."""
    last = F.size(sequence) - F.size(pattern)
    possible = (F.size(pattern) > 0) & (last >= 0) & F.array_contains(sequence, F.get(pattern, F.lit(0)))
    places = F.when(possible, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    # one element is compared before a part of the sequence is copied
    return F.filter(places, lambda i: (F.get(sequence, i) == F.get(pattern, F.lit(0))) & (F.slice(sequence, i + 1, F.size(pattern)) == pattern))


def covered_indexes(sequence: Column, pattern: Column) -> Column:
    """All 0-based indexes that a match covers, sorted."""
    spans = F.transform(match_starts(sequence, pattern), lambda i: F.sequence(i, i + F.size(pattern) - 1))
    return F.array_sort(F.array_distinct(F.flatten(spans)))


def tagged(words: Column, links: Column) -> Column:
    """Tokens (text, link): each link (address, words) marks all tokens its words cover; a later link replaces an earlier one."""
    plain = F.transform(words, lambda w: F.struct(w.alias("text"), F.lit(None).cast("string").alias("link")))

    def mark(done: Column, link: Column) -> Column:
        size = F.size(link["words"])

        def covered(i: Column) -> Column:  # one of the places that begin just before here matches
            before = F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1)
            return (size > 0) & F.exists(before, lambda k: (i >= k) & (F.slice(words, F.greatest(i - k + 1, F.lit(1)), size) == link["words"]))

        return F.transform(done, lambda t, i: F.struct(t["text"].alias("text"), F.when(covered(i), link["address"]).otherwise(t["link"]).alias("link")))

    return F.aggregate(links, plain, mark)


def as_string(tagged_tokens: Column) -> Column:
    return F.concat(F.array_join(F.transform(tagged_tokens, lambda t: t["text"]), " "), F.lit(" "))


def contained_links(tagged_tokens: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(tagged_tokens, lambda t: t["link"].isNotNull()), lambda t: t["link"]))


def link_addresses(tagged_tokens: Column, resource: bool = False) -> Column:
    """(link, addresses) of each distinct link: the 0-based indexes of its tokens. resource: links as identifiers of their entities."""
    numbered = F.transform(tagged_tokens, lambda t, i: F.struct(t["link"].alias("link"), i.alias("at")))

    def of(link: Column) -> Column:
        at = F.transform(F.filter(numbered, lambda t: t["link"] == link), lambda t: t["at"])
        return F.struct((resource_uri(link) if resource else link).alias("link"), at.alias("addresses"))

    return F.transform(contained_links(tagged_tokens), of)


def contains_any_link(tagged_tokens: Column, links: Column | None = None) -> Column:
    """Whether a token is linked, or linked to one of the addresses."""
    if links is not None:
        return F.exists(tagged_tokens, lambda t: F.coalesce(F.array_contains(links, t["link"]), F.lit(False)))
    return F.exists(tagged_tokens, lambda t: t["link"].isNotNull())


def contains_anchor_text(sentence: Column, anchors: Column) -> Column:
    return F.exists(anchors, lambda a: F.contains(sentence, a))


def sign_count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def markup_consistent(text: Column, without_escaped: bool = False) -> Column:
    """As many opening as closing square brackets and braces; optionally without brackets that nowiki escapes."""
    if without_escaped:
        text = F.regexp_replace(text, "<nowiki>[\\[\\]]+</nowiki>", "")
    return (sign_count(text, "[") == sign_count(text, "]")) & (sign_count(text, "{") == sign_count(text, "}"))


#: What must not be left in converted text. Fixed values.
RESIDUES = ("==", "{", "}", "[", "]", "<ref>", "<ref ", "</ref>", "\r", "<!--", "-->", "''")


def residual_markup(html: Column) -> Column:
    return F.filter(F.array(*map(F.lit, RESIDUES)), lambda bad: F.contains(html, bad))


def strip_braces(text: str) -> str:
    """Text outside nested braces; a closing brace outside of any stays."""
    out, depth, start = [], 0, 0
    for m in re.finditer("[{}]", text):
        if m[0] == "{":
            if not depth:
                out.append(text[start : m.start()])
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                start = m.end()
    return "".join(out) + ("" if depth else text[start:])


def strip_nested(text: str, opening: re.Pattern) -> str:
    """Text without the square-bracket groups that begin with ``opening``, whatever they hold."""
    out, at = [], 0
    while m := opening.search(text, at):
        depth, end = 0, None
        for b in re.compile(r"[\[\]]").finditer(text, m.start()):
            depth += 1 if b[0] == "[" else -1
            if not depth:
                end = b.end()
                break
        if end is None:
            break
        out.append(text[at : m.start()])
        at = end
    return "".join(out) + text[at:]


FILES, WEB = re.compile(r"\[\[(?:File|Image):"), re.compile(r"\[https?://")
#: Grammar of wiki markup. Fixed values.
END_MATTER = re.compile(r"== *Further reading *==|== *References *==")
HEADLINE = re.compile(r"(?m)^(=+).+?\1")
EMPTY_NOTE, NOTE = re.compile(r"<[rR]ef(?:[ \n][^>]*?)?/>"), re.compile(r"(?s)<[rR]ef(?:[ \n][^>]*?[^/])?>.*?</[rR]ef>")
CATEGORY, BULLET, STRONG = re.compile(r"\[\[Category:[^\[\]]*\]\]"), re.compile(r"\* ?"), re.compile(r"'{2,3}")
TEXT = re.compile(r"[^\n]")
WIKI_LINK, BRACKETS = re.compile(r"\[\[([^|\]]*)\|?(.*?)\]\]"), re.compile(r"\[(.*?)\]")
MARKUP_LINK, PAGE_LINK = re.compile(r"\[\[(.+?)(?:\|(.+?))?\]\]"), re.compile(r'(href="/wiki/)(.*?)(")')


def anchor(match: re.Match) -> str:
    target, text = match[1], match[2]
    return f'<a href="/wiki/{target.replace(" ", "_")}">{text or target}</a>'


def mark_paragraphs(text: str) -> str:
    """What stands before a blank line, two characters or more, as a paragraph; read once, however long the rest without a blank line is."""
    out, at = [], 0
    while (m := TEXT.search(text, at)) and (end := text.find("\n\n", m.start() + 2)) >= 0:
        out.append(f"{text[at : m.start()]}<p>{text[m.start() : end]}</p>")
        at = end + 2
    return "".join(out) + text[at:]


def wikitext_to_html(text: str | None) -> str:
    """Paragraphs and anchors of an article's markup; templates, comments, notes, files and end matter go.

    Only text before a blank line is a paragraph.
    """
    text = re.sub(r"(?s)<!--.*?-->", "", strip_braces(text or ""))
    text = END_MATTER.split(text, maxsplit=1)[0]
    text = HEADLINE.sub("\n", text)
    text = NOTE.sub("", EMPTY_NOTE.sub("", text))
    text = strip_nested(strip_nested(text, FILES), WEB)
    for dropped in (CATEGORY, BULLET, STRONG):
        text = dropped.sub("", text)
    text = mark_paragraphs(text)
    text = BRACKETS.sub(r"\1", WIKI_LINK.sub(anchor, text))
    text = re.sub(r"<p>[ \n]*</p>", "", text)
    return re.sub(r"</p>\n*<p>", "</p>\n\n<p>", text)


class _Paragraphs(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.text: list[str] | None = None
        self.anchors: list[dict] = []
        self.link: tuple[str, list[str]] | None = None

    def close_paragraph(self) -> None:
        if self.text is not None:
            self.close_anchor()
            self.found.append({"text": "".join(self.text), "anchors": self.anchors})
        self.text, self.anchors = None, []

    def close_anchor(self) -> None:
        if self.link is not None:
            self.anchors.append({"href": self.link[0], "text": "".join(self.link[1])})
        self.link = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "p":
            self.close_paragraph()
            self.text = []
        elif tag == "a" and self.text is not None:
            self.close_anchor()
            href = dict(attrs).get("href")
            self.link = (href, []) if href else None

    def handle_endtag(self, tag: str) -> None:
        if tag == "p":
            self.close_paragraph()
        elif tag == "a":
            self.close_anchor()

    def handle_data(self, data: str) -> None:
        if self.text is not None:
            self.text.append(data)
            if self.link is not None:
                self.link[1].append(data)


def html_paragraphs(html: str | None) -> list[dict]:
    """Paragraphs (text, anchors with href and text) of a page, however its tags are closed."""
    parser = _Paragraphs()
    parser.feed(html or "")
    parser.close()
    parser.close_paragraph()
    return parser.found


def redirect_markup(text: str, targets: dict[str, str]) -> str:
    """Links to redirect names lead to their targets; the old name stays as the shown text unless it equals the target."""

    def change(m: re.Match) -> str:
        name, shown = m[1], m[2]
        target = targets.get(name.replace("_", " "))
        if target is None:
            return m[0]
        shown = shown or name
        return f"[[{target}]]" if shown == target else f"[[{target}|{shown}]]"

    return MARKUP_LINK.sub(change, text)


def redirect_html(text: str, targets: dict[str, str]) -> str:
    def change(m: re.Match) -> str:
        target = targets.get(m[2].replace("_", " "))
        return m[0] if target is None else m[1] + target.replace(" ", "_") + m[3]

    return PAGE_LINK.sub(change, text)


PAIR = StructType([StructField("href", StringType()), StructField("text", StringType())])
PARAGRAPHS_ARROW = pa.list_(pa.struct([("text", pa.string()), ("anchors", pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())])))]))
PARAGRAPHS = ArrayType(StructType([StructField("text", StringType()), StructField("anchors", ArrayType(PAIR))]))


@pandas_udf(StringType())
def html_of_wikitext(text: pd.Series) -> pd.Series:
    return text.map(wikitext_to_html)


@pandas_udf(StringType())
def without_braces(text: pd.Series) -> pd.Series:
    return text.map(strip_braces, na_action="ignore")


#: Bytes of pages that are parsed at once. Fixed value.
PAGES_AT_ONCE = 1 << 20


def parsed_pages(html: pa.Array, most: int = PAGES_AT_ONCE) -> Iterator[pa.Array]:
    """The paragraphs of pages, in runs of about ``most`` bytes (one page at least), so only a run's objects are there at a time."""
    size = pc.fill_null(pc.binary_length(html), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(size, dtype=np.int64) // most
    cut = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(html)]
    for a, b in zip(cut, cut[1:], strict=False):
        yield pa.array([html_paragraphs(t) for t in html.slice(a, b - a).to_pylist()], PARAGRAPHS_ARROW)


@arrow_udf(PARAGRAPHS)
def paragraphs_of_html(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for html in batches:
        yield from parsed_pages(html)


#: Words, numbers with signs inside, and single signs: an approximation of treebank tokens.
TREEBANK = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+(?:[.,:/-]\d+)*|[^\w\s]|_")


@pandas_udf(ArrayType(StringType()))
def treebank_tokens(text: pd.Series) -> pd.Series:
    return text.map(lambda t: TREEBANK.findall(t or ""))


@pandas_udf(ArrayType(ArrayType(StringType())))
def treebank_of_each(texts: pd.Series) -> pd.Series:
    return texts.map(lambda every: [TREEBANK.findall(t or "") for t in every])
