"""Articles: dumps, pages by title, redirects, tagged sentences."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from phraseweave.functions import text as T
from phraseweave.functions.uri import clean_name


def unescaped(xml: Column) -> Column:
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        xml = F.replace(xml, F.lit(name), F.lit(sign))
    return xml


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(title, wikitext) of the pages of an XML dump; of equal titles the last. Files of any size are read in splits, cut behind pages."""
    cut = spark.read.option("lineSep", "</page>").text(path).select(F.monotonically_increasing_id().alias("line_no"), F.substring_index("value", "<page>", -1).alias("page"), F.contains("value", F.lit("<page>")).alias("whole"))
    # a text without content may be written as an empty element
    text = F.regexp_extract("page", r"(?s)<text(?:\s[^>]*[^/>])?>(.*?)</text>", 1)
    pages = cut.filter("whole").select("line_no", unescaped(F.regexp_extract("page", r"(?s)<title>(.*?)</title>", 1)).alias("title"), unescaped(text).alias("wikitext"))
    return pages.groupBy("title").agg(F.max_by("wikitext", "line_no").alias("wikitext"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a text file between blank lines."""
    return spark.read.option("lineSep", "\n\n").text(path)


def of_subjects(pages: DataFrame, facts: DataFrame) -> DataFrame:
    """Pages whose title is the clean name of a subject."""
    return pages.join(facts.select(clean_name(F.col("s")).alias("title")).distinct(), "title", "left_semi")


def articles_of(subjects: DataFrame, pages: DataFrame) -> DataFrame:
    """(s, html) of each subject; without a page the html is empty."""
    named = subjects.select("s", clean_name(F.col("s")).alias("title"))
    return named.join(pages, "title", "left").select("s", F.coalesce(T.html_of_wikitext(F.col("wikitext")), F.lit("")).alias("html"))


def article_warnings(pages: DataFrame) -> DataFrame:
    """(title, consistent, residues) of pages (title, wikitext): whether brackets and braces pair, and markup that the conversion leaves."""
    converted = pages.select("title", T.markup_consistent(F.coalesce("wikitext", F.lit(""))).alias("consistent"), T.html_of_wikitext(F.col("wikitext")).alias("html"))
    return converted.select("title", "consistent", T.residual_markup(F.col("html")).alias("residues"))


def fetch_html(url: str, timeout: float = 30.0, tries: int = 3) -> str:
    """The page at an address; empty where there is none. For ``fetched``, on executors that may use the network."""
    for left in range(tries - 1, -1, -1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                return answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code in (404, 410):
                return ""
            if not left:
                raise
        except OSError:
            if not left:
                raise
    return ""


def fetched(subjects: DataFrame, fetch: Callable[[str], str]) -> DataFrame:
    """(s, html) from a function of the article's address; the caller's function does the network access."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            urls = batch["s"].str.replace("dbpedia.org/resource", "en.wikipedia.org/wiki", regex=False)
            yield pd.DataFrame({"s": batch["s"], "html": urls.map(fetch)})

    return subjects.select("s").mapInPandas(run, "s string, html string")


def redirect_links(articles: DataFrame, redirects: DataFrame, column: str = "wikitext", html: bool = False) -> DataFrame:
    """Articles whose links to redirect names (src) lead to their targets (dst), one hop.

    Each article takes along only the redirects that its own links name, found by a join on
    the link names, so the redirect table may be of any size. Of spellings that differ by spaces and
    underscores the last line (line_no, if the table has it; else the largest target) counts.
    """
    rule, take = (T.PAGE_LINK, T.redirect_html) if html else (T.MARKUP_LINK, T.redirect_markup)

    @pandas_udf("string")
    def change(text: pd.Series, names: pd.Series, targets: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else take(t, dict(zip(n, d, strict=True))) for t, n, d in zip(text, names, targets, strict=True)])

    # an article is known by what it holds: rows that are equal in everything change alike
    whole = F.struct(*(F.col(f"`{c}`") for c in articles.columns)).alias("article")
    keyed = articles.select(whole, F.xxhash64(*(F.col(f"`{c}`") for c in articles.columns)).alias("article_key"))
    text = F.col("article").getField(column)
    name = F.regexp_extract_all(text, F.lit(rule.pattern), 2 if html else 1)
    names = F.array_distinct(F.transform(name, lambda n: F.translate(n, "_", " ")))
    last = F.max_by("dst", "line_no") if "line_no" in redirects.columns else F.max("dst")
    table = redirects.withColumn("name", F.translate("src", "_", " ")).groupBy("name").agg(last.alias("dst"))
    links = keyed.select("article_key", F.explode(names).alias("name")).distinct().join(table, "name")
    found = links.groupBy("article_key").agg(F.collect_list("name").alias("found"), F.collect_list("dst").alias("targets"))
    empty = F.array().cast("array<string>")
    changed = change(text, F.coalesce("found", empty), F.coalesce("targets", empty))
    return keyed.join(found, "article_key", "left").select(*(changed.alias(c) if c == column else F.col("article").getField(c).alias(c) for c in articles.columns))


def rewrite_dump(spark: SparkSession, path: str, redirects: DataFrame, target: str) -> None:
    """Writes the dump at ``path`` again, block by block, with links to redirect names leading to their targets."""
    blocks = redirect_links(read_blocks(spark, path), redirects, column="value")
    blocks.write.mode("overwrite").option("lineSep", "\n\n").text(target)


def tag_sentences(articles: DataFrame, tokenize: Callable[[Column], Column] = T.treebank_of_each, any_link: bool = True, sought: str | None = None) -> DataFrame:
    """Tagged sentences of (s, html): s, paragraph, sentence, relative_position, tokens (text, link).

    Anchors of a paragraph mark every place where their tokens stand in its sentences; with ``sought``,
    the name of an array column of ``articles``, only anchors to its addresses do. Sentences
    without an anchor's text are left out, as are those without a tagged token (``any_link``). All of a
    sentence is in its row, so rows with the same s stay apart. ``tokenize`` gives the tokens of
    each text of an array column.
    """
    kept = [] if sought is None else [sought]
    parts = articles.select("s", *kept, T.paragraphs_of_html(F.col("html")).alias("parts"))
    parts = parts.select("s", *kept, F.size("parts").alias("n"), F.posexplode("parts").alias("paragraph", "part"))
    anchors = F.col("part.anchors") if sought is None else F.filter("part.anchors", lambda a: F.array_contains(sought, a["href"]))
    lines = parts.select("s", "paragraph", (F.col("paragraph") / F.col("n")).alias("relative_position"), anchors.alias("anchors"), F.posexplode(T.sentences_of_lines(F.col("part.text"))).alias("sentence", "line"))
    lines = lines.filter(T.contains_anchor_text(F.col("line"), F.transform("anchors", lambda a: a["text"])))
    # one call of the tokenizer for the sentence and its anchors, which no sentence holds a line break of
    texts = F.concat(F.array(T.cleaned(F.col("line"))), F.transform("anchors", lambda a: a["text"]))
    split = lines.withColumn("words", tokenize(texts))
    links = F.transform("anchors", lambda a, i: F.struct(a["href"].alias("address"), F.get("words", i + 1).alias("words")))
    out = split.select("s", "paragraph", "sentence", "relative_position", T.tagged(F.get("words", F.lit(0)), links).alias("tokens"))
    return out.filter(T.contains_any_link(F.col("tokens"))) if any_link else out
