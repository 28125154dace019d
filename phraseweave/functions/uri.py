"""Identifier forms of an entity, as column expressions.

Every form starts from the local name, the text after the last slash.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RESOURCE, ONTOLOGY = "http://dbpedia.org/resource/", "http://dbpedia.org/ontology/"
PAGE, INTERNAL = "https://en.wikipedia.org/wiki/", "/wiki/"


def local_name(uri: Column) -> Column:
    return F.substring_index(uri, "/", -1)


def clean_name(uri: Column) -> Column:
    return F.translate(local_name(uri), "_", " ")


def internal_link(uri: Column) -> Column:
    return F.concat(F.lit(INTERNAL), local_name(uri))


def page_url(uri: Column) -> Column:
    return F.concat(F.lit(PAGE), local_name(uri))


def resource_uri(uri: Column) -> Column:
    return F.concat(F.lit(RESOURCE), local_name(uri))


def capitalized(uri: Column) -> Column:
    """The same address with its local name's first letter in upper case; unchanged where there is none."""
    name = local_name(uri)
    return F.concat(F.substr(uri, F.lit(1), F.length(uri) - F.length(name)), F.upper(F.left(name, F.lit(1))), F.substr(name, F.lit(2)))


def article_url(resource: Column) -> Column:
    return F.replace(resource, F.lit("dbpedia.org/resource"), F.lit("en.wikipedia.org/wiki"))


def redirected(name: Column, target: Column) -> Column:
    return F.coalesce(target, name)


def is_number(text: Column) -> Column:
    return text.try_cast("bigint").isNotNull()


def abbreviated_type(name: Column) -> Column:
    """Clean local name of a type with its vocabulary's prefix shortened."""
    for long, short in (("owl#", "owl"), ("Wikicat", "W"), ("Yago", "Y")):
        name = F.replace(name, F.lit(long), F.lit(short))
    return clean_name(name)
