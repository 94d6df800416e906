"""Text functions of the title and article pipeline, formatting and labels."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def nfkc(text: Column) -> Column:
    """Unicode NFKC; Spark has no such function, so this is an Arrow UDF."""

    def over(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    over.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(over, "string")(text)


def squeeze(text: Column) -> Column:
    """Control characters become spaces, runs of spaces one, a space at either end goes."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\p{Cntrl}", " "), " +", " "))


def normalize_title(text: Column) -> Column:
    return squeeze(nfkc(text))


def strip_title(title: Column) -> Column:
    """Without the prefixes of author and portal pages and without the first parenthesis; spaces squeezed."""
    t = F.regexp_replace(title, "Author:|Portal:", "")
    t = F.regexp_replace(t, r"^([^(]*?(?:\((?!.+?\))[^(]*?)*?)\([^)]+\)(?s:(.*))$", "$1$2")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def unescape_sql(text: Column) -> Column:
    """Backslash quotes, underscores and en dashes of a SQL dump as plain text."""
    t = F.replace(F.replace(text, F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"'))
    return F.replace(F.replace(t, F.lit("_"), F.lit(" ")), F.lit("–"), F.lit("-"))


def url_to_title(url: Column) -> Column:
    """The title in the path of an article's url; NULL for other urls."""
    path = F.regexp_extract(F.parse_url(url, F.lit("PATH")), "^/wiki/(.+)$", 1)
    return F.when(path != "", F.replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), F.lit("_"), F.lit(" ")))


def title_to_url(lang: Column, title: Column) -> Column:
    return F.concat(F.lit("https://"), lang, F.lit(".wikipedia.org/wiki/"), F.replace(title, F.lit(" "), F.lit("_")))


def language_of_file(name: Column) -> Column:
    """The other language in a name like ``titles-en-de.txt``; NULL if there is none."""
    found = F.regexp_extract(name, r"[-_.]en[-_]([a-z]{2,3})\b|\b([a-z]{2,3})[-_]en[-_.]", 1)
    other = F.regexp_extract(name, r"[-_.]en[-_]([a-z]{2,3})\b|\b([a-z]{2,3})[-_]en[-_.]", 2)
    return F.when(found != "", found).when(other != "", other)


def language_suffix(ident: Column) -> Column:
    return F.substring(ident, -2, 2)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def strength_tag(x: Column) -> Column:
    """Three decimals without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.3f", x), r"0+$", ""), r"\.$", "")


def layer_tag(which: Column) -> Column:
    return F.when(which == "last_half", "LH").when(which == "last", "L").when(which == "all", "A").otherwise(which)


def token_tag(which: Column) -> Column:
    return F.when(which == "cls", "CLS").when(which == "all", "ALL").otherwise(F.upper(which))


def run_tag(layers: Column, tokens: Column, basket: Column, strength: Column) -> Column:
    return F.concat_ws("_", layer_tag(layers), token_tag(tokens), basket.cast("string"), strength_tag(strength))


def calibration_label(size: Column, token: Column, layers: Column) -> Column:
    return F.concat_ws("—", size.cast("string"), F.replace(token, F.lit("cls"), F.lit("<s>")), layers)


def model_short(name: Column, known: dict[str, str]) -> Column:
    """The first abbreviation whose key the name contains, else what stands after the last slash."""
    out = F.element_at(F.split(name, "/"), -1)
    for key, short in reversed(list(known.items())):
        out = F.when(F.contains(F.lower(name), F.lit(key.lower())), short).otherwise(out)
    return out


#: Characters that LaTeX reads as commands.
LATEX = {"&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex_escape(text: Column, most: int | None = None) -> Column:
    """Whitespace squeezed, cut to ``most`` characters, special characters escaped once each."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    if most is not None:
        t = F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)
    chars = F.split(t, "")
    table = F.create_map(*[F.lit(x) for kv in [*LATEX.items(), ("\\", r"\textbackslash{}")] for x in kv])
    return F.array_join(F.transform(chars, lambda c: F.coalesce(F.element_at(table, c), c)), "")


def bin_label(b: Column, size: int) -> Column:
    return F.format_string("%d (%d-%d)", b, b * size, (b + 1) * size - 1)
