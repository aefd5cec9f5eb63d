"""Text columns as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def html_to_text(html: Column) -> Column:
    """Scripts, styles, comments and tags go; the five common entities and &nbsp; are decoded; white space is collapsed."""
    c = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(text: Column) -> Column:
    """Maximal runs of letters and digits of the lower-cased text."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def stripped_md5(text: Column) -> Column:
    """The MD5 in hex with a leading zero of each byte left out."""
    h = F.md5(text)
    byte = lambda i: F.when(F.substr(h, 2 * i - 1, F.lit(1)) == "0", F.substr(h, 2 * i, F.lit(1))).otherwise(F.substr(h, 2 * i - 1, F.lit(2)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(16)), byte), "")
