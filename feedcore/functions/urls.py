"""URL expressions: link resolution, outlet names, source trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedcore.rules import RuleBook


def law_url(link: Column, name: Column, base: str, article_path: str) -> Column:
    """Root-relative link below ``base``, any other link as it is, none by law name."""
    return (
        F.when(F.startswith(link, F.lit("/")), F.concat(F.lit(base), link))
        .when(link != "", link)
        .otherwise(F.concat(F.lit(base + article_path), name))
    )


def site_url(href: Column, base: str, fallback: Column | str) -> Column:
    """Root-relative below ``base``, ``http...`` as it is, anything else ``fallback``."""
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    return (
        F.when(F.startswith(href, F.lit("/")), F.concat(F.lit(base), href))
        .when(F.startswith(href, F.lit("http")), href)
        .otherwise(other)
    )


def script_id(href: Column, pattern: str, groups: int = 1) -> Column:
    """Id inside a ``javascript...`` link; empty if the link is none or has none."""
    found = F.coalesce(
        *[F.nullif(F.regexp_extract(href, pattern, g), F.lit("")) for g in range(1, groups + 1)],
        F.lit(""),
    )
    return F.when(F.startswith(href, F.lit("javascript")), found).otherwise(F.lit(""))


def script_or(href: Column, pattern: str, view: str | Column, otherwise: Column, groups: int = 1) -> Column:
    """``view`` + id for script links with an id, else ``otherwise``."""
    found = script_id(href, pattern, groups)
    prefix = F.lit(view) if isinstance(view, str) else view
    return F.when(found != "", F.concat(prefix, found)).otherwise(otherwise)


def join_url(origin: str, href: Column) -> Column:
    """Resolve ``href`` against a bare origin such as ``https://host``."""
    scheme = origin.split(":", 1)[0]
    path = F.regexp_extract(href, r"(?s)^[^?#]*", 0)
    rest = F.substr(href, F.length(path) + 1)
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    climbed = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda kept, s: F.when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
        .when(s == ".", kept)
        .otherwise(F.array_append(kept, s)),
    )
    # A path that ends in a dot segment names a folder.
    folder = F.when(path.rlike(r"(?:^|/)\.{1,2}$") & (F.size(climbed) > 0), F.lit("/")).otherwise(F.lit(""))
    resolved = F.concat(F.lit("/"), F.array_join(climbed, "/"), folder, rest)
    return (
        F.when(href == "", F.lit(origin))
        .when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.lit(scheme + ":"), href))
        .when(path == "", F.concat(F.lit(origin), href))
        .otherwise(F.concat(F.lit(origin), resolved))
    )


def outlet_from_url(url: Column, portal: str, default: str) -> Column:
    """First host label after an optional ``www.``; the portal and no match give ``default``."""
    label = F.regexp_extract(url, r"https?://(?:www\.)?([^./]+)", 1)
    return F.when(F.contains(url, F.lit(portal)) | (label == ""), F.lit(default)).otherwise(label)


def _first_trust_rule(lowered_url: Column, rules: RuleBook) -> Column:
    """Index of the first rule whose fragment is anywhere in the URL, else null.

    This is not a match of host names.
    """
    chain = None
    for i, rule in enumerate(rules.trust):
        test = lowered_url.contains(rule.fragment)
        chain = F.when(test, F.lit(i)) if chain is None else chain.when(test, F.lit(i))
    return F.lit(None).cast("int") if chain is None else chain


def with_trust(
    df: DataFrame,
    rules: RuleBook,
    url: str = "url",
    score: str | None = "trust",
    name: str | None = None,
) -> DataFrame:
    """Add trust score and/or trusted name of each row's URL.

    The URL is lower-cased once and matched once; score and name are then looked
    up by the matched rule.  Names are null where no rule matches.
    """
    lowered = F.lower(F.coalesce(F.col(url), F.lit("")))
    out = df.withColumn("_url", lowered).withColumn("_rule", _first_trust_rule(F.col("_url"), rules))
    if score:
        scores = F.array(*[F.lit(t.score) for t in rules.trust]).cast("array<int>")
        out = out.withColumn(
            score, F.coalesce(F.get(scores, F.col("_rule")), F.lit(rules.default_trust))
        )
    if name:
        names = F.array(*[F.lit(t.name) for t in rules.trust]).cast("array<string>")
        out = out.withColumn(name, F.get(names, F.col("_rule")))
    return out.drop("_url", "_rule")
