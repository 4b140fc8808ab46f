"""String, URL, price and path functions as Column expressions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(c: Column) -> Column:
    return F.trim(F.lower(c))


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def slug(c: Column) -> Column:
    """Runs of other characters become one hyphen; one hyphen goes at each end."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(c)), "[^a-z0-9]+", "-"), "^-|-$", "")


def space_slug(c: Column) -> Column:
    """The other slug: only white space becomes a hyphen, so ``men's`` stays."""
    return F.regexp_replace(F.lower(c), r"\s+", "-")


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def safe_host(url: Column) -> Column:
    return F.regexp_replace(host(url), "[^a-zA-Z0-9.-]", "_")


def url_key(url: Column) -> Column:
    return F.concat_ws("_", safe_host(url), F.md5(url))


def url_keywords(url: Column) -> Column:
    """Words of the path, without extensions and without codes of eight or more letters and digits."""
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda x: x != "")
    parts = F.transform(parts, lambda x: F.regexp_replace(x, r"(?i)\.(html|php|aspx)$", ""))
    return F.regexp_replace(F.array_join(F.filter(parts, lambda x: ~x.rlike("(?i)^[A-Z0-9]{8,}$")), " "), "[-_]", " ")


def absolute_url(u: Column, page: Column) -> Column:
    scheme, root = F.try_parse_url(page, F.lit("PROTOCOL")), F.try_parse_url(page, F.lit("HOST"))
    folder = F.regexp_replace(F.regexp_replace(page, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    return (
        F.when(u.rlike("(?i)^[a-z][a-z0-9+.-]*:"), u).when(u.startswith("//"), F.concat(scheme, F.lit(":"), u))
        .when(u.startswith("/"), F.concat(scheme, F.lit("://"), root, u)).otherwise(F.concat(folder, F.lit("/"), u))
    )


def canonical_image_key(u: Column) -> Column:
    """Without query, fragment, transform parameters in the path and pixel sizes in the file name."""
    bare = F.regexp_replace(u, r"[?#].*$", "")
    bare = F.regexp_replace(bare, r"/(w|h|c|q|dpr|ar|f)_[^/]+", "/")
    return F.regexp_replace(bare, r"_\d+x\d*(?=[^/]*$)", "")


def best_of_srcset(s: Column) -> Column:
    """The widest of a set with widths (first on ties), else its first URL."""
    entries = F.filter(F.transform(F.split(s, r",\s+|,(?=https?:)"), lambda x: F.trim(x)), lambda x: x != "")
    parsed = F.transform(entries, lambda x, i: F.struct(F.coalesce(F.regexp_extract(x, r"\s(\d+)w$", 1).try_cast("int"), F.lit(-1)).alias("w"), (-i).alias("i"), F.regexp_extract(x, r"^\S+", 0).alias("u")))
    wide = F.array_max(F.filter(parsed, lambda x: x["w"] > 0))
    return F.coalesce(wide["u"], F.get(F.transform(parsed, lambda x: x["u"]), F.lit(0)))


#: The currency codes that may stand before an amount.
CURRENCIES = "USD|EUR|GBP|AUD|CAD|NZD|CHF|JPY|CNY|RMB|INR|SAR|AED"
_AMOUNT = r"\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?"
_SIGN = r"\p{Sc}"


def money_tokens(s: Column) -> Column:
    """Amounts next to a currency sign or code, as positive doubles; the last of comma and dot is the decimal sign."""
    raw = F.regexp_extract_all(s, F.lit(rf"(?i)(?:\b(?:{CURRENCIES})\b|{_SIGN})\s*{_AMOUNT}|{_AMOUNT}\s*{_SIGN}"), F.lit(0))

    def number(token: Column) -> Column:
        t = F.regexp_replace(token, "[^0-9.,]", "")
        comma, dot = F.length(F.substring_index(t, ",", -1)), F.length(F.substring_index(t, ".", -1))
        has_c, has_d = t.contains(","), t.contains(".")
        european = F.regexp_replace(F.regexp_replace(t, r"\.", ""), ",", ".")
        plain = F.regexp_replace(t, ",", "")
        decimal_comma = (comma == 2) & ~t.rlike(r",\d{3}")
        n = F.when(has_c & has_d, F.when(comma < dot, european).otherwise(plain)).when(has_c, F.when(decimal_comma, F.regexp_replace(t, ",", ".")).otherwise(plain)).otherwise(t)
        return F.regexp_extract(n, r"^\d*\.?\d*", 0).try_cast("double")

    return F.filter(F.transform(raw, number), lambda n: n > 0)


def best_price(s: Column) -> Column:
    """The price to pay in a text: former prices are left out, split cents are joined, the least plausible amount wins."""
    t = F.regexp_replace(s, rf"(?i)(was|list|regular|original|compare|msrp|retail)\s*:?.{{0,20}}?[{_SIGN}A-Z]{{0,3}}\s*\d[\d.,]*", "")
    t = F.regexp_replace(t, rf"({_SIGN}\s*\d{{1,3}}(?:[.,]\d{{3}})*)[^\d]{{1,3}}(\d{{2}})\b", "$1.$2")
    t = F.regexp_replace(t, rf"({_SIGN}\s*)(\d{{2,4}})(\d{{2}})(?![.,]\d{{2}})(?=\D|$)", "$1$2.$3")
    money = money_tokens(t)
    plausible = lambda a: F.filter(a, lambda x: x.between(5, 100000))
    decimals = F.filter(money, lambda x: x % 1 != 0)
    from_money = F.coalesce(F.array_min(plausible(money)), F.array_min(decimals), F.array_min(money))
    signed = t.rlike(rf"(?i){_SIGN}|{CURRENCIES}")
    bare = F.transform(F.regexp_extract_all(t, F.lit(r"(\d+(?:\.\d+)?)(?!\s*%)"), F.lit(1)), lambda x: x.try_cast("double"))
    bare = F.filter(bare, lambda x: (x > 0) & ~(signed & x.between(100, 999) & (x % 1 == 0)))
    fallback = F.coalesce(F.array_min(plausible(bare)), F.array_min(bare))
    return F.when(~s.rlike("(?i)see price in cart|add to cart to see price|price shown in cart"), F.coalesce(from_money, fallback))


def saved_price(s: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(s, "[^0-9.]", ""), r"^\d*\.?\d*", 0).try_cast("double").cast("decimal(12,2)")


def split_breadcrumbs(s: Column) -> Column:
    parts = F.when(s.contains(","), F.split(s, ",")).otherwise(F.split(s, r"\s{2,}"))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def drop_title_crumb(crumbs: Column, title: Column) -> Column:
    last = F.lower(F.element_at(crumbs, -1))
    return F.when((F.size(crumbs) > 0) & last.contains(F.lower(F.substring(title, 1, 30))), F.slice(crumbs, F.lit(1), F.size(crumbs) - 1)).otherwise(crumbs)


def drop_repeats(path: Column) -> Column:
    """Without a segment that equals the one before it."""
    return F.filter(path, lambda x, i: (i == 0) | (x != F.get(path, i - 1)))
