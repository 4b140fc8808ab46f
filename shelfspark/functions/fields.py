"""What is a title, a breadcrumb, a description, a price, a tag: tests and clean-up of single fields as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import best_price

#: Openings of promotional lines.
FLUFF = r"(?i)^(shop |buy |get |order |see all |view all |free shipping|sale|limited time|exclusive)"
#: Whole texts that belong to navigation.
NAVIGATION = [r"(?i)^(home|shop|products|categories|menu|search|cart|account)$", r"(?i)^(sign in|log in|register|checkout)$", r"^[<>]+$", r"^\d+$"]
#: Crumbs that name no category, crumbs of error pages, and words in front of a crumb.
JUNK_CRUMB = r"(?i)^(back|return|previous|shop|shop all|store|all products|products|all categories|categories|main menu|menu|start|index|root|←|→|‹|›)$"
ERROR_CRUMB = "(?i)404|not found|error|page not found|oops|sorry"
CRUMB_LEAD = r"(?i)^(go to|goto|back to|return to)\s*"
#: Marks of debug messages.
DEBUG_MARKS = ["🔍", "🎯", "✅", "❌", "📉", "🖼️", "🔄", "✨", "📍", "🧩", "💰", "📝", "🏷️", "📄", "🚀", "⚠️", "🔧", "💾", "DEBUG", "TRACE", "CALL TRACE", "RELEVANCE", "HYBRID FILTERING"]
#: Phrases of a page that sells.
SELLING = ["add to cart", "add to bag", "buy now", "in stock", "out of stock", "select size"]
#: Tag types by a word that the tag holds, in order.
TAG_TIERS = [
    ("materials", "leather|suede|cotton|wool|silk|denim|nylon|polyester|canvas|mesh|fleece|cashmere|linen|bamboo|velvet"),
    ("colors", "black|white|blue|red|green|brown|navy|indigo|gray|grey|beige|tan|yellow|orange|pink|purple|gold|silver|cream|ivory"),
    ("fit", "fit|tapered|relaxed|slim|loose|tight|oversized|petite|plus-size"), ("styles", "casual|formal|athletic|vintage|modern|minimalist|boho|preppy|streetwear|elegant"),
    ("activities", "workout|gym|running|hiking|yoga|cycling|swimming|golf|tennis|basketball"),
]
#: Sites with rules of their own, in order.
SITES = [
    ("amazon", r"(^|\.)amazon\."), ("boohoo", r"\bboohoo(man)?\.com$"), ("costco", r"\bcostco\.com$"), ("homedepot", r"\bhome(depot)?\.com$"), ("macys", r"\bmacys\.com$"), ("dsw", r"\bdsw\.com$"), ("nordstrom", r"\bnordstrom\.com$"), ("express", r"\bexpress\.com$"),
    ("fashionnova", r"\bfashionnova\.com$"), ("acehardware", r"\bacehardware\.com$"), ("allbirds", r"allbirds\.com$"), ("bonbonbon", r"\bbonbonbon\.com$"), ("chewy", r"\bchewy\.com$"), ("larq", r"(^|\.)((live)?larq\.com)$"), ("nike", r"(^|\.)nike\.com$"), ("adidas", r"(^|\.)adidas\.com$"),
    ("aliexpress", r"(^|\.)aliexpress\.(com|us)$"), ("ae", r"(^|\.)ae\.com$|(^|\.)americaneagle\.com$"), ("asos", r"(^|\.)asos\.com$"), ("urbanoutfitters", r"urbanoutfitters\.com$"), ("bestbuy", r"\bbestbuy\.com$"), ("etsy", r"(^|\.)etsy\.com$"), ("lululemon", r"shop\.lululemon\.com$"),
]
#: The keys of structured data that describe a product.
LD_KEYS = ("name", "category", "gender", "color", "material", "brand", "sku", "productID", "model", "style", "audience", "caption", "description", "text", "about", "summary")


def is_fluff(text: Column) -> Column:
    """A text too short for a description, or a promotional line."""
    return F.coalesce((F.length(text) < 20) | F.trim(text).rlike(FLUFF), F.lit(True))


def is_navigation(text: Column) -> Column:
    return F.trim(text).rlike("|".join(f"(?:{p})" for p in NAVIGATION))


def is_breadcrumb(text: Column, n_items: Column) -> Column:
    return F.coalesce((F.length(text) >= 5) & text.rlike("[›>/|»,]") & n_items.between(2, 8), F.lit(False))


def clean_crumbs(items: Column) -> Column:
    """Crumbs cut where words were run together or separators stand, without leads, entities, and words that name no category."""
    some = F.filter(items, lambda x: x.isNotNull())
    apart = F.transform(some, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i)\b(Back|Return|Previous)(Home|Shop|Store)\b", "$1/$2"), "([a-z])([A-Z])", "$1/$2"))
    parts = F.flatten(F.transform(apart, lambda x: F.split(x, r"\s*[/>|›»,]\s*")))
    clean = F.transform(parts, lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(F.regexp_replace(x, "^/+|/+$", "")), CRUMB_LEAD, "")), "(?i)&[a-z]+;", "")))
    clean = F.filter(clean, lambda x: x != "")
    return F.filter(clean, lambda x, i: ~x.rlike(JUNK_CRUMB) & ~x.rlike(ERROR_CRUMB) & ~((i == 0) & (F.lower(x) == "home")))


def split_crumbs(text: Column) -> Column:
    return F.filter(F.split(text, r"\s*[/>|›»]\s*"), lambda x: x != "")


def is_debug(message: Column) -> Column:
    hit = F.lit(False)
    for m in DEBUG_MARKS:
        hit = hit | message.contains(m)
    return hit


def selling_phrases(text: Column) -> Column:
    low = F.lower(text)
    return sum((low.contains(p).cast("int") for p in SELLING), F.lit(0))


def tag_type(name: Column) -> Column:
    """The type of a tag that no dictionary knows."""
    low, out = F.lower(name), F.lit("features")
    for kind, words in reversed(TAG_TIERS):
        out = F.when(low.rlike(words), kind).otherwise(out)
    return out


def site_of(host: Column) -> Column:
    out = F.lit(None).cast("string")
    for site, pattern in reversed(SITES):
        out = F.when(host.rlike(f"(?i){pattern}"), site).otherwise(out)
    return out


def shown_number(x: Column) -> Column:
    """A number as a page shows it: whole ones without a point."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def sale_price(s: Column) -> Column:
    return shown_number(best_price(s))


def refined_price(attribute: Column, base: Column, around: Column) -> Column:
    """The attribute's price; else the plausible one found first; else of the texts around, nearest first, the first plausible
    price of the first three, one with decimals before others."""
    near = F.filter(F.transform(F.slice(around, 1, 3), best_price), lambda x: x.between(1, 100000))
    cents = F.filter(near, lambda x: x % 1 != 0)
    return F.coalesce(attribute.try_cast("double"), F.when(base.between(1, 100000), base), F.get(cents, F.lit(0)), F.get(near, F.lit(0)))


def described(ld: str = "ld") -> Column:
    """Of structured data (a VARIANT column) the keys that describe the product, as JSON."""
    return F.to_json(F.struct(*[F.try_variant_get(ld, f"$.{k}", "string").alias(k) for k in LD_KEYS]))


def ld_images(ld: str = "ld") -> Column:
    """image or images of structured data: a list, or one."""
    each = [F.coalesce(F.try_variant_get(ld, f"$.{k}", "array<string>"), F.when(F.try_variant_get(ld, f"$.{k}", "string").isNotNull(), F.array(F.try_variant_get(ld, f"$.{k}", "string")))) for k in ("image", "images")]
    return F.filter(F.coalesce(*each, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def parsed_candidates(answer: Column) -> Column:
    """The first four strings that a model's answer proposes: of its "candidates", else of the list that stands in it."""
    listed = F.regexp_extract(answer, r"(?s)\[.*\]", 0)
    texts = lambda json: F.filter(F.transform(F.from_json(json, "array<variant>"), lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))), lambda x: x.isNotNull())
    return F.slice(F.coalesce(texts(F.get_json_object(answer, "$.candidates")), texts(F.when(listed != "", listed)), F.array().cast("array<string>")), 1, 4)


def cut(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)
