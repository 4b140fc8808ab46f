"""Image URLs as Column expressions: which are images, which are junk, what a larger version is called, how good one is."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs of an image in a URL.
IMAGE_SIGNS = [
    r"\.(?:jpg|jpeg|png|webp|gif|avif)(?:$|\?)", r"\b(format|fm)=(jpg|jpeg|png|webp|gif|avif)\b", r"\b(quality|max|w|h|width|height|resize|scale|crop)=[0-9]", r"\?\$[a-z0-9_-]+", r"[?&]\$[a-z0-9_-]*",
    r"\b(mozu\.com|shopify\.com|cloudinary\.com|imgix\.net|fastly\.com|amazonaws\.com/.*/(images?|media|assets)|cloudfront\.net|asos-media\.com|scene7\.com)\b", r"/(images?|media|assets|photos?|pics?|gallery|products)/",
]
#: URLs that are never product images.
JUNK = (
    r"(\.svg($|\?))|sprite|/logo[._-]|icon|badge|placeholder|thumb|spinner|loading|prime|favicon|video\.jpg|judgeme\.imgix\.net|\b(visa|mastercard|paypal|amex|discover|apple-?pay|google-?pay|klarna|afterpay|jcb|unionpay|maestro|diners-?club)\b"
    r"|(payment|credit-?card|pay-?method|checkout|billing|shipping|warranty|trial|interest[-_]?free|premium[-_]?materials?|hypoallergenic)[-_]?(icon|logo|img|image|badge)"
)
ENCODED = r"/[A-Za-z0-9+/_]{80,}(?==|$|\?)"
#: Pattern and reason.
JUNK_REASONS = [
    (r"_web\.png", "Feature icon"), ("_modal_", "Material swatch"), (r"yotpo\.com", "Review image"), (r"-\d{3}\.png", "Technical sample"), ("(boucle|basketweave|velvet)", "Fabric pattern"),
    ("cushion-image", "Component image"), (r"cld\.accentuate\.io", "Accentuate CDN junk"), ("(shop.?nav|memorial|collection|kova.?box|cust_)", "Navigation/collection junk"),
]
#: Classes and ids of sections that show other products.
OTHER_PRODUCTS = r"\b(related|recommendation|you-might|also-like|similar|suggested|trending|popular-products|recently-viewed)\b"
NOT_PRODUCT = "logo|icon|sprite|badge|flag|header|footer|nav|menu|1x1|placeholder|loading"
#: Hosts whose images are kept whatever their size.
TRUSTED = r"adoredvintage\.com|cdn-tp3\.mozu\.com|assets\.adidas\.com|cdn\.shop|shopify|cloudfront|amazonaws|scene7"


def _hit(u: Column, low: Column, pattern: str) -> Column:
    """Whether the pattern is found in u, whatever the case. low: u in lower case, which is first searched for the literals of which
    every find holds one (NEEDLES): most URLs have none of them, and a search for a literal costs a fraction of a pattern's."""
    return _holds(low, *NEEDLES[pattern]) & u.rlike(f"(?i){pattern}")


def _holds(low: Column, *needles: str) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(n) for n in needles])


def _bound(f: Callable[[Column], Column], **known: Column) -> Column:
    """f of a struct whose fields are evaluated once, however often f names them: the function of an array's one element. The result
    stands in a struct, which is never null: of anything else Spark asks row by row whether it may be, all the way down."""
    return F.transform(F.array(F.struct(*[c.alias(k) for k, c in known.items()])), lambda x: F.struct(f(x).alias("v")))[0]["v"]


def _number(u: Column, pattern: str, group: int = 1) -> Column:
    """The number that the pattern's group finds first, or null. Casting what regexp_extract returns where nothing is found, an empty
    text, would make and catch an exception for each row."""
    return F.get(F.regexp_extract_all(u, F.lit(pattern), F.lit(group)), F.lit(0)).try_cast("int")


def looks_like_image(u: Column) -> Column:
    return F.coalesce(~u.rlike("(?i)^data:") & u.rlike("(?i)" + "|".join(f"(?:{p})" for p in IMAGE_SIGNS)), F.lit(False))


def is_real_url(u: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [u.startswith(x) for x in ("https://", "http://", "www.", "/")]), F.lit(False))


def blocked_shop_file(u: Column) -> Column:
    """Files of a shop's theme, told from product images by name and size."""
    theme = u.rlike(r"(?i)(logo|icon|sprite|theme|favicon|nav|header|footer|menu|swatch)\.")
    sized = u.rlike(r"(?i)_\d{3,4}x[\d.]*\.progressive\.|_\d{3,4}x\d{3,4}")
    named = F.element_at(F.split(u, "/"), -1).rlike("(?i)^(theme|logo|icon|nav|menu|header|footer|sprite|favicon)")
    return u.rlike("(?i)/cdn/shop/files/") & (theme | ~sized & named)


def junk_reason(u: Column, low: Column | None = None) -> Column:
    """Why an image is left out, or null. low: u in lower case, where the caller has it."""
    low = F.lower(u) if low is None else low
    out = F.when(F.coalesce(u, F.lit("")) == "", "empty URL").when(low.contains("/cdn/shop/files/") & blocked_shop_file(u), "Shopify theme asset")
    for pattern, reason in JUNK_REASONS:
        out = out.when(_hit(u, low, pattern), reason)
    return out


def is_junk(u: Column, low: Column | None = None) -> Column:
    return _hit(u, F.lower(u) if low is None else low, JUNK) | (F.length(u) > 80) & u.rlike(ENCODED)


def among_other_products(classes_and_ids: Column) -> Column:
    """Of the classes and ids of an element and its ancestors, nearest first: whether one of the first three is such a section."""
    return F.exists(F.slice(classes_and_ids, 1, 3), lambda c: F.lower(c).rlike(OTHER_PRODUCTS))


def is_product_image(u: Column) -> Column:
    return ~u.rlike(f"(?i){NOT_PRODUCT}")


def last_of_srcset(s: Column) -> Column:
    return F.regexp_extract(F.trim(F.element_at(F.split(s, ","), -1)), r"^\S+", 0)


def last_url_of_srcset(s: Column) -> Column:
    """For sets whose URLs hold commas."""
    return F.try_element_at(F.regexp_extract_all(s, F.lit(r"https://[^\s]+"), F.lit(0)), F.lit(-1))


def pixel_count(u: Column) -> Column:
    two = lambda p: F.regexp_extract(u, p, 1).try_cast("long") * F.regexp_extract(u, p, 2).try_cast("long")
    one = F.regexp_extract(u, r"(?i)_(\d+)x", 1).try_cast("long")
    return F.coalesce(*[two(f"(?i){p}") for p in (r"s(\d+)x(\d+)", r"(\d+)x(\d+)(?:_|\.|$)", r"w(\d+)_h(\d+)", r"w(\d+)xh(\d+)")], one * one, F.lit(0))


def without_dimensions(u: Column) -> Column:
    for p in (r"s(\d+)x(\d+)", r"(\d+)x(\d+)(?:_|\.|$)", r"w(\d+)_h(\d+)", r"w(\d+)xh(\d+)", r"_(\d+)x"):
        u = F.regexp_replace(u, p, "")
    return u


def image_product_id(u: Column) -> Column:
    return F.nullif(F.regexp_extract(u, r"[/_]([a-zA-Z0-9]{6,11})_", 1), F.lit(""))


def page_product_id(path: Column) -> Column:
    """By the first of the shops' URL patterns that fits; null if none does."""
    patterns = (r"(?i)/([A-Z0-9]+)\.html", r"/prd-(\d+)/", r"/product/([^/]+)", r"/dp/([^/]+)", r"/A-(\d+)", r"/products/([^/]+)")
    return F.coalesce(*[F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for p in patterns])


def product_keywords(path: Column) -> Column:
    """Words of the last descriptive segment of a URL's path."""
    descriptive = lambda x: ~x.rlike(r"(?i)^[A-Z0-9_-]{3,15}$|\.(html?|php|aspx?)$") & (x.contains("-") | (F.length(x) > 15))
    segment = F.coalesce(F.try_element_at(F.filter(F.split(path, "/"), descriptive), F.lit(-1)), F.lit(""))
    return F.transform(F.filter(F.split(F.regexp_replace(segment, "[._]", "-"), "-"), lambda x: (F.length(x) > 3) & ~x.rlike(r"^\d+$")), lambda x: F.lower(x))


def relevance(u: Column, selector: Column, product_id: Column, keywords: Column) -> Column:
    s = F.lower(selector)
    place = F.when(s.rlike("product-(main|gallery|primary|media)|primary-image"), 100).when(s.rlike("zoom|photoswipe|panzoom|swiper|splide|slide"), 75).when(s.rlike("recommendation|related|cross-sell|upsell|similar|suggested"), -50).otherwise(0)
    name = F.regexp_replace(F.lower(u), "[^a-z0-9]", " ")
    return place + F.when(image_product_id(u) == product_id, 50).otherwise(0) + 50 * F.size(F.filter(keywords, lambda k: name.contains(k)))


def amazon_large(u: Column) -> Column:
    """An image of that host without crop, in the large size."""
    out = F.regexp_replace(F.substring_index(u, "?", 1), "(?i)%2B", "+")
    for p, to in ((r"_CR\d+,\d+,\d+,\d+_", "_"), (r"_(SR|SX|SY|SS)\d+,\d+_", "_"), (r"_(AC|SL|SX|SY|SR|SS|UX|UY|FM|UL|US)\d+(?:,\d+)*_", "_SL1500_")):
        out = F.regexp_replace(out, p, to)
    return out


def amazon_key(u: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(u, r"^.*/I/", ""), r"\._.*$", "")


def amazon_quality(u: Column) -> Column:
    n = F.regexp_extract(u, r"/I/(\d{2})", 1).try_cast("int")
    return F.when(n >= 81, 90).when(n >= 71, 80).when(n >= 61, 60).when(n >= 51, 40).when(n >= 41, 20).when(n.isNotNull(), 10).otherwise(0)


#: Guard, pattern, replacement; guards test the URL as given, rewrites act one after another.
CDN_RULES = [
    (r"images\.urbndata\.com/is/image", r"\$(a15-)?pdp-detail-shot\$", r"\$redesign-zoom-5x\$"),
    (r"images\.urbndata\.com/is/image", r"(?i)[?&](wid=\d+|hei=\d+|fit=constrain|qlt=\d+)", ""),
    (r"bjs\.scene7\.com/is/image", r"\$bjs-[^$]+\$", r"\$bjs-zoom\$"),
    (r"coach\.scene7\.com/is/image", r"\$desktopThumbnail\$", r"\$desktopProductZoom\$"),
    (r"coach\.scene7\.com/is/image", r"^(?!.*wid=)(.*\?.*)$", "$1&wid=2000&qlt=90&op_usm=1.0,1.0,0.0,0"),
    (r"coach\.scene7\.com/is/image", r"^(?!.*wid=)([^?]*)$", "$1?wid=2000&qlt=90&op_usm=1.0,1.0,0.0,0"),
    (r"s7d2\.scene7\.com.*aeo", r"\$pdp-mdg-opt\$", r"\$pdp-md-opt\$"),
    (r"mediahub\.boohooman\.com", r"(?i)([?&])w=(?:\d{1,3}&h=\d+|\d+&h=(?:\d{1,3}|1[0-4]\d{2}))(?!\d)", "$1w=1000&h=1500"),
    (r"/cdn/shop/|cdn\.shopify\.com", r"(?i)_\d{2}x(\.|\?|$)", "_1020x$1"),
    (r"/cdn/shop/|cdn\.shopify\.com", r"(?i)_[1-9]\d{2}x(\.|\?|$)", "_1020x$1"),
    (r"/cdn/shop/|cdn\.shopify\.com", r"(?i)_[1-9]\d{2}x(?:\d{3}|0\d{3}|10[01]\d)(?!\d)", "_1020x1020"),
    (r"cdn\.shocho\.co", r"(?i)\?i10c=img\.resize\([^)]+\)", ""),
    (r"cdn-tp3\.mozu\.com", r"(?i)\?max=\d+", "?quality=60"),
    (r"cdn-tp3\.mozu\.com", r"(?i)(\?quality=\d+).*$", "$1"),
    (r"content\.backcountry\.com/images/items/large/", r"(?i)/large/", "/1200/"),
    (r"media\.kohlsimg\.com", r"(?i)([?&])(wid|hei)=\d+", "$1$2=1500"),
    (r"res\.cloudinary\.com", r"w_(?:\d{1,2}|[1-4]\d{2}|500)(?!\d)", "w_1280"),
    (r"thereformation\.com", r"/w_(?:\d{1,2}|[1-4]\d{2}|500)/", "/w_1000/"),
    (r"thereformation\.com", r"/dpr_2\.0/", "/dpr_3.0/"),
    (r"i\.etsystatic\.com", r"il_(300x300|340x270|500x400|600x480)", "il_1200x1200"),
    (r"ikea\.com/.*/images/", r"\?f=(xxs|xs|s|m|l|xxl|xl|u)", "?f=xxxl"),
    (r"ikea\.com/.*/images/", r"(?i)^(?!.*\?f=)(?=.*\.(?:jpg|png|webp))(.*\?.*)$", "$1&f=xxxl"),
    (r"ikea\.com/.*/images/", r"(?i)^(?!.*\?f=)(?=.*\.(?:jpg|png|webp))([^?]*)$", "$1?f=xxxl"),
    (r"prodimg/\d+/", r"(?i)/\d+\.jpg$", "/900.jpg"),
    (r"prodimg/\d+/", r"(?i)/(\d+)_\d+\.jpg$", "/$1_900.jpg"),
    (r"ltwebstatic\.com", r"(?i)_thumbnail_\d+x\d*(?=\.)", ""),
    (r"kwcdn\.com", r"/w/(?:\d{1,3}|1[01]\d{2})/", "/w/1200/"),
    (r"kwcdn\.com", r"/q/[0-8]?\d/", "/q/90/"),
    (r"asset\.swarovski\.com", r"(?i)\$size_\d+", r"\$size_2000"),
    (r"asset\.swarovski\.com", r"(?i)\bw_(?:\d{1,3}|1\d{3})(?!\d)", "w_2000"),
    (r"revolveassets\.com/images/p4/n/ct/", r"(?i)/ct/", "/uv/"),
]


def _rewritten(u: Column, rules: list[tuple[str, str, str]]) -> Column:
    for _, pattern, to in rules:
        u = F.regexp_replace(u, pattern, to)
    return u


#: Rules of one guard stand together.
_GROUPS = [(g, list(rs)) for g, rs in groupby(CDN_RULES, lambda r: r[0])]
_SQUARE = r"prodimage\.images-bn\.com"


def upgrade_cdn(u: Column) -> Column:
    """The large version of an image URL. Most hosts have no rule and leave after a search for their names; a host with rules gets its
    own, whose patterns are literals; a URL that two guards fit gets the rules of both, one after another."""
    fits = lambda x: {f"f{k}": _hit(x["u"], x["low"], g) for k, g in enumerate([*[g for g, _ in _GROUPS], _SQUARE])}
    one = _bound(lambda x: _bound(_upgraded, u=x["u"], **fits(x)), u=u, low=F.lower(u))
    tidy = F.regexp_replace(F.regexp_replace(one, r"\?(&|$)", ""), "&$", "")
    return F.when(u.isNotNull(), tidy)


def _upgraded(x: Column) -> Column:
    u, fits, square_host = x["u"], [x[f"f{k}"] for k in range(len(_GROUPS))], x[f"f{len(_GROUPS)}"]
    both = u
    for (_, rules), fit in zip(_GROUPS, fits):
        for _, pattern, to in rules:
            both = F.regexp_replace(both, F.when(fit, pattern).otherwise("(?!)"), F.lit(to))
    out = F.when(sum((f.cast("int") for f in fits), F.lit(0)) > 1, both)
    for (_, rules), fit in zip(_GROUPS, fits):
        out = out.when(fit, _rewritten(u, rules))
    square = F.greatest(_number(u, r"(?i)s(\d+)x\d+"), _number(u, r"(?i)s\d+x(\d+)")).cast("string")
    return out.when(square_host & square.isNotNull(), F.regexp_replace(u, F.lit(r"(?i)s\d+x\d+"), F.concat(F.lit("s"), square, F.lit("x"), square))).otherwise(u)


#: Points for a URL that a pattern is found in.
URL_POINTS = [
    (10, r"\.(webp|avif)($|\?)"), (10, r"(format|fm)=(webp|avif)"), (8, "f_auto"), (25, r"\b(assets?|static|cdn|media|img)\."), (15, r"\b(mozu\.com|cloudinary\.com|imgix\.net|shopify\.com|fastly\.com)\b"),
    (40, r"\b[A-Z]\d{4}[A-Z]?\b"), (20, r"\bproduct"), (15, "/(product|main|hero|detail|primary)"), (-30, "/(thumb|small|mini|icon)"), (40, "/PDP_|_PDP_|product-detail"), (-40, "/PLP_|_PLP_|product-list"),
    (-70, r"\b(womens?-clothing|mens?-clothing|best-sellers?|new-arrivals?|accessories|shop-by|featured-edit|wellness|searchburger)\b"), (-150, r"_NAV_|/NAV/|-NAV-|NAV_WOMEN|NAV_MEN|NAV_DESK|_DESK(?:TOP)?_|LIFESTYLE_DESK|JOURNAL_|STORES_NAV"),
    (-200, "(flyout|banner|advertisement|campaign|marketing|bullet-point|feedback)"), (-200, r"\b(ad|logo|bg|background|header|footer|nav|navigation|menu|sidebar)\b"), (-80, r"\b(sprite|icon|badge|placeholder|loading|spinner|pixel\.gif|grey-pixel)\b"),
    (-10, "logo"), (-55, r"\b(warranty|insurance|coverage|support|claim)\b"), (-45, "aicid=community"), (-45, "community-reviews"),
]
#: Patterns of a size in a URL; the largest counts.
SIZES = [r"(?:max|w|width|imwidth|imageWidth)=([0-9]+)", r"_(\d+)x\d*(?:_|\.|$)", r"(\d+)x\d+(?:_|\.|$)", r"\b([0-9]{3,4})(?:w|h|px)(?:_|\.|$)", r"[?&]\$n_(\d+)w?\b", r"[wh](\d+)_"]
#: Points for the selector and for class and id of the element.
CLASS_POINTS = [
    (50, r"\b(main|hero|primary|featured|gallery-main|product-gallery|media-gallery|image-gallery|product-media|slideshow|carousel|zoom-gallery)\b"), (35, r"\b(gallery|product-thumb|media-item|slide-item|zoom-item)\b"),
    (-10, r"\b(thumb|thumbnail|small|mini|icon)\b"), (-60, r"\b(banner|ad|sidebar|nav|navigation|header|footer|menu|cross-sell|upsell|related|recommended)\b"), (-70, "nav-|-nav|Sept.*Nav"),
]
GOOD_SELECTOR = "modal-opener|product__modal|zoom-gallery|product-gallery|slideshow-main|carousel-product|media-viewer|product__media-viewer|detail_zoom|prd-detail|detail.*zoom"
FAIR_SELECTOR = "slidecount|mainimage|main-image|primary.*image|slideshow|carousel-main|gallery-container|detail|zoom"
BAD_SELECTOR = "lb-spc|lightbox.*shop|recommendation|cross-sell|related-products|you-may-also|recently-viewed|upsell-product|prd-card|card_imagecontainer|product-card|item-card"


#: Truck and the like in a PNG's name.
NOT_SHOWN = r"\b(truck|delivery|hanger)\b"
#: Literals, in lower case, of which every find of a pattern holds at least one.
NEEDLES = {
    JUNK: (".svg", "sprite", "/logo", "icon", "badge", "placeholder", "thumb", "spinner", "loading", "prime", "video.jpg", "judgeme.imgix.net", "visa", "mastercard", "pay", "amex", "discover", "klarna", "jcb", "maestro", "diners", "credit", "checkout", "billing", "shipping", "warranty", "trial", "interest", "premium", "hypoallergenic"),
    **dict(zip((p for p, _ in JUNK_REASONS), (("_web.png",), ("_modal_",), ("yotpo.com",), (".png",), ("boucle", "basketweave", "velvet"), ("cushion-image",), ("cld.accentuate.io",), ("nav", "memorial", "collection", "kova", "cust_")))),
    **{g: (re.sub(r"\\(.)", r"\1", g),) for g in [*[g for g, _ in _GROUPS], _SQUARE]}, r"s7d2\.scene7\.com.*aeo": ("s7d2.scene7.com",), r"/cdn/shop/|cdn\.shopify\.com": ("/cdn/shop/", "cdn.shopify.com"), r"ikea\.com/.*/images/": ("ikea.com/",), r"prodimg/\d+/": ("prodimg/",),
    **dict(zip((p for _, p in URL_POINTS), (
        (".webp", ".avif"), ("=webp", "=avif"), ("f_auto",), ("asset.", "assets.", "static.", "cdn.", "media.", "img."), ("mozu.com", "cloudinary.com", "imgix.net", "shopify.com", "fastly.com"),
        (), ("product",), ("/product", "/main", "/hero", "/detail", "/primary"), ("/thumb", "/small", "/mini", "/icon"), ("pdp_", "product-detail"), ("plp_", "product-list"),
        ("-clothing", "best-seller", "new-arrival", "accessories", "shop-by", "featured-edit", "wellness", "searchburger"), ("nav", "_desk", "journal_"),
        ("flyout", "banner", "advertisement", "campaign", "marketing", "bullet-point", "feedback"), ("ad", "logo", "bg", "background", "footer", "nav", "menu", "sidebar"), ("sprite", "icon", "badge", "placeholder", "loading", "spinner", "pixel"),
        ("logo",), ("warranty", "insurance", "coverage", "support", "claim"), ("aicid=community",), ("community-reviews",),
    ))),
    **dict(zip(SIZES, (("max=", "w=", "width="), ("x",), ("x",), (), ("$n_",), ()))),
    r"_(?:AC_)?(?:US|SS|SY|SR|UL)(\d+)(?:_|\.)": ("_us", "_ss", "_sy", "_sr", "_ul"), "quality=([0-9]+)": ("quality=",), "q_([0-9]+)": ("q_",), "q([0-9]+)": ("q",), NOT_SHOWN: ("truck", "delivery", "hanger"),
}
#: Where no literal tells, a plainer pattern that every find holds (on the URL in lower case).
PLAINER = {URL_POINTS[5][1]: "[0-9]{4}", SIZES[3]: "[0-9][whp]", SIZES[5]: "[wh][0-9]"}


def image_score(u: Column, pos: Column, from_srcset: Column, selector: Column | None = None, class_id: Column | None = None, width: Column | None = None, height: Column | None = None, from_zoom: Column | None = None, from_large: Column | None = None) -> Column:
    """Additive integer score of an image, at least 0; null URL: null. Its some eighty patterns would make one method too large to
    be compiled, so it is evaluated as the function of an array's one element, which Spark keeps out of generated code."""
    known = {"u": u, "low": F.lower(u), "pos": pos, **_given(from_srcset, selector, class_id, width, height, from_zoom, from_large)}
    return F.when(u.isNotNull(), _bound(lambda x: _scored({k: x[k] for k in known}), **known))


def judged(u: Column, pos: Column, from_srcset: Column, from_zoom: Column | None = None, from_large: Column | None = None) -> Column:
    """A struct of ``why`` a URL is no candidate (empty, invalid, junk; else null) and the ``score`` of a candidate (else null)."""
    given = {"u": u, "low": F.lower(u), "pos": pos, **_given(from_srcset, None, None, None, None, from_zoom, from_large)}
    refused = lambda why: F.struct(F.lit(why).alias("why"), F.lit(None).cast("int").alias("score"))

    def verdict(x: Column) -> Column:
        known = {k: x[k] for k in given}
        u, low = known["u"], known["low"]
        junk = is_junk(u, low) | junk_reason(u, low).isNotNull()
        fine = F.struct(F.lit(None).cast("string").alias("why"), _scored(known).alias("score"))
        return F.when(F.coalesce(u, F.lit("")) == "", refused("empty")).when(~is_real_url(u), refused("invalid")).when(junk, refused("junk")).otherwise(fine)

    return _bound(verdict, **given)


def _given(from_srcset: Column, selector: Column | None, class_id: Column | None, width: Column | None, height: Column | None, from_zoom: Column | None, from_large: Column | None) -> dict[str, Column]:
    ratio = None if width is None or height is None else F.coalesce(width, F.lit(0)) / F.nullif(F.coalesce(height, F.lit(0)), F.lit(0))
    given = {"srcset": from_srcset, "selector": selector, "class_id": class_id, "ratio": ratio, "zoom": from_zoom, "large": from_large}
    return {k: c for k, c in given.items() if c is not None}


def _scored(known: dict[str, Column]) -> Column:
    u, low = known["u"], known["low"]

    def number(p: str) -> Column:
        seen = low.rlike(PLAINER[p]) if p in PLAINER else _holds(low, *NEEDLES[p])
        return F.when(seen, _number(u, f"(?i){p}"))

    found = {"thumb": number(r"_(?:AC_)?(?:US|SS|SY|SR|UL)(\d+)(?:_|\.)"), "px": F.greatest(*[number(p) for p in SIZES]), "quality": F.coalesce(*[number(p) for p in (r"quality=([0-9]+)", r"q_([0-9]+)", r"q([0-9]+)")])}
    return _bound(lambda y: _score(**{k: y[k] for k in [*known, *found]}), **known, **found)


def _score(u: Column, low: Column, pos: Column, thumb: Column, px: Column, quality: Column, srcset: Column | None = None, selector: Column | None = None, class_id: Column | None = None, ratio: Column | None = None, zoom: Column | None = None, large: Column | None = None) -> Column:
    add = lambda cond, n: F.when(cond, n).otherwise(0)
    hit = lambda p: low.rlike(PLAINER[p]) & u.rlike(f"(?i){p}") if p in PLAINER else _hit(u, low, p)
    parts = [
        F.when(thumb <= 40, -60).when(thumb <= 64, -50).when(thumb <= 100, -40).when(thumb <= 200, -20).when(thumb >= 800, 25).when(thumb >= 400, 15).otherwise(0),
        F.when(px >= 1200, 100).when(px >= 800, 80).when(px >= 600, 60).when(px >= 400, 30).when((px > 0) & (px < 200), 10).otherwise(0),
        F.when(quality >= 90, 20).when(quality >= 80, 15).when(quality >= 70, 10).when(quality < 50, -15).otherwise(0),
        *[add(hit(p), n) for n, p in URL_POINTS], add(low.contains(".png") & _hit(u, low, NOT_SHOWN), -20),
        add(pos < 10, 30), add(pos < 5, 10), add(pos < 3, 10), add(pos < 1, 10), *[add(c, n) for c, n in ((srcset, 15), (zoom, 25), (large, 20)) if c is not None],
    ]
    if selector is not None:
        parts += [F.when(selector.rlike(f"(?i){GOOD_SELECTOR}"), 25).when(selector.rlike(f"(?i){FAIR_SELECTOR}"), 20).otherwise(0), add(selector.rlike(f"(?i){BAD_SELECTOR}"), -40)]
    if class_id is not None:
        parts += [add(class_id.rlike(f"(?i){p}"), n) for n, p in CLASS_POINTS]
    if ratio is not None:
        parts += [F.when((ratio > 3) | ((ratio < 0.3) & (ratio > 0)), -40).otherwise(0), add(ratio.between(0.8, 1.5), 15)]
    return F.coalesce(fixed_score(u, low), F.greatest(F.lit(0), sum(parts, F.lit(50))))


def estimated_bytes(u: Column) -> Column:
    px = _number(F.lower(u), r"(\d{3,4})x")
    return F.when(px >= 1000, 100000).when(px >= 600, 60000).when(px >= 300, 25000).when(px < 300, 8000).otherwise(30000)


def fixed_score(u: Column, low: Column) -> Column:
    """The score of images of two hosts, which have rules of their own; null for all others."""
    px = _number(u, "(?i)[?&](?:wid|hei|w|h)=([0-9]+)")
    urbn = F.when(u.rlike(r"(?i)_swatch/|swatch\?|\$a15-category\$") | (px <= 800), 0).when(u.rlike(r"(?i)\$redesign-zoom-5x\$"), 95).otherwise(55)
    resized = r"(?i)\?i10c=img\.resize\(width:([0-9]+),height:([0-9]+)\)"
    w, h = (_number(u, resized, i) for i in (1, 2))
    shocho = F.when(~u.rlike("(?i)/sc-image/") | (w <= 800) | (h <= 800), 0).when(~u.rlike(r"(?i)\?i10c=img\.resize"), 90).when((w > 800) | (h > 800), 75)
    return F.when(_hit(u, low, r"images\.urbndata\.com/is/image"), urbn).when(_hit(u, low, r"cdn\.shocho\.co"), shocho)


def large_enough(u: Column, score: Column) -> Column:
    """Whether an image is kept for its size, as far as its URL tells it."""
    size = estimated_bytes(u)
    by_cdn = (score >= 50) & u.rlike(r"(?i)[?&](f_auto|q_auto|w[_=]\d+|h[_=]\d+)")
    return u.rlike(f"(?i){TRUSTED}") | (score >= 65) & (size >= 15000) | by_cdn | (size >= 50000) | (size >= 20000) & (score >= 40)
