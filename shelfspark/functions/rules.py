"""Fixed values of the tagger: synonyms, overrides, weights and keyword lists, stated as text."""

#: Fixed values.
TAG_CANONICALS = {"stripe": "striped", "stripes": "striped", "plaid": "plaid", "plaids": "plaid", "floral": "floral", "florals": "floral", "checkers": "checkered", "checked": "checkered"}
#: Phrase, words that exclude it, category path; the first that applies wins.
PHRASE_OVERRIDES = [
    ("pool float", (), "Home & Garden > Garden & Outdoor > Pool & Spa > Pool Float"),
    ("tanning bed", ("pool", "float", "inflatable", "lounger"), "Beauty & Personal Care > Tanning > Tanning Beds"),
    ("dog bed", (), "Pet Supplies > Dog > Beds & Furniture"),
    ("cat bed", (), "Pet Supplies > Cat > Beds & Furniture"),
    ("pet bed", (), "Pet Supplies > Beds & Furniture"),
    ("truck bed", (), "Automotive > Truck Accessories > Bed Accessories"),
    ("flower bed", (), "Home & Garden > Garden & Outdoor > Landscaping"),
    ("watch band", (), "Jewelry & Watches > Watch Accessories > Bands"),
    ("phone case", (), "Electronics > Mobile Accessories > Cases"),
    ("guitar case", (), "Musical Instruments > Instrument Accessories > Cases"),
    ("sofa cover", (), "Home & Garden > Furniture > Living Room > Slipcovers"),
    ("book cover", (), "Books & Media > Book Accessories > Book Covers"),
]
#: Fixed values, in hundredths.
CONFIDENCE = {"colors": 10, "patterns": 10, "finishes": 10, "materials": 15, "activities": 10, "styles": 15, "features": 15, "fit": 10, "occasions": 10, "categories": 15}
#: Hits in title, URL, breadcrumbs, specs and description.
SOURCE_WEIGHTS = {"title": 1000, "url": 500, "crumbs": 300, "specs": 100, "description": 50}
#: Words of each gender.
GENDER = {
    "unisex": "unisex|gender-neutral|everyone|all-gender|non-binary",
    "women": r"woman|women|womens|lady|ladies|female|girl|girls|mom|mother|mommy|mum|mama|daughter|sister|aunt|aunty|auntie|niece|grandmother|grandma|granny|nana|miss|mrs|ms|ma'am|madam|madame|queen|empress|princess|duchess|goddess|wife|girlfriend|bride|bridesmaid|fiancée|maternity|nursing|bridal|bra|lingerie|dress|skirt|blouse|heels|purse|handbag|hand[\s-]?bag|shoulder[\s-]?bag|tote[\s-]?bag|clutch|señora|señorita|femme|feminine|her|hers|she",
    "men": r"man|men|mens|gentleman|gentlemen|male|boy|boys|guy|guys|dad|father|daddy|papa|son|brother|uncle|nephew|grandfather|grandpa|gramps|pop|mr|sir|mister|señor|king|emperor|prince|duke|lord|husband|boyfriend|groom|groomsman|beard|shave|razor|necktie|tuxedo|suit|cologne|masculine|homme|his|him|he",
    "kids": "baby|infant|toddler|child|children|kids|youth|junior|teen|teenager|adolescent",
}
#: Fixed value: a word of men's that counts only where a letter follows.
MEN_BEFORE_LETTER = "fiancé"
#: Materials of several words, the material they must not be taken for, and their tag.
COMPOUND_MATERIALS = [
    ("faux leather", "leather", "faux-leather"), ("vegan leather", "leather", "vegan-leather"), ("synthetic leather", "leather", "synthetic-leather"), ("genuine leather", "leather", "genuine-leather"),
    ("faux suede", "suede", "faux-suede"), ("faux fur", "fur", "faux-fur"), ("organic cotton", "cotton", "organic-cotton"), ("merino wool", "wool", "merino-wool"),
]
#: Other words for a category.
CATEGORY_SYNONYMS = {
    "trousers": "Pants", "slacks": "Pants", "chinos": "Pants", "top": "Shirts", "tops": "Shirts", "jumper": "Sweater", "pullover": "Sweater", "tee": "T-Shirt", "tee-shirt": "T-Shirt",
    "trainers": "Sneakers", "kicks": "Sneakers", "tennis-shoes": "Sneakers", "running-shoes": "Sneakers", "sneaker": "Sneakers", "parka": "Coat", "windbreaker": "Jacket", "blazer": "Jacket",
    "purse": "Handbags", "tote": "Bags", "backpack": "Bags", "rucksack": "Bags", "bralette": "Bra", "sports-bra": "Bra", "push-up-bra": "Bra", "panty": "Underwear", "panties": "Underwear", "briefs": "Underwear",
    "boxers": "Underwear", "boxer-briefs": "Underwear", "thong": "Underwear", "boyshorts": "Underwear", "pajamas": "Sleepwear", "pyjamas": "Sleepwear", "nightgown": "Sleepwear", "robe": "Sleepwear",
}
#: Phrases whose words may stand apart, and their category.
MULTI_WORD_SYNONYMS = [
    ("slouchy bag", "Handbag"), ("crossbody bag", "Crossbody Bag"), ("shoulder bag", "Shoulder Bag"), ("tote bag", "Tote Bag"), ("clutch bag", "Clutch"), ("hobo bag", "Handbag"), ("satchel bag", "Handbag"), ("bucket bag", "Handbag"),
    ("messenger bag", "Bags"), ("duffle bag", "Bags"), ("weekender bag", "Bags"), ("cargo pants", "Pants"), ("jogger pants", "Pants"), ("track pants", "Pants"), ("dress pants", "Pants"), ("denim jacket", "Jacket"), ("bomber jacket", "Jacket"),
    ("leather jacket", "Jacket"), ("puffer jacket", "Jacket"), ("running shoes", "Sneakers"), ("tennis shoes", "Sneakers"), ("ankle boots", "Boots"), ("knee boots", "Boots"), ("chelsea boots", "Boots"), ("combat boots", "Boots"),
]
#: Contexts in which a category's name only describes.
CATEGORY_BLACKLIST = {
    "shorts": r"\bshort[-\s](sleeve|puffed|length|hem|cut)", "pants": r"\b(pantry|pendant)", "filter": r"\b(color|light|camera|photo|lens|water)[-\s]filter",
    "belt": r"\b(belted[-\s]|belt[-\s](loop|detail)|(serpentine|timing|drive|fan)[-\s]belt|v-belt)", "battery": r"\bbattery[-\s](powered|operated|life|backup)",
}
#: Necklines and sleeves.
NECK_OR_SLEEVE = "v-neck|crew-neck|turtle-neck|scoop-neck|cowl-neck|halter-neck|mock-neck|boat-neck|square-neck|high-neck|round-neck|short-sleeve|long-sleeve|sleeveless|cap-sleeve|bell-sleeve|puffed-sleeve|3/4-sleeve"
#: The gender of a department whose product names none.
DEPARTMENT_GENDER = {"Tools & Hardware": "men", "Automotive": "men", "Beauty & Personal Care": "women"}
#: The fixture taxonomy: id, name, parent, level, found by a model. 10 is a twin of 1, 9 hangs in the air.
CATEGORIES = [
    (1, "Fashion", None, 0, 0), (2, "Accessories", 1, 1, 0), (3, "Bags", 2, 2, 0), (4, "Handbag", 3, 3, 0), (5, "Clothing", 1, 1, 0), (6, "Shorts", 5, 2, 0), (7, "Hardware", None, 0, 0),
    (8, "Widgets", 7, 1, 0), (9, "Orphan", 999, 2, 0), (10, "Fashion", None, 0, 1), (11, "Gears", 7, 1, 0), (12, "Bolts", 7, 1, 0), (13, "Plates", 7, 1, 1), (14, "Accessories", 1, 1, 1),
]
TAGS = [("red", "colors"), ("blue", "colors"), ("green", "colors"), ("yellow", "colors"), ("black", "colors"), ("small", "fit"), ("large", "fit"), ("steel", "materials"), ("brass", "materials"), ("copper", "materials"), ("tin", "materials"), ("faux leather", "materials"), ("widget", "features"), ("gear", "features"), ("bolt", "features"), ("plate", "features"), ("ring", "styles"), ("striped", "patterns")]
