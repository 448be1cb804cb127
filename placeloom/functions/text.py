"""Column functions on text. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def falsy_to_null(c: ColumnOrName, kind: str = "string") -> Column:
    """Null for what counts as false: null, '', 0, NaN and false."""
    c = _col(c)
    if kind == "string":
        return F.when(c != "", c)
    if kind == "boolean":
        return F.when(c, c)
    return F.when((c != 0) & ~F.isnan(c.cast("double")), c)


def either(*cs: ColumnOrName) -> Column:
    """The first string that is neither null nor empty."""
    return F.coalesce(*[falsy_to_null(c) for c in cs])


#: White space of all kinds, as scripts on the web trim it.
WHITE_SPACE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim_space(c: ColumnOrName) -> Column:
    """Without white space of any kind at both ends; ``trim`` alone takes blanks only."""
    return F.btrim(_col(c), F.lit(WHITE_SPACE))


def text_key(c: ColumnOrName) -> Column:
    """Lower case, trimmed, white space collapsed: texts are the same if their keys are."""
    return F.regexp_replace(trim_space(F.lower(_col(c))), r"\s+", " ")


def is_blank(c: ColumnOrName) -> Column:
    return F.coalesce(F.length(trim_space(c)) == 0, F.lit(True))


def contains_text(c: ColumnOrName, needle: str) -> Column:
    """Whether the text holds ``needle`` as it is, in any case; no wildcards."""
    return F.contains(F.lower(_col(c)), F.lit(needle.lower()))


def like_any_case(c: ColumnOrName, pattern: str, whole: bool = False) -> Column:
    """ILIKE with ``%`` and ``_`` as wildcards, anywhere in the text or on the whole of it."""
    return _col(c).ilike(pattern if whole else f"%{pattern}%")


#: What an OCR token must not hold, and lone roman numerals.
NOISE_SYMBOLS = r"[§\\{}*|<>~`^]"
LONE_NUMERAL = r"^[IVXivx]{1,4}$"
LEAST_TOKEN = 2
#: What a token that isn't noise matches, in one pass.
_GOOD = rf"^(?!{LONE_NUMERAL[1:]})(?=[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}])[^{NOISE_SYMBOLS[1:-1]}]{{{LEAST_TOKEN},}}+\z"
LEAST_LINE = 4
LEAST_CONFIDENCE = 60


def is_noise(c: ColumnOrName) -> Column:
    """Whether an OCR token is noise: too short, without letter or number, with a noise symbol, or a lone roman numeral."""
    return ~trim_space(c).rlike(_GOOD)


def fix_price(c: ColumnOrName) -> Column:
    """In a token with a rupee sign the letter O is a zero."""
    c = _col(c)
    return F.when(F.contains(c, F.lit("₹")), F.translate(c, "Oo", "00")).otherwise(c)


def slugify(c: ColumnOrName, key: ColumnOrName, suffix: int = 4) -> Column:
    """Lower-case words joined by '-', and a suffix from the key's MD5, so that equal titles differ and reruns agree."""
    base = F.regexp_replace(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(base, F.lit("-"), F.substring(F.md5(_col(key).cast("string")), 1, suffix))


def file_extension(c: ColumnOrName) -> Column:
    """What follows the last dot (the whole name if it has none)."""
    return F.substring_index(_col(c), ".", -1)


def transcript(original: ColumnOrName, english: ColumnOrName) -> Column:
    """Both transcripts in two headed sections."""
    return F.format_string("Original Transcript:\n%s\n\nEnglish Translation:\n%s", F.coalesce(_col(original), F.lit("")), F.coalesce(_col(english), F.lit("")))


#: A short English stop list, for token search without a stemmer.
STOP_WORDS = "a an and are as at be by for from has he in is it its of on or that the this to was were will with".split()


def search_tokens(c: ColumnOrName) -> Column:
    """Distinct lower-case tokens without stop words; no stemming."""
    tokens = F.split(F.lower(F.coalesce(_col(c), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(tokens, lambda t: (t != "") & ~t.isin(STOP_WORDS)))


def handle(c: ColumnOrName) -> Column:
    """A user name with its '@'."""
    return F.concat(F.lit("@"), F.regexp_replace(trim_space(c), "^@+", ""))


#: Suffixes of venue handles and their cities.
HANDLE_CITIES = {
    "nyc": "New York",
    "la": "Los Angeles",
    "miami": "Miami",
    "chi": "Chicago",
    "sf": "San Francisco",
    "dc": "Washington DC",
    "nola": "New Orleans",
    "atx": "Austin",
    "london": "London",
    "uk": "London",
    "delhi": "Delhi",
    "bom": "Mumbai",
    "mumbai": "Mumbai",
    "blr": "Bengaluru",
}


def handle_suffix(c: ColumnOrName) -> Column:
    """What follows the last '.' or '_' of a handle, in lower case."""
    return F.lower(F.regexp_extract(_col(c), r"[._]([A-Za-z]+)$", 1))


def handle_city(c: ColumnOrName) -> Column:
    """The city that a venue handle names, or null."""
    cities = F.create_map(*[F.lit(x) for pair in HANDLE_CITIES.items() for x in pair])
    return F.try_element_at(cities, handle_suffix(c))


def handle_name(c: ColumnOrName) -> Column:
    """The venue's name in a handle: without '@' and city suffix, capitalised."""
    bare = F.regexp_replace(trim_space(c), "^@+", "")
    cut = F.when(handle_city(c).isNotNull(), F.regexp_replace(bare, r"[._][A-Za-z]+$", "")).otherwise(bare)
    return F.initcap(F.regexp_replace(cut, r"[._]+", " "))


#: Keywords of a place's category, the first rule that matches counts.
CATEGORY_RULES = [
    ("Specialty Coffee Roastery & Cafe", ["espresso", "latte", "pour over", "roaster"]),
    ("Artisanal Bakery & Cafe", ["croissant", "pastry", "sourdough", "baguette", "bakery"]),
    ("Natural Wine Bar", ["natural wine", "orange wine", "biodynamic"]),
    ("Speakeasy Cocktail Lounge", ["speakeasy", "hidden entrance", "secret door"]),
    ("Omakase Sushi Bar", ["omakase", "nigiri", "sushi chef"]),
    ("Neapolitan Pizzeria", ["neapolitan", "woodfired", "pizza", "pizzeria"]),
    ("Artisanal Matcha Bar", ["matcha", "whisk", "ceremonial"]),
]
DEFAULT_CATEGORY = "Restaurant"


def keyword_category(c: ColumnOrName, rules: list[tuple[str, list[str]]] | None = None, default: str = DEFAULT_CATEGORY) -> Column:
    """The category whose keywords a text holds."""
    out, text = None, F.lower(_col(c))
    for name, words in rules or CATEGORY_RULES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)
