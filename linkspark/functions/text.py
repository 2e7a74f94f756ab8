"""Normalisers as native column expressions.

A normaliser is a list of steps; the same list also renders as SQL for engines of the RE2 family, which is how the
results are checked. Patterns stay within the subset that Java's and RE2's dialects share.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: word lists and tables that results depend on ----
LEGAL = (
    "pvt private ltd limited llc inc incorporated corp corporation co company llp plc lp pc pllc the and of pvtltd opc pte gmbh ltda sarl sas sasu eurl sa sci snc "
    "selarl scop mr mrs ms shri sri smt des de du la le les et"
).split()
NAME_STOP = (
    "pvt private ltd limited llc inc incorporated corp corporation co company cos llp lp plc pllc pc sa sas sasu sarl eurl sci snc scs sca scp scop selarl gmbh ag bv "
    "nv cie pte pty ltda opc the of and et an mr mrs ms miss dr www com http https net org formerly dba aka de du des la le les"
).split()
ADDR_STOP = (
    "no po box unit door null na nan none apt apartment appt appartement ste suite pmb hno flat plot shop near nr opp opposite behind floor fl flr the of and de du des "
    "la le les et au aux en sur chez mme india usa us france cdp dist district tq tal taluka ps rm room num number"
).split()
ADDR_NOISE = "no po box door hno h pmb number".split()
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de", "district of columbia": "dc",
    "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la",
    "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne",
    "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok",
    "oregon": "or", "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt",
    "virginia": "va", "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy", "puerto rico": "pr",
}
INDIA_STATES = {
    "maharashtra": "mh", "delhi": "dl", "new delhi": "dl", "uttar pradesh": "up", "karnataka": "ka", "tamil nadu": "tn", "tamilnadu": "tn", "west bengal": "wb", "westbengal": "wb",
    "gujarat": "gj", "telangana": "tg", "haryana": "hr", "kerala": "kl", "keralam": "kl", "rajasthan": "rj", "bihar": "br", "madhya pradesh": "mp", "andhra pradesh": "ap",
    "orissa": "od", "odisha": "od", "punjab": "pb", "goa": "ga", "assam": "as", "jharkhand": "jh", "chhattisgarh": "cg", "uttarakhand": "uk", "himachal pradesh": "hp",
    "jammu and kashmir": "jk", "chandigarh": "ch", "puducherry": "py", "pondicherry": "py",
}
#: Names of one word are mapped word by word, longer ones as phrases before that.
STATES = {k: v for k, v in (US_STATES | INDIA_STATES).items() if " " not in k}
STATES_OF_WORDS = {k: v for k, v in (US_STATES | INDIA_STATES).items() if " " in k}
BLOCK_STATES_OF_WORDS = {k: v for k, v in STATES_OF_WORDS.items() if k not in ("new delhi", "puerto rico")} | {"arunachal pradesh": "arp", "jammu kashmir": "jk"}
ADDR_ABBR = {
    "st": "street", "str": "street", "rd": "road", "dr": "drive", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "bd": "boulevard", "bvd": "boulevard",
    "ln": "lane", "ct": "court", "hwy": "highway", "pl": "place", "pkwy": "parkway", "cir": "circle", "trl": "trail", "ter": "terrace", "sq": "square",
    "apt": "apartment", "ste": "suite", "fl": "floor", "flr": "floor", "bldg": "building", "nr": "near", "opp": "opposite", "mt": "mount", "ft": "fort",
    "sec": "sector", "n": "north", "s": "south", "e": "east", "w": "west", "r": "rue", "all": "allee", "imp": "impasse", "chem": "chemin", "rte": "route",
    "fbg": "faubourg", "bld": "boulevard",
}
BLOCK_ABBR = {
    "street": "st", "str": "st", "saint": "st", "road": "rd", "drive": "dr", "drv": "dr", "avenue": "av", "ave": "av", "avn": "av", "avenu": "av", "boulevard": "bd",
    "blvd": "bd", "boul": "bd", "bld": "bd", "bvd": "bd", "lane": "ln", "court": "ct", "place": "pl", "highway": "hwy", "parkway": "pkwy", "pky": "pkwy",
    "circle": "cir", "terrace": "ter", "terr": "ter", "square": "sq", "trail": "trl", "plaza": "plz", "point": "pt", "mount": "mt", "fort": "ft", "north": "n",
    "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw", "r": "rue", "chemin": "ch", "chem": "ch",
    "impasse": "imp", "allee": "all", "route": "rte", "faubourg": "fbg", "fg": "fbg", "cours": "crs", "residence": "res", "resid": "res", "batiment": "bat",
    "bt": "bat", "general": "gen", "gal": "gen", "marechal": "mal", "ngr": "nagar", "col": "colony", "clny": "colony", "sec": "sector", "bengaluru": "bangalore",
    "calcutta": "kolkata", "bombay": "mumbai", "gurugram": "gurgaon", "madras": "chennai",
}
INDIA_CODES = {"ts": "tg", "or": "od", "ct": "cg", "ut": "uk"}
HOMOGLYPHS = ("01i5348", "ollseab")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
URL_TAIL = r"\s*\|\s*(https?://)?(www\.)?[a-z0-9\-]+(\.[a-z]{2,4})+/?\s*$"
URL_FULL = r"^(https?://)?(www\.)?[a-z0-9\-]+(\.[a-z]{2,4})+/?$"
PO_BOX = r"\b(p\s*\.?\s*o\s*\.?\s*box|pmb|box)\s*#?\s*\d+"
HOUSE_TOKEN = r"((?:[a-z]{1,3}\s*[-/]\s*)?\d+[a-z]?(?:\s*[-/]\s*[a-z]{0,3}\d*[a-z]{0,3})*)"
LATIN = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")
# ---- End of fixed values ----


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@dataclass(frozen=True)
class Steps:
    """A chain of rewrites: ("lower",), ("trim",), ("re", pattern, replacement), ("lit", old, new), ("pad",)."""

    steps: tuple[tuple, ...]

    def __add__(self, other: Steps) -> Steps:
        return Steps(self.steps + other.steps)

    def __call__(self, c: Column) -> Column:
        def one(x: Column, s: tuple) -> Column:
            if s[0] == "lower":
                return F.lower(x)
            if s[0] == "trim":
                return F.trim(x)
            if s[0] == "pad":
                return F.concat(F.lit(" "), x, F.lit(" "))
            if s[0] == "lit":
                return F.replace(x, F.lit(s[1]), F.lit(s[2]))
            return F.regexp_replace(x, s[1], s[2])

        return reduce(one, self.steps, c)

    def sql(self, expr: str) -> str:
        for s in self.steps:
            if s[0] in ("lower", "trim"):
                expr = f"{s[0]}({expr})"
            elif s[0] == "pad":
                expr = f"(' ' || {expr} || ' ')"
            elif s[0] == "lit":
                expr = f"replace({expr}, {sql_text(s[1])}, {sql_text(s[2])})"
            else:
                expr = f"regexp_replace({expr}, {sql_text(s[1])}, {sql_text(s[2].replace('$', chr(92)))}, 'g')"
        return expr


def rewritten(chain: Steps, s: str) -> str:
    """The chain applied to a plain string."""
    for kind, *args in chain.steps:
        if kind == "lit":
            s = s.replace(*args)
        elif kind == "re":
            s = re.sub(args[0], re.sub(r"\$(\d)", r"\\\1", args[1]), s)
        else:
            s = {"lower": s.lower(), "trim": s.strip(), "pad": f" {s.replace(' ', '  ')} "}[kind]
    return s


def steps(*s: tuple) -> Steps:
    return Steps(tuple(s))


def _first(pattern: str, new: str) -> tuple:
    return ("re", pattern, new)


def _words(table: dict[str, str]) -> tuple[tuple, ...]:
    """Whole-word replacement of phrases in padded text."""
    return tuple(("lit", f" {k} ", f" {v} ") for k, v in table.items())


# ---- Fixed values: rewrite chains; results depend on every step and on their order ----
#: Name view for blocking keys.
BLOCK_NAME = steps(
    ("lower",), ("re", r"https?://|www\.", " "), ("re", r"\.(com|net|org|co\.in|in|co|biz|info|us|io|fr)\b", " "), ("lit", "&", " and "), ("re", "[^a-z0-9]+", " "), ("trim",),
)
#: Address view for blocking keys.
BLOCK_ADDR = steps(
    ("lower",), ("re", r"\bnull\b|\bn/a\b|\bnone\b|\bnan\b", " "), ("re", r"\b(p\s*\.?\s*o\s*\.?\s*box|post\s*box|pmb|box)\s*[#:.\-]*\s*\d+", " "),
    ("re", r"(\d+)\s*(st|nd|rd|th)\b", "$1"), ("lit", "&", " and "), ("re", "[^a-z0-9]+", " "), ("pad",), *_words(BLOCK_STATES_OF_WORDS), ("trim",),
)
#: Nothing but a placeholder is left of the address.
ADDR_PLACEHOLDER = steps(("re", r"\b(null|na|n|a)\b", ""), ("trim",))

#: Matcher's name: tail address of a web site and "formerly" prefixes are dropped before this.
NAME = steps(("re", r"\bm/s\b", " "), ("lit", "&", " and "), ("lit", ".", ""), ("re", "[^a-z0-9]+", " "), ("trim",))
NAME_HEAD = steps(("lower",), ("trim",), _first(URL_TAIL, ""), _first(r"^.*\bformerly\b\s*(known\s+as)?\s*:?", ""), ("trim",))
WEB_STEM = steps(_first("^@", ""), _first(r"^(https?://)?(www\.)?", ""), _first(r"(\.[a-z]{2,4})+/?$", ""), ("re", "[^a-z0-9]", ""))

ADDR = steps(
    ("lower",), ("re", r"\b(null|none|n/a)\b", " "), ("lit", "&", " and "), ("re", "[^a-z0-9]+", " "), ("re", r"\b0+(\d)", "$1"), ("trim",),
)

#: Phonetic consonant skeleton of whole names: vowels, h and y go unless they begin a word. Doubles are collapsed after it.
SKELETON = steps(
    ("lit", "ph", "f"), ("lit", "sh", "s"), ("lit", "th", "t"), ("re", "[cq]", "k"), ("lit", "w", "v"), ("lit", "z", "j"), ("lit", "x", "ks"), ("re", r"\B[aeiouhy]", ""),
)
#: Of single words, for blocking.
WORD_SKELETON = steps(
    ("lit", "ph", "f"), ("lit", "sh", "s"), ("lit", "th", "t"), ("lit", "ck", "k"), ("re", "[cq]", "k"), ("lit", "w", "v"), ("lit", "z", "j"), ("lit", "x", "ks"),
    ("re", r"\B[aeiouyh]", ""),
)
#: Of transliterated words: neither ck nor x is special.
TRANSLIT_SKELETON = steps(
    ("lit", "ph", "f"), ("lit", "sh", "s"), ("lit", "th", "t"), ("re", "[cq]", "k"), ("lit", "w", "v"), ("lit", "z", "j"), ("re", r"\B[aeiouyh]", ""),
)
#: Spelling of transliterated words.
TRANSLIT_SPELLING = steps(
    ("lit", "ksh", "x"), ("lit", "ks", "x"), ("lit", "sh", "s"), ("lit", "ee", "i"), ("lit", "aa", "a"), ("lit", "oo", "u"), ("lit", "y", "i"), ("lit", "w", "v"),
    ("lit", "ph", "f"), ("lit", "th", "t"), ("lit", "dh", "d"), ("lit", "bh", "b"),
)


# ---- End of fixed values ----


def skeleton(name: Column) -> Column:
    once = F.regexp_replace(SKELETON(name), r"([a-z])\1", "$1")
    return F.regexp_replace(once, r"([a-z])\1", "$1")


def skeleton_sql(expr: str) -> str:
    out = SKELETON.sql(expr)
    for c in LETTERS * 2:
        out = f"replace({out}, '{c}{c}', '{c}')"
    return out


def word_skeleton(word: Column) -> Column:
    return F.regexp_replace(WORD_SKELETON(word), r"(.)\1+", "$1")


def translit_skeleton(word: Column) -> Column:
    return F.regexp_replace(TRANSLIT_SKELETON(word), r"(.)\1+", "$1")


def collapse_sql(expr: str) -> str:
    for c in LETTERS + "0123456789":
        expr = f"regexp_replace({expr}, '{c}{c}+', '{c}', 'g')"
    return expr


def latin_fold(s: Column) -> Column:
    """Accents of Latin letters dropped; degree and number signs become blanks."""
    s = F.regexp_replace(F.coalesce(s, F.lit("")), "(?i)\\bn\\s*[°º]", " ")
    return F.translate(F.regexp_replace(s, "[°º№]", " "), *LATIN)


def latin_fold_sql(expr: str) -> str:
    return f"translate(regexp_replace(regexp_replace(coalesce({expr}, ''), '(?i)\\bn\\s*[°º]', ' ', 'g'), '[°º№]', ' ', 'g'), '{LATIN[0]}', '{LATIN[1]}')"


def compatible(s: Column) -> Column:
    """Unicode compatibility form (NFKC), where the text is not ASCII anyway."""
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return run(s)


def raw_view(s: Column) -> Column:
    """Letters, marks and digits of all scripts, lower-cased in compatibility form, other runs as one blank."""
    return F.trim(F.regexp_replace(F.lower(compatible(F.coalesce(s, F.lit("")))), r"[^\p{L}\p{M}\p{N}]+", " "))


def fold_scripts(s: Column) -> Column:
    """Every script in ASCII, lower case: letters without accents, or by their sound (see explain.romanised)."""
    from .explain import fold

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(fold)

    return run(s)


def homoglyphs(word: Column) -> Column:
    """0 as o, 1 and i as l, and so on; words of digits only stay."""
    return F.when(word.rlike("^[0-9]+$"), word).otherwise(F.translate(word, *HOMOGLYPHS))


def tokens(s: Column) -> Column:
    return F.filter(F.split(s, " "), lambda t: t != "")


def without(words: Column, stop: list[str]) -> Column:
    return F.filter(words, lambda t: ~t.isin(stop))


def mapped(words: Column, table: dict[str, str]) -> Column:
    """Words found in the table are replaced."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.transform(words, lambda t: F.coalesce(F.element_at(m, t), t))


def name_views(name: Column) -> dict[str, Column]:
    """name_n (clean), name_core (without legal forms; name_n if nothing is left), name_ns (core without blanks), name_skel and four flags."""
    low = F.trim(F.lower(latin_fold(name)))
    head = NAME_HEAD(latin_fold(name))
    is_url = head.rlike(URL_FULL) & ~head.contains(" ")
    handle = head.rlike(r"^@\S+$")
    clean = NAME(F.when(is_url | handle, WEB_STEM(head)).otherwise(head))
    core = F.array_join(without(tokens(clean), LEGAL), " ")
    core = F.when(core == "", clean).otherwise(core)
    return {
        "name_n": clean, "name_core": core, "name_ns": F.replace(core, F.lit(" "), F.lit("")), "name_skel": skeleton(core),
        "f_url": is_url, "f_urltail": low.rlike(URL_TAIL), "f_formerly": low.rlike(r"\bformerly\b"), "f_handle": handle,
    }


def addr_views(addr: Column, country: Column) -> dict[str, Column]:
    """addr_n (expanded, without noise), nums (the numbers, last nine digits each) and the flags addr_null and has_unit."""
    low = F.lower(latin_fold(addr))
    clean = ADDR(latin_fold(addr))
    phrases = Steps((("pad",), *_words(STATES_OF_WORDS), ("trim",)))(clean)
    words = mapped(tokens(phrases), ADDR_ABBR | STATES)
    words = F.when(country == "India", mapped(words, INDIA_CODES)).otherwise(words)
    return {
        "addr_n": F.array_join(without(words, ADDR_NOISE), " "),
        "nums": F.transform(F.regexp_extract_all(clean, F.lit(r"(\d+)"), F.lit(1)), lambda x: F.right(x, F.lit(9)).cast("long")),
        "addr_null": low.rlike(r"\b(null|none|n/a)\b"), "has_unit": low.rlike(r"(\b(apt|apartment|suite|ste|unit|flat|floor|fl|flr|room|bldg|building)\b|#)"),
    }


def house_parts(addr: Column, most: int = 8) -> Column:
    """The parts of the first compound house number ("E-16-28": e, 16, 28), zeros stripped."""
    token = F.regexp_extract(F.regexp_replace(F.lower(F.coalesce(addr, F.lit(""))), PO_BOX, " "), HOUSE_TOKEN, 1)
    parts = F.regexp_extract_all(token, F.lit(r"([a-z]*\d+[a-z]*|[a-z]+)"), F.lit(1))
    return F.slice(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.regexp_replace(p, r"^0+(\d)", "$1")).otherwise(p)), 1, most)


def number_parts(addr: Column, most: int = 6) -> Column:
    """The numbers in the first compound house number, last nine digits each."""
    token = F.regexp_extract(F.regexp_replace(F.lower(F.coalesce(addr, F.lit(""))), PO_BOX, " "), HOUSE_TOKEN, 1)
    return F.slice(F.transform(F.regexp_extract_all(token, F.lit(r"(\d+)"), F.lit(1)), lambda x: F.right(x, F.lit(9)).cast("long")), 1, most)


def street_key(number: Column, words: Column, most: int = 4) -> Column:
    """House number and sorted words of the street."""
    return F.concat_ws("|", number.cast("string"), F.array_join(F.array_sort(F.slice(words, 1, most)), " "))


def agree(a: Column, b: Column) -> Column:
    """-1 where a side is missing, else whether they are equal."""
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), -1).when(a == b, 1).otherwise(0)


def script(s: Column) -> Column:
    """0 ASCII, 1 extended Latin, 2 Devanagari, 3 another Indic script, 4 any other."""
    return (
        F.when(~s.rlike("[^\\x00-\\x7F]"), 0).when(s.rlike("[\\x{0900}-\\x{097F}]"), 2).when(s.rlike("[\\x{0980}-\\x{0DFF}]"), 3)
        .when(s.rlike("[\\x{00C0}-\\x{024F}]"), 1).otherwise(4)
    )


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def expit(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def pair_text(name: Column, addr: Column) -> Column:
    """What an encoder reads of a record."""
    return F.concat(F.lit("query: "), F.coalesce(name, F.lit("")), F.lit(" | "), F.coalesce(addr, F.lit("")))


#: A run of Indic letters, joiners inside words included.
INDIC = "[\\x{0900}-\\x{0D7F}\\x{200C}\\x{200D}]+"


def transliterate(s: Column, words: dict[str, str]) -> Column:
    """Each run of Indic letters replaced by its dictionary word (looked up as it stands, then without joiners); unknown runs stay."""
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv]) if words else F.create_map().cast("map<string,string>")

    def look_up(run: Column) -> Column:
        bare = F.regexp_replace(run, "[\\x{200C}\\x{200D}]", "")
        return F.coalesce(F.element_at(table, run), F.element_at(table, bare), run)

    runs = F.regexp_extract_all(s, F.lit(f"({INDIC}|[^\\x{{0900}}-\\x{{0D7F}}\\x{{200C}}\\x{{200D}}]+)"), F.lit(1))
    return F.when(s.rlike("[\\x{0900}-\\x{0D7F}]"), F.array_join(F.transform(runs, look_up), "")).otherwise(F.coalesce(s, F.lit("")))


def admin_components(addr: Column, table: dict[str, str]) -> Column:
    """Comma-separated components that name a region or one of its departments, replaced by the region's code between blanks."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    key = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "[-'.]", " "), " +", " "))
    return F.array_join(F.transform(F.split(addr, ","), lambda c: F.coalesce(F.concat(F.lit(" "), F.element_at(m, key(c)), F.lit(" ")), c)), ",")


#: "st. martin" is a saint, "st" before a word of PLACE_WORDS a street.
PLACE_WORDS = "north|south|east|west|apt|suite|floor|unit"
SAINTS = steps(("re", rf"\bst\.?(\s+)({PLACE_WORDS})\b", "street$1$2"), ("re", r"\bst\.?[\s-]+([a-z]{3,})", "saint $1"), ("re", r"\bste\.?[\s-]+([a-z]{3,})", "sainte $1"))

#: House-number suffixes: pattern and letter, in order; a letter after the number stands for itself.
SUFFIXES = ((r"\b\d+\s*bis\b", "b"), (r"\b\d+\s*ter\b", "t"), (r"\b\d+\s*quater\b", "q"))


def house_suffix(addr: Column) -> Column:
    out = None
    for pattern, letter in SUFFIXES:
        out = F.when(addr.rlike(pattern), letter) if out is None else out.when(addr.rlike(pattern), letter)
    return out.otherwise(F.regexp_extract(addr, r"\b\d+([a-d])\b", 1))


def without_suffix(addr: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(addr, r"\b(\d+)\s*(bis|ter|quater)\b", "$1"), r"\b(\d+)[a-d]\b", "$1")
