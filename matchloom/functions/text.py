"""Normalised views of names and addresses.

Unicode folding and transliteration are one vectorised UDF per record; every later step is a column expression over
token arrays.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# They must equal those of the pipeline whose results are matched.
NAME_ALIASES = {"pvt": "private", "ltd": "limited", "incorporated": "inc", "corporation": "corp"}
ADDRESS_ALIASES_2 = {
    "road": "rd", "street": "st", "avenue": "ave", "boulevard": "blvd", "drive": "dr", "lane": "ln",
    "highway": "hwy", "apartment": "apt", "apartments": "apt", "suite": "ste", "building": "bldg",
}
ADDRESS_ALIASES_3 = ADDRESS_ALIASES_2 | {
    "av": "ave", "bd": "blvd", "bld": "blvd", "place": "pl", "allee": "all", "chemin": "ch", "impasse": "imp", "r": "rue",
}
LEGAL_2 = "private limited llp llc inc corp company co opc".split()
LEGAL_3 = "private public limited llp llc inc corp company co opc sarl sas sasu eurl sa sci snc cie ets etablissements".split()
HONORIFIC = "dr shri sri smt mr mrs messrs".split()
COUNTRIES = {"us": "US", "usa": "US", "u s": "US", "u s a": "US", "united states": "US", "united states of america": "US"}
DIGRAPHS = [("ph", "f"), ("kh", "k"), ("sh", "s"), ("ch", "c"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("gh", "g"), ("w", "v"), ("q", "k")]


def fold_unicode(value: str | None) -> str:
    """Compatibility-composed, case-folded; format characters and white space become single spaces."""
    text = unicodedata.normalize("NFKC", value or "").casefold()
    return " ".join("".join(" " if unicodedata.category(c) == "Cf" else c for c in text).split())


@lru_cache(maxsize=65536)
def _latin(c: str) -> str:
    """ASCII spelling of one character: base letters without marks, digits by value, letters of other scripts by name."""
    if c < "\x80":
        return c
    special = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "þ": "th", "ð": "d", "’": "'", "‘": "'"}
    if c in special:
        return special[c]
    flat = "".join(x for x in unicodedata.normalize("NFKD", c) if x < "\x80")
    if flat:
        return flat
    kind = unicodedata.category(c)
    if kind == "Nd":
        return str(unicodedata.digit(c))
    if kind in ("Lo", "Ll", "Lm") or kind.startswith("M"):
        if m := re.search(r"(?:LETTER|VOWEL SIGN)(?: [A-Z]+)*? ([A-Z]+)$", unicodedata.name(c, "")):
            return m[1].lower()
        return "" if kind.startswith("M") else "x"
    return " "


def to_ascii(text: str) -> str:
    return "".join(map(_latin, text)).lower()


@F.pandas_udf(StructType([StructField("unicode", StringType()), StructField("ascii", StringType())]))
def _folded(values: pd.Series) -> pd.DataFrame:
    views = values.map(fold_unicode)
    return pd.DataFrame({"unicode": views, "ascii": views.map(to_ascii)})


def folded(x: Column) -> Column:
    return _folded(F.coalesce(x, F.lit("")))


def tokens(ascii_view: Column) -> Column:
    return F.regexp_extract_all(F.replace(ascii_view, F.lit("&"), F.lit(" and ")), F.lit("[a-z0-9]+"), 0)


def _aliased(words: Column, aliases: dict[str, str]) -> Column:
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))


def _member(x: Column, words: list[str]) -> Column:
    return x.isin(*words)


def phonetic_word(word: Column) -> Column:
    out = F.regexp_replace(word, "([a-z])\\1+", "$1")
    for a, b in DIGRAPHS:
        out = F.replace(out, F.lit(a), F.lit(b))
    bare = F.regexp_replace(out, "[aeiou]", "")
    return F.when(bare == "", out).otherwise(bare)


def phonetic(words: Column) -> Column:
    return F.array_join(F.transform(words, phonetic_word), " ")


def _grown(acc: Column) -> Column:
    """Letters gathered so far: joined into one token if several."""
    return F.when(F.size(acc["run"]) > 0, F.array_append(acc["out"], F.array_join(acc["run"], ""))).otherwise(acc["out"])


def join_initials(words: Column) -> Column:
    """Runs of single letters become one token."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, w: Column) -> Column:
        letter = w.rlike("^[a-z]$")
        go_on = F.struct(acc["out"].alias("out"), F.array_append(acc["run"], w).alias("run"))
        stop = F.struct(F.array_append(_grown(acc), w).alias("out"), empty.alias("run"))
        return F.when(letter, go_on).otherwise(stop)

    return F.aggregate(words, F.struct(empty.alias("out"), empty.alias("run")), step, _grown)


def drop_repeats(words: Column) -> Column:
    return F.transform(F.filter(F.arrays_zip(words.alias("w"), F.concat(F.array(F.lit(None).cast("string")), words).alias("p")), lambda x: x["w"].isNotNull() & ~x["w"].eqNullSafe(x["p"])), lambda x: x["w"])


def _longest_prefix(words: Column, test) -> Column:
    """Number of leading tokens (with their successors) that pass a test of (token, next token)."""
    zipped = F.arrays_zip(words.alias("w"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("n"))
    start = F.struct(F.lit(0).alias("k"), F.lit(True).alias("go"))
    return F.aggregate(zipped, start, lambda a, x: F.struct((a["k"] + (a["go"] & test(x["w"], x["n"])).cast("int")).alias("k"), (a["go"] & test(x["w"], x["n"])).alias("go")), lambda a: a["k"])


def canonical_legal(words: Column) -> Column:
    """Spells phonetically close legal forms at the end of a name, from right to left, until a token is no legal form."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(True).alias("go"))

    def step(acc: Column, w: Column) -> Column:
        key, after = phonetic_word(w), F.try_element_at(acc["out"], F.lit(-1))
        spelled = F.when(key == "lmtd", "limited").when((key == "prvt") & after.eqNullSafe(F.lit("limited")), "private")
        go = acc["go"] & (spelled.isNotNull() | _member(w, LEGAL_3))
        return F.struct(F.array_append(acc["out"], F.when(acc["go"], F.coalesce(spelled, w)).otherwise(w)).alias("out"), go.alias("go"))

    return F.reverse(F.aggregate(F.reverse(words), start, step, lambda a: a["out"]))


def _legal_3(word: Column, following: Column) -> Column:
    return F.when(word == "public", F.coalesce(following.isin("limited", "company"), F.lit(False))).otherwise(_member(word, LEGAL_3))


def _country(ascii_view: Column) -> Column:
    key = F.array_join(tokens(ascii_view), " ")
    table = F.create_map(*(F.lit(x) for kv in COUNTRIES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, key), key)


def check_learned(maps: dict | None) -> None:
    """Learned alias maps are not applied; a map with content is an error."""
    if maps and any(maps.values()):
        raise ValueError("learned aliases are quarantined; only empty maps are accepted")


def views(df: DataFrame, version: int = 3, maps: dict | None = None) -> DataFrame:
    """df(business_name, business_address, country, ...) with comparison views appended (versions 2 and 3)."""
    check_learned(maps)
    df = df.withColumns({"_n": folded(F.col("business_name")), "_a": folded(F.col("business_address")), "_c": folded(F.col("country"))})
    firm = F.regexp_replace(F.col("_n.ascii"), "(?<![a-z0-9])m\\s*/\\s*s(?![a-z0-9])", " messrs ") if version == 3 else F.col("_n.ascii")
    df = df.withColumn("_t", tokens(firm))
    if version == 3:
        df = df.withColumn("_t", join_initials(F.col("_t"))).withColumn("_t", drop_repeats(F.col("_t")))
    df = df.withColumn("_t", _aliased(F.col("_t"), NAME_ALIASES))
    if version == 3:
        df = df.withColumn("_t", canonical_legal(F.col("_t")))
        df = df.withColumn("_lo", _longest_prefix(F.col("_t"), lambda w, n: _member(w, HONORIFIC) | _legal_3(w, n)))
        rest = F.slice("_t", F.col("_lo") + 1, F.greatest(F.size("_t") - F.col("_lo"), F.lit(0)))
        # from the right: `public` counts only before limited/company, which then stands to its right
        back = F.aggregate(F.reverse(rest), F.struct(F.lit(0).alias("k"), F.lit(True).alias("go"), F.lit(None).cast("string").alias("n")), lambda a, w: F.struct((a["k"] + (a["go"] & _legal_3(w, a["n"])).cast("int")).alias("k"), (a["go"] & _legal_3(w, a["n"])).alias("go"), w.alias("n")), lambda a: a["k"])
        df = df.withColumn("_hi", F.size("_t") - back)
        ends = F.filter(F.transform(F.arrays_zip(F.col("_t").alias("w"), F.slice("_t", 2, F.greatest(F.size("_t"), F.lit(1))).alias("n")), lambda x, i: F.struct(x["w"].alias("w"), (_legal_3(x["w"], x["n"]) & ((i < F.col("_lo")) | (i >= F.col("_hi")))).alias("y"))), lambda x: x["y"] & x["w"].isNotNull())
        df = df.withColumn("_legal", F.array_join(F.transform(ends, lambda x: x["w"]), " "))
        core = F.slice("_t", F.col("_lo") + 1, F.greatest(F.col("_hi") - F.col("_lo"), F.lit(0)))
    else:
        back = _longest_prefix(F.reverse("_t"), lambda w, n: _member(w, LEGAL_2))
        df = df.withColumn("_hi", F.size("_t") - back)
        df = df.withColumn("_legal", F.when(F.col("_hi") > 0, F.array_join(F.slice("_t", F.col("_hi") + 1, F.greatest(F.size("_t"), F.lit(1))), " ")).otherwise(""))
        core = F.slice("_t", 1, F.col("_hi"))
    df = df.withColumn("_core", F.when(F.size(core) > 0, core).otherwise(F.col("_t")))
    numbers = F.regexp_extract_all(F.array_join(tokens(F.col("_a.ascii")), " "), F.lit("[0-9]+"), 0)
    out = {
        "name_unicode": F.col("_n.unicode"), "address_unicode": F.col("_a.unicode"), "country_key": _country(F.col("_c.ascii")),
        "name_norm": F.array_join("_t", " "), "name_core": F.array_join("_core", " "),
        "address_norm": F.array_join(_aliased(tokens(F.col("_a.ascii")), ADDRESS_ALIASES_3 if version == 3 else ADDRESS_ALIASES_2), " "),
        "phonetic": phonetic(F.col("_core")), "legal_form" if version == 3 else "legal_suffix": F.col("_legal"),
        "numbers": numbers, "numbers_unpadded": F.transform(numbers, lambda x: F.coalesce(F.nullif(F.regexp_replace(x, "^0+", ""), F.lit("")), F.lit("0"))),
        "non_ascii_name": F.coalesce("business_name", F.lit("")).rlike("[^\\x00-\\x7F]").cast("int"),
        "address_missing": (F.trim(F.coalesce("business_address", F.lit(""))) == "").cast("int"),
    }
    df = df.withColumns(out)
    return df.drop(*(c for c in df.columns if c in ("_n", "_a", "_c", "_t", "_lo", "_hi", "_legal", "_core")))


# Fixed values of the first normaliser (superseded, kept for results made with it).
FIRST_DROPPED = "private pvt limited ltd llp llc inc incorporated corporation corp company co proprietorship partnership opc ms mr mrs m s the and of for at by".split()
FIRST_NAME_ALIASES = {
    "pvt": "private", "ltd": "limited", "incorporated": "inc", "corporation": "corp", "corporate": "corp", "co": "company", "pr": "private",
    "limittedd": "limited", "limittd": "limited", "praaivett": "private",
}
FIRST_ADDRESS_ALIASES = {
    "road": "rd", "street": "st", "avenue": "ave", "boulevard": "blvd", "drive": "dr", "lane": "ln", "highway": "hwy", "apartment": "apt", "apartments": "apt",
    "floor": "fl", "suite": "ste", "building": "bldg", "number": "no", "opposite": "opp", "opposit": "opp", "nearby": "near",
    "maharashtra": "mh", "delhi": "dl", "dillii": "dl", "karnataka": "ka", "rajasthan": "rj", "gujarat": "gj", "bihar": "br", "telangana": "ts",
    "haryana": "hr", "punjab": "pb", "kerala": "kl", "tamilnadu": "tn", "uttarpradesh": "up", "westbengal": "wb",
    "california": "ca", "texas": "tx", "florida": "fl", "utah": "ut", "missouri": "mo", "wisconsin": "wi", "arizona": "az", "illinois": "il", "ohio": "oh",
    "oregon": "or", "georgia": "ga", "colorado": "co", "nevada": "nv", "virginia": "va", "pennsylvania": "pa", "michigan": "mi", "washington": "wa",
    "tennessee": "tn", "massachusetts": "ma", "alabama": "al", "alaska": "ak", "arkansas": "ar", "connecticut": "ct", "delaware": "de", "hawaii": "hi",
    "idaho": "id", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "minnesota": "mn",
    "mississippi": "ms", "montana": "mt", "nebraska": "ne", "oklahoma": "ok", "vermont": "vt", "wyoming": "wy",
    "chemin": "chem", "route": "rte", "saint": "st", "sainte": "ste",
    "first": "1st", "second": "2nd", "third": "3rd", "fourth": "4th", "fifth": "5th", "sixth": "6th", "seventh": "7th", "eighth": "8th", "ninth": "9th", "tenth": "10th",
}
FIRST_PHRASES = {
    "new york": "ny", "new jersey": "nj", "new mexico": "nm", "new hampshire": "nh", "north carolina": "nc", "south carolina": "sc", "north dakota": "nd",
    "south dakota": "sd", "rhode island": "ri", "west virginia": "wv", "uttar pradesh": "up", "madhya pradesh": "mp", "west bengal": "wb", "tamil nadu": "tn",
    "andhra pradesh": "ap", "himachal pradesh": "hp", "pvt ltd": "private limited",
}


@F.pandas_udf(StringType())
def _first_ascii(values: pd.Series) -> pd.Series:
    """Composed, spelled in ASCII, then case-folded: the first normaliser's order of steps."""
    return values.map(lambda v: to_ascii(unicodedata.normalize("NFKC", v or "")).casefold())


def first_basic(x: Column) -> Column:
    return tokens(_first_ascii(F.coalesce(x, F.lit(""))))


def first_views(df: DataFrame) -> DataFrame:
    """df(business_name, business_address, ...) with the views of the first normaliser; it knows no learned maps (see check_learned)."""
    name = F.coalesce("business_name", F.lit(""))
    df = df.withColumns({"_n": _aliased(first_basic(F.col("business_name")), FIRST_NAME_ALIASES), "_a": F.array_join(first_basic(F.col("business_address")), " ")})
    core = F.filter("_n", lambda w: ~w.isin(*FIRST_DROPPED))
    core = F.when(F.size(core) > 0, core).otherwise(F.col("_n"))
    domain = name.contains(".") & (F.array_contains("_n", "com") | F.array_contains("_n", "www"))
    brand = F.filter(core, lambda w: ~w.isin("www", "https", "http", "com", "org", "net", "in"))
    df = df.withColumn("_core", F.when(domain & (F.size(brand) > 0), brand).when(domain, F.col("_n")).otherwise(core))
    address = F.col("_a")
    for phrase, short in FIRST_PHRASES.items():
        address = F.regexp_replace(address, f"\\b{phrase}\\b", short)
    out = {
        "name_norm": F.array_join("_n", " "), "name_core": F.array_join("_core", " "), "address_norm": F.array_join(_aliased(F.split(address, " "), FIRST_ADDRESS_ALIASES), " "),
        "phonetic": phonetic(F.col("_core")), "non_ascii_name": name.rlike("[^\\x00-\\x7F]").cast("int"), "address_missing": (F.trim(F.coalesce("business_address", F.lit(""))) == "").cast("int"),
    }
    return df.withColumns(out).drop("_n", "_a", "_core")
