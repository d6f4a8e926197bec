"""Place and station names as column expressions.

Every function takes and returns ``Column``; word lists are arguments with the
fixed lists below as defaults.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say what kind of place it is, dropped from core names.
NOISE = (
    "оп", "ав", "ас", "дкп", "кдп", "кп", "пов", "остановочный", "пункт", "кассовый", "автостанция", "автовокзал", "автобусная", "станция",
    "вокзал", "жд", "аэропорт", "аэродром", "остановка", "автопавильон", "диспетчерско", "диспетчерский", "г", "город", "пос", "посёлок", "поселок",
    "пгт", "п", "село", "с", "ст", "д", "деревня", "край", "область", "республика", "округ", "ао", "россия",
)
# Words before a settlement's name.
SETTLEMENT_PREFIX = ("г", "город", "пгт", "пос", "посёлок", "поселок", "п", "село", "с", "ст", "д", "деревня")
# Words at which a settlement's name ends.
FACILITY = ("аэропорт", "аэродром", "вокзал", "автостанция", "остановка", "остановочный", "пункт", "кассовый", "диспетчерско-кассовый", "завод", "цементный", "школа", "центральный", "международный")
# Endings of adjectives made from city names.
ADJECTIVE = ("ский", "цкий", "ая", "ое", "ый")
# Abbreviations of facilities.
ABBREVIATION = {
    "оп": "остановочный пункт", "ав": "автовокзал", "ас": "автостанция", "дкп": "диспетчерско-кассовый пункт", "кдп": "кассово-диспетчерский пункт",
    "кп": "кассовый пункт", "дп": "диспетчерский пункт", "ждв": "железнодорожный вокзал", "жд": "железнодорожный",
}
# Administrative terms.
ADMIN_TERM = {
    "область": "Oblast", "край": "Krai", "республика": "Republic", "район": "District", "городской округ": "Urban Okrug", "муниципальный округ": "Municipal Okrug",
    "федеральный округ": "Federal District", "автономный округ": "Autonomous Okrug", "автономная область": "Autonomous Oblast",
}
# Lower-case letters under GOST 7.79; capitals take a capital first letter.
GOST = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "j", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "cz", "ч": "ch", "ш": "sh", "щ": "shh", "ъ": "``", "ы": "y`", "ь": "`", "э": "e`", "ю": "yu", "я": "ya",
}
# Letters of slugs, where they differ from the above.
SLUG = {**GOST, "й": "y", "ц": "ts", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e"}
# Words that tell namesakes of one city apart.
CONTRAST = ("летний", "ж/д", "железнодорожн", "аэропорт", "тц ", 'тц"', "тц«", "юго-западн", "речной", "восточн", "западн", "северн", "привокзальн")


def _in(x: Column, words) -> Column:
    return F.array_contains(F.array(*[F.lit(w) for w in words]), x)


def _tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def normalize_name(c: Column) -> Column:
    """Lower case, ё as е, letters and digits; space - . , part words, other signs vanish."""
    low = F.translate(F.lower(F.trim(c)), "ё", "е")
    kept = F.regexp_replace(low, r"[^\p{L}\p{Nd} .,\-]", "")
    return F.trim(F.regexp_replace(kept, r"[ .,\-]+", " "))


def core_name(c: Column, noise=NOISE) -> Column:
    """The normalised name without words for kinds of places."""
    return F.array_join(F.filter(_tokens(normalize_name(c)), lambda x: ~_in(x, noise)), " ")


def extract_settlement(c: Column) -> Column:
    """Settlement named in a station name, '' if none."""
    tokens = _tokens(normalize_name(c))
    places = F.filter(F.transform(tokens, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda x: _in(x["w"], SETTLEMENT_PREFIX))

    def following(x):
        rest = F.slice(tokens, x["i"] + 2, 3)
        stop = F.aggregate(rest, F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("out")), lambda acc, w: F.struct((acc["on"] & ~_in(w, FACILITY)).alias("on"), F.when(acc["on"] & ~_in(w, FACILITY), F.concat(acc["out"], F.array(w))).otherwise(acc["out"]).alias("out")))
        return F.array_join(stop["out"], " ")

    named = F.try_element_at(F.filter(F.transform(places, following), lambda x: x != ""), F.lit(1))
    first = F.try_element_at(tokens, F.lit(1))
    ends = F.exists(F.array(*[F.lit(s) for s in ADJECTIVE]), lambda s: first.endswith(s))
    adjective = (F.size(tokens) > 1) & (F.length(first) >= 6) & ends & ~_in(first, FACILITY)
    return F.coalesce(named, F.when(adjective, first), F.lit(""))


def _stem_fits(adj: Column, city: Column) -> Column:
    tests = []
    for ending in ADJECTIVE:
        stem = adj.substr(F.lit(1), F.length(adj) - len(ending))
        size = F.length(adj) - len(ending)
        tests.append(adj.endswith(ending) & (size >= 4) & (size <= F.length(city)) & city.startswith(stem) & (F.length(city) - size <= 2))
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def same_settlement(a: Column, b: Column) -> Column:
    """Equal cores, or one the adjective of the other."""
    return same_core(core_name(a), core_name(b))


def same_core(x: Column, y: Column) -> Column:
    """H04 for core names made beforehand."""
    return F.coalesce((x != "") & (y != "") & ((x == y) | _stem_fits(x, y) | _stem_fits(y, x)), F.lit(False))


def core_stem(core: Column) -> Column:
    """What is left of an adjective without its ending; NULL if the core is none. A core has one of the endings at most."""
    return F.coalesce(*[F.when(core.endswith(e) & (F.length(core) - len(e) >= 4), core.substr(F.lit(1), F.length(core) - len(e))) for e in ADJECTIVE])


def same_core_by_stem(x: Column, x_stem: Column, y: Column, y_stem: Column) -> Column:
    """H04 for core names and stems made beforehand."""
    fits = lambda stem, city: F.coalesce(city.startswith(stem) & (F.length(city) - F.length(stem) <= 2), F.lit(False))
    return F.coalesce((x != "") & (y != "") & ((x == y) | fits(x_stem, y) | fits(y_stem, x)), F.lit(False))


def settlement_keys(c: Column) -> Column:
    """Keys of which two names share one whenever H04 holds; a re-check follows the join."""
    return core_keys(core_name(c))


def core_keys(core: Column) -> Column:
    """H05 for a core name made beforehand."""
    stems = [F.when(core.endswith(e) & (F.length(core) - len(e) >= 4), core.substr(F.lit(1), F.length(core) - len(e))) for e in ADJECTIVE]
    heads = [F.when(F.length(core) - k >= 4, core.substr(F.lit(1), F.length(core) - k)) for k in (1, 2)]
    return F.array_distinct(F.filter(F.array(F.when(core != "", core), *stems, *heads), lambda x: x.isNotNull()))


def lev_ratio(a: Column, b: Column) -> Column:
    """Edit distance of the normalised names over the longer length."""
    return _ratio(normalize_name(a), normalize_name(b))


def _ratio(x: Column, y: Column) -> Column:
    most = F.greatest(F.length(x), F.length(y))
    return F.when(x == y, 0.0).when((F.length(x) == 0) | (F.length(y) == 0), 1.0).otherwise(F.levenshtein(x, y) / most)


def plain_similarity(x: Column, y: Column) -> Column:
    inside = (F.length(x) >= 3) & (F.length(y) >= 3) & (F.contains(x, y) | F.contains(y, x))
    return F.when(x == y, 1.0).when(inside, 0.9).otherwise(F.greatest(F.lit(0.0), 1.0 - _ratio(x, y)))


def normalized_similarity(a: Column, b: Column) -> Column:
    """Similarity of normalised names, without the subset step."""
    return plain_similarity(normalize_name(a), normalize_name(b))


def name_similarity(a: Column, b: Column) -> Column:
    """Similarity of core names; of normalised names where a core is empty."""
    return core_similarity(core_name(a), core_name(b), normalize_name(a), normalize_name(b))


def core_similarity(x: Column, y: Column, a: Column, b: Column) -> Column:
    """H06 for core names x, y and normalised names a, b made beforehand."""
    p, q = F.split(x, " "), F.split(y, " ")
    # Single words are equal or no subset, which spares most pairs their word lists.
    subset = (F.contains(x, F.lit(" ")) | F.contains(y, F.lit(" "))) & ((F.size(F.array_except(p, q)) == 0) | (F.size(F.array_except(q, p)) == 0))
    return F.when((x == "") | (y == ""), plain_similarity(a, b)).when(x == y, 1.0).when(subset, 0.95).otherwise(plain_similarity(x, y))


def name_match(a: Column, b: Column, threshold: float) -> Column:
    return name_similarity(a, b) >= threshold


def expand_abbreviations(c: Column) -> Column:
    """Whole-word abbreviations spelt out; dots, quotes and brackets around a word are ignored."""
    book = F.create_map(*[F.lit(x) for kv in ABBREVIATION.items() for x in kv])
    return F.array_join(F.transform(_tokens(c), lambda t: F.coalesce(F.try_element_at(book, F.lower(F.btrim(t, F.lit('."«»()')))), t)), " ")


def _spell(c: Column, letters: dict[str, str]) -> Column:
    pairs = {**letters, **{k.upper(): v[:1].upper() + v[1:] for k, v in letters.items()}}
    one = {k: v for k, v in pairs.items() if len(v) == 1}
    out = F.translate(c, "".join(one), "".join(one.values()))
    for k, v in pairs.items():
        if len(v) != 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def transliterate(c: Column) -> Column:
    """Latin letters for Cyrillic ones."""
    return _spell(c, GOST)


def translate_admin(c: Column) -> Column:
    """An administrative name with its term in English, the longest term that occurs."""
    low = F.lower(F.trim(c))
    out = None
    for term in sorted(ADMIN_TERM, key=len, reverse=True):
        at = F.instr(low, term)
        before = F.trim(c.substr(F.lit(1), at - 1))
        after = F.trim(c.substr(at + len(term), F.length(c)))
        text = F.when(before != "", F.concat(transliterate(F.btrim(before, F.lit(" -"))), F.lit(" " + ADMIN_TERM[term]))).when(after != "", F.concat(transliterate(after), F.lit(" " + ADMIN_TERM[term]))).otherwise(F.lit(ADMIN_TERM[term]))
        out = F.when(at > 0, text) if out is None else out.when(at > 0, text)
    return out.otherwise(transliterate(c))


def slug(c: Column) -> Column:
    """Latin words joined by -, 40 characters at most, 'stop' if nothing is left."""
    text = F.btrim(F.regexp_replace(_spell(c, SLUG), "[^A-Za-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.substring(F.lower(text), 1, 40), F.lit("")), F.lit("stop"))


def name_hash(name: Column, region: Column) -> Column:
    """Eight hex digits of a name and its region."""
    return F.substring(F.sha2(F.concat(name, F.lit("|"), region), 256), 1, 8)


# Words, inner texts and beginnings that mark rural halts and turn-offs.
HALT_WORDS, HALT_HEADS = ("оп", "о.п"), ("оп«", 'оп"')
HALT_TEXTS = ("ост. пункт", "остановочный", "поворот", "пов.", " оп ", " оп«", "оп «", " пов ")
HALT_STARTS = ("оп ", "пов ")
# Words and texts of hubs, and the text of airports.
HUB_WORDS, HUB_TEXTS, AIRPORT = ("ав", "авт", "а/в"), ("автовокзал", "автостанция"), "аэропорт"


def _holds(c: Column, texts) -> Column:
    return F.exists(F.array(*[F.lit(t) for t in texts]), lambda t: F.contains(c, t))


def is_village_name(c: Column) -> Column:
    """Names of rural halts and turn-offs."""
    low = F.lower(c)
    words = F.transform(_tokens(low), lambda t: F.btrim(t, F.lit(" \t\"'«».,;:!*")))
    starts = lambda x, heads: F.exists(F.array(*[F.lit(h) for h in heads]), lambda h: F.startswith(x, h))
    halt = F.exists(words, lambda w: _in(w, HALT_WORDS) | (F.length(w).between(3, 5) & starts(w, HALT_HEADS)))
    return halt | _holds(low, HALT_TEXTS) | starts(low, HALT_STARTS)


def village_penalty(c: Column) -> Column:
    return F.when(is_village_name(c), 15).otherwise(0)


def is_plausible_settlement(c: Column) -> Column:
    """4 to 60 characters that begin with a capital."""
    return F.length(F.trim(c)).between(4, 60) & F.trim(c).rlike(r"^\p{Lu}")


def infer_stop_type(c: Column) -> Column:
    """Airport, hub, platform or station from the name."""
    low = F.lower(c)
    hub = F.exists(_tokens(low), lambda t: _in(t, HUB_WORDS)) | _holds(low, HUB_TEXTS)
    return F.when(F.contains(low, F.lit(AIRPORT)), "airport").when(hub, "hub").when(is_village_name(c), "platform").otherwise("station")


def classify_stop(name: Column, tags: Column) -> Column:
    """The name decides unless it says station; then tags do."""
    named = infer_stop_type(name)
    tag = lambda k: F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit(""))
    return F.when(named != "station", named).when(F.contains(tag("aeroway"), F.lit("aerodrome")), "airport").when(tag("amenity") == "bus_station", "hub").otherwise("station")


def stop_type_signal(stop_type: Column, terminal_name: Column) -> Column:
    """The terminal's name has the word for the stop's type."""
    low = F.lower(terminal_name)
    return F.when(stop_type == "hub", _holds(low, HUB_TEXTS)).when(stop_type == "airport", F.contains(low, F.lit(AIRPORT))).otherwise(False)


def has_contrast_word(stop_name: Column, terminal_name: Column) -> Column:
    """The terminal has a telling word that the stop lacks."""
    s, t = F.lower(stop_name), F.lower(terminal_name)
    return F.exists(F.array(*[F.lit(w) for w in CONTRAST]), lambda w: F.contains(t, w) & ~F.contains(s, w))


def modes(c: Column) -> Column:
    return F.filter(F.split(c, r"\+"), lambda x: x != "")


def normalize_transport(c: Column) -> Column:
    """Distinct modes in order, joined by +."""
    return F.array_join(F.array_sort(F.array_distinct(modes(c))), "+")


def transport_overlap(a: Column, b: Column) -> Column:
    return F.arrays_overlap(modes(a), modes(b))


def name_adds_context(long: Column, short: Column) -> Column:
    """``short`` ends ``long`` and something stands before it."""
    y, o = F.lower(F.trim(long)), F.lower(F.trim(short))
    head = F.regexp_replace(F.trim(y.substr(F.lit(1), F.length(y) - F.length(o))), r",? ?$", "")
    return F.coalesce((y != "") & (o != "") & (y != o) & y.endswith(o) & (head != ""), F.lit(False))


def normalize_query(c: Column) -> Column:
    """Lower case, single spaces."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def word_bound_contains(text: Column, part: Column) -> Column:
    """``part`` occurs in ``text`` with no letter or digit beside it."""
    quoted = F.regexp_replace(part, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return (part != "") & F.regexp_like(text, F.concat(F.lit(r"(?<![\p{L}\p{Nd}])"), quoted, F.lit(r"(?![\p{L}\p{Nd}])")))


def token_name_match(a: Column, b: Column) -> Column:
    """Every word of the shorter name is a word of the other."""
    p, q = F.split(normalize_name(a), " "), F.split(normalize_name(b), " ")
    return (F.size(F.array_except(p, q)) == 0) | (F.size(F.array_except(q, p)) == 0)
