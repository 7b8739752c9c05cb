"""Names and search texts in one form, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tramline.functions.constants import RAIL

# Words that open a place's name and say what kind of place it is; words that name a road or an area.
PLACE_WORDS = "شارع|ش|ميدان|م|كوبري|كوبرى|محور|طريق|منطقة|حي|مساكن|مدينة|جراج"
STATION_WORDS = "محطة|شارع|ش|ميدان|م"
ROAD_WORDS = (
    "الاوتوستراد", "الأوتوستراد", "كورنيش", "الكورنيش", "الطريق الدائري", "الدائري", "المحور", "محور",
    "صلاح سالم", "طريق النصر", "الطريق", "كوبري اكتوبر", "كوبرى اكتوبر", "النفق", "نفق",
)
# What riders call each kind of vehicle.
SYNONYMS = {
    "bus": "bus اتوبيس أتوبيس باص cta هيئة النقل العام",
    "minibus": "minibus مينيباص ميني باص مينى باص مشروع",
    "microbus": "microbus ميكروباص ميكرو باص سيرفيس سرفيس مشروع",
    "metro": "metro مترو الأنفاق مترو",
    "monorail": "monorail مونوريل قطار مونوريل",
    "lrt": "lrt القطار الكهربائي الخفيف القطار الخفيف قطار",
    "tram": "tram ترام",
    "apm": "apm قطار المطار shuttle",
}
MARKS, ALEFS = "[\\u064b-\\u0652\\u0640]", "أإآٱ"


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "(?U)\\s+", " "))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no function for."""
    return s.str.normalize("NFKC")


def normalise(name: Column) -> Column:
    """A place name without marks, punctuation, leading kind words, article and spaces. Expects composed text (nfkc)."""
    t = F.translate(F.regexp_replace(F.coalesce(name, F.lit("")), MARKS, ""), ALEFS + "ىة", "اااايه")
    t = _squeezed(F.regexp_replace(t, "[()\\[\\]«».,،؛/\\\\]", " "))
    for _ in range(2):
        t = F.regexp_replace(t, f"^(?:ال)?({PLACE_WORDS})\\s+", "")
    return F.replace(F.regexp_replace(t, "^ال", ""), F.lit(" "), F.lit(""))


def normalise_station(name: Column) -> Column:
    t = F.translate(F.regexp_replace(F.coalesce(name, F.lit("")), MARKS, ""), ALEFS + "ىة", "اااايه")
    t = _squeezed(F.regexp_replace(t, "[()\\[\\]«».,،]", " "))
    for _ in range(2):
        t = F.regexp_replace(t, f"^({STATION_WORDS})\\s+", "")
    return F.replace(F.regexp_replace(t, "^ال", ""), F.lit(" "), F.lit(""))


def search_text(text: Column) -> Column:
    """Lower case, letters that are written in several ways as one, compounds joined, no punctuation."""
    t = F.translate(F.lower(F.coalesce(text, F.lit(""))), "إأآىة", "ااايه")
    t = F.regexp_replace(t, "[\\u064B-\\u065F\\u0670]", "")
    # Compounds and their joined forms.
    for apart, joined in (("mini bus", "minibus"), ("micro bus", "microbus"), ("ميني باص", "مينيباص"), ("ميكرو باص", "ميكروباص")):
        t = F.replace(t, F.lit(apart), F.lit(joined))
    return _squeezed(F.regexp_replace(t, "(?U)[^\\w\\s]", " "))


def variants(name: Column) -> Column:
    """A name, and the name without what it has in parentheses."""
    bare = F.trim(F.regexp_replace(name, "\\s*[(（][^)）]*[)）]\\s*", " "))
    return F.array_distinct(F.filter(F.array(name, bare), lambda x: x != ""))


def place_key(lat1, lon1, lat2, lon2) -> Column:
    """The key of a cached route between two places: five decimals, about a metre."""
    at = lambda x: F.round(x, 5).cast("string")
    return F.concat(at(lat1), F.lit(","), at(lon1), F.lit(";"), at(lat2), F.lit(","), at(lon2))


def wanted_modes(text) -> tuple[Column, Column]:
    """Known and unknown modes of a list with commas; null for an empty list, which stands for every mode."""
    modes = F.array_distinct(F.filter(F.transform(F.split(F.lower(text), ","), lambda m: F.trim(m)), lambda x: x != ""))
    known = F.array(*map(F.lit, RAIL))
    some = F.coalesce(text, F.lit("")) != ""
    return F.when(some, F.array_intersect(modes, known)), F.when(some, F.sort_array(F.array_except(modes, known)))


def in_parentheses(name: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit("[(（]([^)）]+)[)）]"), 1)


def is_road(normalised: Column) -> Column:
    words = F.transform(F.array(*map(F.lit, ROAD_WORDS)), normalise)
    return F.exists(words, lambda w: F.contains(normalised, w))


def route_number(short_name: Column) -> Column:
    """All digits of a route's short name together; null if it has none."""
    return F.nullif(F.regexp_replace(F.coalesce(short_name, F.lit("")), "[^0-9]", ""), F.lit(""))


def corridor_stops(text: Column) -> Column:
    """Landmarks of a corridor that is written with dashes between them."""
    return F.filter(F.transform(F.split(text, "[–-]"), lambda x: F.trim(x)), lambda x: x != "")
