"""Scalars that read quantities, units and names from drawing labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mensura.functions import dims

# The forms of an area label, prefixed or alone on its line, and of a length.
AREA = r"([0-9,]+(?:\.[0-9]+)?)\s*(sq\s*m|m²|m2|sq\s*ft|ft²|ft2)"
PREFIXED = rf"^\s*(?:A|Area)\s*=?\s*{AREA}\s*$"
BARE = rf"^\s*{AREA}\s*$"
LENGTH = r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*(km|mm|cm|m|ft|feet|in)\b"
SCALE = r"1\s*:\s*([0-9]{1,5})\b"


def area_m2(content: Column) -> Column:
    """Square metres of an area label; a prefixed line beats a bare one, and prose has none."""
    lines = F.split(content, r"[\r\n]+")
    pick = lambda form: F.get(F.filter(lines, lambda x: x.rlike("(?i)" + form)), F.lit(0))
    line = F.coalesce(pick(PREFIXED), pick(BARE))
    number = F.regexp_replace(F.regexp_extract(line, "(?i)" + AREA, 1), ",", "").try_cast("double")
    unit = F.regexp_replace(F.lower(F.regexp_extract(line, "(?i)" + AREA, 2)), " ", "")
    return F.when(unit.startswith("sqft") | unit.startswith("ft"), number * dims.SQUARE_FOOT_M2).otherwise(number)


def length_m(content: Column) -> Column:
    """Metres of the first number with a linear unit."""
    low = F.lower(content)
    number = F.regexp_replace(F.nullif(F.regexp_extract(low, LENGTH, 1), F.lit("")), ",", "").try_cast("double")
    return number * dims.lookup(dims.LENGTH_UNITS, F.regexp_extract(low, LENGTH, 2))


def subject_key(subject: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(subject), r"\s+", " "))


# The form of a unit's number in a subject, and the words of floors and decks that are scopes of their own.
UNIT_TOKEN = r"\bunits?\s*[-:#]?\s*([0-9]+[a-z]?)\b"
UPPER_FLOORS, PLANT_DECK, POD = ((("first", "upper"), ("floor",)),), ((("plant",), ("deck",)),), ((("pod",),),)


def unit_label(subject: Column) -> Column:
    """"Unit 4A" of a subject such as "units - 4a upper floor"."""
    found = F.regexp_extract(subject_key(subject), UNIT_TOKEN, 1)
    return F.when(found != "", F.concat(F.lit("Unit "), F.upper(found)))


def upper_scope(subject: Column) -> Column:
    """The upper-floor scope that a subject states: plant deck, pod or a unit's main floor."""
    s = subject_key(subject)
    floor = dims.says(s, UPPER_FLOORS)
    return F.when(dims.says(s, PLANT_DECK), "plant_deck").when(dims.says(s, POD) & floor, "pod_first_floor").when(unit_label(subject).isNotNull() & floor, "main_upper_floor")


def measurement_kind(area: Column, length: Column, perimeter: Column) -> Column:
    return F.when(area.isNotNull(), "area").when(length.isNotNull(), "length").when(perimeter.isNotNull(), "perimeter").otherwise("unparsed")


def title_scales(text: Column) -> Column:
    """Denominators 1:N of a text, those of 20 to 5000, in order of place."""
    found = F.transform(F.regexp_extract_all(text, F.lit(SCALE), 1), lambda x: x.try_cast("int"))
    return F.filter(found, lambda n: n.between(20, 5000))


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"[-+]?[0-9]*\.?[0-9]+"), 0), lambda x: x.try_cast("double"))


def first_text(*values: Column) -> Column:
    """The first value that isn't null or blank."""
    return F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in values))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def drawing_key(path: Column) -> Column:
    """A drawing's name without path, extension, marking words and punctuation, for matching marked and raw copies."""
    stem = F.lower(F.regexp_replace(file_name(path), r"\.[A-Za-z0-9]+$", ""))
    words = F.filter(F.split(stem, r"[^a-z0-9]+"), lambda w: (w != "") & ~w.isin("markup", "marked", "copy", "raw", "stripped"))
    return F.array_join(words, "")


def safe_file_part(value: Column, fallback: str = "drawing", most: int = 120) -> Column:
    clean = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"[^A-Za-z0-9._-]+", "_")
    return F.substring(F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback)), 1, most)


def marked_file_name(ref: Column, drawing: Column, revision: Column) -> Column:
    return F.format_string("%s_%s_REV_%02d_MARKED.pdf", safe_file_part(ref, "PROJECT"), safe_file_part(drawing), F.coalesce(revision, F.lit(0)).cast("int"))


def sheet_text(value: Column) -> Column:
    """A spreadsheet cell that can't be taken for a formula."""
    return F.when(value.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def sheet_date(value: Column) -> Column:
    forms = ("yyyy-MM-dd", "d MMMM yyyy", "dd/MM/yyyy")
    return F.coalesce(*(F.try_to_timestamp(value, F.lit(f)).cast("date") for f in forms))


def quantity_text(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value.cast("double")), r"0+$", ""), r"\.$", "")


def slump_label(cls: Column) -> Column:
    # Slump ranges of the consistence classes.
    return dims.lookup({"S1": "10-40mm", "S2": "50-90mm", "S3": "100-150mm", "S4": "160-210mm", "S5": "220mm+"}, F.upper(F.trim(cls)))
