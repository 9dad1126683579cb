"""Brief slab specifications: types, values as supplied, signatures and what is shown of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mensura.functions import dims, rules

# Names of slab types, and words that tell one from a drawing's text.
ALIASES = {
    "external yard slabs": "external_yard", "external/service yard slabs": "external_yard", "external yard": "external_yard", "yard": "external_yard",
    "dock slabs": "dock", "dock": "dock", "ground floor slabs": "ground_floor", "ground floor slabs(core areas)": "ground_floor",
    "ground floor slabs (core areas)": "ground_floor", "ground floor slabs (ancillary areas)": "ground_floor", "ground floor": "ground_floor", "office": "ground_floor",
    "upper floor slabs": "upper_floor", "upper floors": "upper_floor", "upper floor": "upper_floor",
}
TELLING = {
    "dock": ("dock",), "upper_floor": ("upper floor", "first floor", "mezzanine", "level 1"), "ground_floor": ("ground floor", "office", "transport", "internal slab"),
}
WHOLE_NUMBERS = ("depth_mm", "layers")
NO_DETAILS = "No details provided"


def slab_type(value: Column, text: Column) -> Column:
    """A slab type by its own id or name, else by telling words, else a yard."""
    own = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    both = F.replace(F.lower(F.concat_ws(" ", value, text)), F.lit("_"), F.lit("-"))
    told = F.coalesce(*(F.when(rules.any_of(both, words), kind) for kind, words in TELLING.items()))
    return F.coalesce(F.when(own.isin(*dims.AREA_CATEGORIES), own), dims.lookup(ALIASES, own), told, F.lit("external_yard"))


def supplied(field: Column, value: Column) -> Column:
    """value as it is stored and whether it is allowed: numbers of layers and depths are whole and positive; blank is none."""
    text = F.nullif(F.trim(value), F.lit(""))
    number = text.try_cast("int")
    whole = field.isin(*WHOLE_NUMBERS)
    return F.struct(F.when(whole, number.cast("string")).otherwise(text).alias("value"), (~whole | text.isNull() | F.coalesce(number > 0, F.lit(False))).alias("allowed"))


def shown(field: Column, value: Column, provisional: Column, note: Column) -> Column:
    """A value as people read it; what is missing or assumed can't be overlooked."""
    text = F.when(field == "depth_mm", F.concat(value, F.lit(" mm"))).otherwise(value)
    assumed = F.when(F.coalesce(provisional, F.lit(True)), F.concat(text, F.lit(" — ASSUMED / provisional"))).otherwise(text)
    return F.coalesce(assumed, F.nullif(note, F.lit("")), F.lit(NO_DETAILS))


def signature(slab: Column, fields: Column) -> Column:
    """One text that is equal for equal briefs: slab type and each field's value and state, by name; ``fields`` are structs of field, value, provisional."""
    parts = F.transform(F.array_sort(fields), lambda f: F.concat_ws("=", f["field"], F.coalesce(f["value"], F.lit("")), F.coalesce(f["provisional"], F.lit(True)).cast("string")))
    return F.concat(slab, F.lit("|"), F.array_join(parts, ";"))


def assumption_note(depth_mm: Column, mesh: Column, mix: Column) -> Column:
    return F.concat(F.lit("Build-up ASSUMED: "), depth_mm.cast("string"), F.lit(" mm slab, "), mesh, F.lit(" mesh ("), F.coalesce(mix, F.lit(dims.DEFAULT_SPEC["conc_mix"])), F.lit(" concrete)"))
