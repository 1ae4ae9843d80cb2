"""Develop settings: stored JSON checked key by key against typed defaults, and shared between frames.

Stored settings are read as VARIANT, so a value of any type can stand at any key.  What cannot be brought to the type of
its default becomes the default; keys that the defaults lack are dropped; a section that is no object is all defaults.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a frame keeps when settings are shared: places in its own picture.  Presets leave the watermark alone too.
OWN = ["geometry", "masks"]
OWN_OF_PRESET = [*OWN, "watermark"]

_LARGEST = float(1 << 63)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _once(value: Column, then) -> Column:
    """then(value) with value worked out once for a row, however often then names it.

    A column that is named several times is otherwise written out, and run, as often: every key would parse the JSON anew.
    """
    return F.transform(F.array(value), then)[0]


def coerced(value: Column, default) -> Column:
    """A variant brought to the type of default, or default.

    Truth: truth, or whether a number is not zero.  Whole numbers: numbers and texts of numbers, cut towards zero, but no
    truth.  Numbers: numbers and texts of numbers, finite ones.  Texts: texts alone.
    """
    return _once(value, lambda v: _once(_kind(v), lambda kind: _coerced(v, kind, default)))


def _coerced(value: Column, kind: Column, default) -> Column:
    text = kind == "STRING"
    if isinstance(default, str):
        return F.when(text, F.try_variant_get(value, "$", "string")).otherwise(default)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    if isinstance(default, bool):
        truth = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        return F.coalesce(truth.when(number, F.try_variant_get(value, "$", "double") != 0), F.lit(default))
    as_number = F.when(number | text, F.try_variant_get(value, "$", "double"))
    if isinstance(default, int):
        return _once(as_number, lambda x: F.coalesce(F.when(F.abs(x) < _LARGEST, x).cast("long"), F.lit(default).cast("long")))
    return _once(as_number, lambda x: F.coalesce(F.when(F.abs(x) < F.lit(float("inf")), x), F.lit(default)))


def typed(stored: Column, defaults: dict) -> Column:
    """Stored settings (a JSON string) as a struct of the sections of defaults; masks stay as they are.

    defaults has a dict of keys per section; a section whose default is a list is kept whole where it is a list.
    """

    def section(keys):
        if isinstance(keys, list):
            return lambda at: F.coalesce(F.when(_kind(at).startswith("ARRAY"), F.to_json(at)), F.lit(json.dumps(keys)))
        return lambda at: F.struct(
            *(coerced(F.try_variant_get(at, f"$.{key}", "variant"), value).alias(key) for key, value in keys.items())
        )

    def sections(whole: Column) -> Column:
        found = {name: F.try_variant_get(whole, f"$.{name}", "variant") for name in defaults}
        return F.struct(*(_once(at, section(defaults[name])).alias(name) for name, at in found.items()))

    return _once(F.try_parse_json(stored), sections)


def neutral(defaults: dict, names: list[str] | None = None) -> Column:
    """The struct of defaults, or of some of its sections."""

    def section(keys) -> Column:
        if isinstance(keys, list):
            return F.lit(json.dumps(keys))
        whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
        return F.struct(*((F.lit(v).cast("long") if whole(v) else F.lit(v)).alias(k) for k, v in keys.items()))

    return F.struct(*(section(keys).alias(name) for name, keys in defaults.items() if names is None or name in names))


def shared(own: Column, given: Column, defaults: dict, keep: list[str] = OWN) -> Column:
    """given for a frame that has own (or null): own's sections of keep, the rest from given.

    A frame without settings gets the defaults of those sections.  Where all that is given is neutral the frame has none.
    """
    rest = [n for n in defaults if n not in keep]
    kept = [F.coalesce(own[n], neutral(defaults)[n]).alias(n) for n in keep]
    both = {n: c for n, c in zip(keep, kept)} | {n: given[n].alias(n) for n in rest}
    is_neutral = F.lit(True)
    for n in rest:
        is_neutral = is_neutral & given[n].eqNullSafe(neutral(defaults)[n])
    return F.when(~is_neutral, F.struct(*(both[n] for n in defaults)))


def with_preset(own: Column, preset: Column, defaults: dict) -> Column:
    """A preset for a frame that has own (or null): geometry, masks and watermark stay own's."""
    blank = neutral(defaults)
    parts = [(F.coalesce(own[n], blank[n]) if n in OWN_OF_PRESET else preset[n]).alias(n) for n in defaults]
    return F.struct(*parts)
