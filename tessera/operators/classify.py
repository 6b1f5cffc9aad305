"""Product items to codes: material, form and standards found by patterns, then a decision list.

Forms, grades, signs and rules are rows of ``classify_tables``. Each step binds what it finds as columns
(``functions.binding``), and the next one reads only these: the plan grows with the rows, not with their
product. All of it runs in the JVM and moves no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import codes as C
from tessera.functions.binding import bound
from tessera.operators import classify_tables as R

_U = "(?iuU)"


def _has(x: Column, pattern: str) -> Column:
    return x.rlike(_U + pattern)


def _part(x: Column, pattern: str, group: int = 1, flags: str = _U) -> Column:
    return F.nullif(F.regexp_extract(x, flags + pattern, group), F.lit(""))


def _sql(value: str) -> str:
    return "r'" + value.replace("'", "''") + "'"


def _lookup(table: dict[str, str], key: str) -> Column:
    return F.expr(f"try_element_at(map({', '.join(_sql(v) for row in table.items() for v in row)}), {key})")


def _first(conditions: list[str]) -> Column:
    """The number (from 1) of the first condition that holds; null if none does."""
    return F.expr(f"CASE {' '.join(f'WHEN {c} THEN {k}' for k, c in enumerate(conditions, 1))} END")


def _nth(values: list[str], number: str) -> Column:
    """The value with this number; only that one is evaluated."""
    return F.expr(f"CASE {number} {' '.join(f'WHEN {k} THEN {v}' for k, v in enumerate(values, 1))} END")


def form(x: Column) -> Column:
    """The form that a text begins with, in capitals; a strip named anywhere is a band."""
    first = F.upper(_part(x, rf"^({'|'.join(R.FORMS)})\b"))
    return F.coalesce(first, F.when(_has(x, R.SIGNS["strip"]), "ЛЕНТА"))


def with_material(items: DataFrame, x: Column) -> DataFrame:
    """``items`` with ``material`` and ``material_code``: the grade after the last slash (or anywhere).

    The code is null for grades of no list."""
    d = bound(items, _part=F.element_at(F.split(x, "/"), -1))
    part = F.col("_part")
    d = bound(d, _grade=_first([f"_part RLIKE {_sql(_U + p)}" for p, _, _ in R.GRADES]))
    name = _nth([f"replace({_sql(n)}, '$1', regexp_extract(_part, {_sql(_U + p)}, 1))" if "$1" in n else _sql(n) for p, _, n in R.GRADES], "_grade")
    steel = F.when(F.col("_grade").isNull(), _part(part, R.STEEL))
    d = bound(d, _name=name, _steel=steel)
    other = F.when(F.coalesce("_name", "_steel").isNull(), F.coalesce(*[_part(part, p, 1, "(?uU)") for p in R.OTHER_GRADES]))
    code = _nth([_sql(c) for _, c, _ in R.GRADES], "_grade")
    d = bound(d, material=F.coalesce("_name", "_steel", other), material_code=F.coalesce(code, F.when(F.col("_steel").isNotNull(), "24.10.61")))
    return d.drop("_part", "_grade", "_name", "_steel")


def _family(name: Column, code: Column) -> Column:
    up, code = F.upper(name), F.coalesce(code, F.lit(""))
    out = F.when(name.isNull(), None)
    for family, begins, words in R.FAMILIES:
        holds = up.rlike("|".join(words))
        if begins:
            holds = holds | code.startswith(begins)
        if family == "SS":
            holds = holds | up.rlike(R.STAINLESS)
        out = out.when(holds, family)
    return out.otherwise("FE")


def _number(x: Column) -> Column:
    return F.replace(x, F.lit(","), F.lit("."))


#: What is found in a text, in the order of ``info``.
INFO = ["form", "size", "length", "thickness", "width", "gost", "tu", "ost", "din", "iso", "material", "material_code", "surface", "heat_treatment", "coating"]


def found(items: DataFrame, text_col: str = "text") -> DataFrame:
    """``items`` with a column ``_<name>`` for each name of ``INFO``."""
    d = bound(items, _x=F.coalesce(F.col(text_col), F.lit("")))
    x = F.col("_x")
    d = with_material(bound(d, _t=form(x)), x)
    t = F.col("_t")
    thread = t.isin("БОЛТ", "ВИНТ", "ГАЙКА", "ШПИЛЬКА")
    flat = t.isin("ПЛИТА", "ЛИСТ", "ПОЛОСА", "ЛЕНТА")
    thick = F.when(flat, _number(_part(x, R.FLAT_SIZE, 1, "(?uU)")))
    wide = F.when(flat, _number(_part(x, R.FLAT_SIZE, 2, "(?uU)")))
    shape = F.concat_ws("x", *[_part(x, R.SHAPED_SIZE, k, "(?uU)") for k in (1, 2, 3)])
    size = (
        F.when(thread, F.concat(F.lit("M"), _part(x, R.THREAD_SIZE, 1)))
        .when(flat, F.coalesce(thick, _number(_part(x, R.FIRST_NUMBER, 1, "(?uU)"))))
        .when(t.isin("КРУГ", "ПРУТОК", "ПРОВОЛОКА"), _number(_part(x, R.ROUND_SIZE, 1, "(?uU)")))
        .when(t.isin("УГОЛОК", "ШВЕЛЛЕР", "ДВУТАВР", "ПРОФИЛЬ"), F.nullif(shape, F.lit("")))
    )
    said = _number(_part(x, R.WIDTH_SAID))
    fields = {
        "form": t, "size": size, "length": F.when(thread, _part(x, R.THREAD_SIZE, 2)), "thickness": thick, "width": F.coalesce(said, wide),
        "gost": F.array_distinct(F.regexp_extract_all(x, F.lit(C.GOST), 2)), "tu": _part(x, R.TU), "ost": F.trim(_part(x, R.OST)),
        "din": _part(x, R.DIN), "iso": _part(x, R.ISO), "material": F.col("material"), "material_code": F.col("material_code"),
        "surface": _has(x, R.SURFACE), "heat_treatment": _has(x, R.HEAT_TREATMENT),
        "coating": _has(x, R.COATING),
    }
    return bound(d, **{f"_{n}": fields[n] for n in INFO}).select(*items.columns, *[f"_{n}" for n in INFO])


def info(items: DataFrame, text_col: str = "text") -> DataFrame:
    """``items`` with ``info``: a struct of ``INFO``."""
    return found(items, text_col).select(*items.columns, F.struct(*[F.col(f"_{n}").alias(n) for n in INFO]).alias("info"))


def facts(items: DataFrame, text_col: str = "text") -> DataFrame:
    """``found`` and the columns that the rules of ``classify_tables`` read."""
    d = found(items, text_col)
    x, gost = F.coalesce(F.col(text_col), F.lit("")), F.col("_gost")
    named = {n: F.col(f"_{n}") for n in ("form", "material", "material_code", "din", "iso")}
    number = F.try_element_at(F.filter(gost, lambda g: g.isin(*R.GOST_CODES)), F.lit(1))
    d = bound(d, **named, **{n: _has(x, p) for n, p in R.SIGNS.items()}, gost_number=number, width_said=F.col("_width").try_cast("double"), narrow=F.array_contains(gost, "4986"), cold_standard=F.array_contains(gost, "19904"), hot_standard=F.array_contains(gost, "19903"))
    t = F.col("form")
    d = bound(d, family=F.when(t.isNotNull(), _family(F.col("material"), F.col("material_code"))), gost_code=_lookup(R.GOST_CODES, "gost_number"), din_code=_lookup(R.DIN_CODES, "din"), iso_code=_lookup(R.ISO_CODES, "split(iso, '[-.]')[0]"), form_code=_lookup(R.FORM_CODES, "form"))
    family = F.col("family")
    base = F.coalesce(*[F.when(family.isin(f, *(["FEA"] if f == "FE" else [])), _lookup(codes, "form")) for f, codes in R.FAMILY_FORMS.items()])
    name = _lookup(R.FAMILY_NAMES, "family")
    sql = {
        "cold": "cold_word OR cold_standard", "hot": "hot_word OR hot_standard", "kind": "lower(form)", "width": "nullif(width_said, 0.0)",
        "band": "coalesce(family IS NOT NULL AND form = 'ЛЕНТА', false)", "sheet": "coalesce(family IS NOT NULL AND form IN ('ЛИСТ', 'ПЛИТА'), false)",
        "sheet_conf": "CASE WHEN width_said < 600 AND width_said <> 0 THEN 0.75 ELSE 0.90 END",
    }
    d = bound(d, base=base, family_name=name, metal=F.when(family == "FEA", "сталь").otherwise(name), **{n: F.expr(e) for n, e in sql.items()})
    depth = lambda c: F.coalesce(F.size(F.split(c, r"\.")), F.lit(0))
    return bound(d, deeper=F.coalesce(depth(F.col("material_code")) > depth(F.col("base")), F.lit(False)))


def classified(items: DataFrame, text_col: str = "text") -> DataFrame:
    """``items`` with ``code``, ``conf``, ``desc`` and ``info``; ``UNSURE`` where nothing decides.

    The rules in their order: bearings, pipe fittings, form and material together, solder, material
    alone (unsure), standards, form alone, special cases.
    """
    d = bound(facts(items, text_col), _rule=_first([c for c, _, _, _ in R.RULES]))
    at = lambda k: _nth([r[k] for r in R.RULES], "_rule")
    d = bound(d, code=C.canonical_code(at(1)), conf=at(2).cast("double"), desc=at(3))
    return d.select(*items.columns, "code", "conf", "desc", F.struct(*[F.col(f"_{n}").alias(n) for n in INFO]).alias("info"))
