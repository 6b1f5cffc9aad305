"""Product and standards codes: canonical forms, ancestors, extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------------------------------
CODE_STRICT = r"(?<![\d,])(\d{2}(?:\.\d{2}){1,2}\.\d{1,2}(?:\.\d{3})?)(?![\d,])"
CODE = r"(?<![\d,])(\d{2}(?:\.\d{1,2}){1,3}(?:\.\d{3})?)(?![\d,])"
# the first branch keeps a whole code with three digits at its end, of which the rule (the second branch) cuts the last off
CODE_INLINE = r"(?iuU)\bОКПД2?\s*[:#=\-]?\s*([0-9]{2}(?:\.[0-9]{1,2}){2}\.\d{3}(?!\d)|[0-9]{2}(?:\.[0-9]{1,2}){1,3}(?:\.\d{3})?)"
GOST = r"(?iuU)\bГОСТ(?:\s*(Р))?\s*(?:ИСО\s*)?([0-9]+(?:\.[0-9]+)*)\s*(?:[-–—]\s*(\d{2,4}))?\b"
OST = r"(?iuU)\bОСТ\b\s*([A-ZА-Я0-9][\w\.\-\s]*)"
TU = r"(?iuU)(?<!\w)ТУ[-\s]*([A-ZА-Я0-9][\w\.\-]*)"
DIN = r"(?iuU)\bDIN\b\s*([0-9]+)"
ISO = r"(?iuU)\bISO\b\s*([0-9]+(?:[-\.]\d+)?)"
STEEL = r"(?iuU)\bст\.?\s*([0-9]{1,2}[а-я]*(?:-[0-9])?)\b"
DIAMETER = r"(?iuU)(?:^|[^\d])(?:Ø|D|DN|Du|dn|ДУ|Ду|d)?\s*[-–—]?\s*(\d{1,3}(?:[.,]\d{1,2})?)\s*(?:мм|mm)?\b"
CONFIDENCE = {"gost": 0.95, "okpd": 0.8, "ost": 0.7, "tu": 0.7, "din": 0.75, "iso": 0.75}
# --------------------------------------------------------------------------------------------------


def _pad(p: Column) -> Column:
    return F.when(F.length(p) < 2, F.lpad(p, 2, "0")).otherwise(p)


def canonical_code(code: Column) -> Column:
    """Parts padded to two digits; a last part of one to three digits stays. Null for an empty code."""
    parts = F.split(code, r"\.")
    last = F.size(parts) - 1
    out = F.transform(parts, lambda p, i: F.when((i == last) & (i > 0) & F.length(p).between(1, 3), p).otherwise(_pad(p)))
    return F.when(code != "", F.array_join(out, "."))


def breadcrumbs(code: Column) -> Column:
    """All ancestors of a dotted code and the code, from the root; empty for null."""
    parts = F.split(F.coalesce(code, F.lit("")), r"\.")
    path = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    return F.when(F.coalesce(code, F.lit("")) == "", F.array().cast("array<string>")).otherwise(path)


def standard_code(raw: Column) -> Column:
    """``ГОСТ [Р ]number[-year]`` of the first standard in a text; null without one."""
    s = F.translate(raw, "–—", "--")
    number, year = F.regexp_extract(s, GOST, 2), F.regexp_extract(s, GOST, 3)
    head = F.when(F.regexp_extract(s, GOST, 1) != "", "ГОСТ Р ").otherwise("ГОСТ ")
    return F.when(number != "", F.concat(head, number, F.when(year != "", F.concat(F.lit("-"), year)).otherwise("")))


def standard_breadcrumbs(code: Column) -> Column:
    """Dotted ancestors of a standard's number, then the number with its year."""
    body = F.regexp_replace(F.regexp_replace(code, r"^\S+ ", ""), r"(?iu)^\s*Р\s+", "")
    path = breadcrumbs(F.regexp_extract(body, r"^([^-]*)", 1))
    return F.when(F.contains(body, F.lit("-")), F.concat(path, F.array(body))).otherwise(path)


def code_of(x: Column) -> Column:
    """The code that a text names: one after its keyword, or else the first that looks like one."""
    inline = F.regexp_extract(x, CODE_INLINE, 1)
    plain = F.regexp_extract(F.replace(x, F.lit(" ")), CODE, 1)
    return F.when(inline != "", canonical_code(inline)).otherwise(canonical_code(F.nullif(plain, F.lit(""))))


def find_codes(x: Column) -> Column:
    """Codes of a text in order, but those that a standard's prefix stands close before."""
    s = F.replace(x, F.lit(" "))
    return F.regexp_extract_all(s, F.lit(CODE_STRICT.replace("(?<![\\d,])", r"(?<![\d,])(?<!(?iu:ГОСТ).{0,4})", 1)), 1)


def features(x: Column) -> Column:
    """struct(steel_grade, diameter); null parts where a text has none."""
    part = lambda p: F.nullif(F.regexp_extract(F.coalesce(x, F.lit("")), p, 1), F.lit(""))
    return F.struct(part(STEEL).alias("steel_grade"), F.replace(part(DIAMETER), F.lit(","), F.lit(".")).alias("diameter"))


def _row(ns: str, code: Column, path: Column) -> Column:
    return F.struct(F.lit(ns).alias("ns"), code.alias("code"), path.alias("path"), F.lit(CONFIDENCE[ns]).alias("conf"))


def _row_of(ns: str, path: Column):
    return lambda c: _row(ns, F.trim(c), path)


def labels(x: Column) -> Column:
    """array<struct(ns, code, path, conf)> of all labels in a text, by namespace."""
    x = F.coalesce(x, F.lit(""))
    none = F.lit(None).cast("array<string>")
    found = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(x, F.lit(GOST), 0), lambda g: standard_code(g)), lambda c: c.isNotNull()))
    inline = F.transform(F.regexp_extract_all(x, F.lit(CODE_INLINE), 1), lambda c: canonical_code(c))
    codes = F.array_distinct(F.filter(F.when(F.size(inline) > 0, inline).otherwise(find_codes(x)), lambda c: c.isNotNull()))
    out = [F.transform(found, lambda c: _row("gost", c, standard_breadcrumbs(c))), F.transform(codes, lambda c: _row("okpd", c, breadcrumbs(canonical_code(c))))]
    for ns, p in (("ost", OST), ("tu", TU), ("din", DIN), ("iso", ISO)):
        out.append(F.transform(F.regexp_extract_all(x, F.lit(p), 1), _row_of(ns, none)))
    return F.concat(*out)
