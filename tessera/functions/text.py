"""Normalization, tokens, and classifiers of texts and questions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Fixed values -------------------------------------------------------------------------------------
EXOTIC_SPACES = [0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
INVISIBLES = [0x200B, 0x200C, 0x200D, 0xFEFF, 0x00AD]
TOKEN = "[а-яёa-z0-9]{3,}"
QUESTION_STOP_WORDS = ["про", "о", "об", "обо", "расскажи", "расскажите", "подскажи", "подскажите", "покажи", "покажите", "пожалуйста", "дай", "дайте"]
SUFFIXES = ["ами", "ями", "ов", "ев", "ёв", "ей", "ёй", "ою", "ею", "ом", "ем", "ах", "ях", "ам", "ям", "у", "ю", "а", "я", "е", "и", "о", "ы"]
QUERY_REPLACEMENTS = {"сторно": "отмена выдачи", "сторнировать": "отменить выдачу", "автокаскад": "автоматически"}
IMPORTANT_TERMS = {
    "важно": 3, "внимание": 3, "обязательно": 3, "критично": 3,
    "примечание": 2, "замечание": 2, "рекомендация": 2,
    "пример": 1, "дополнительно": 1, "справка": 1,
    "настройка": 2, "конфигурация": 2, "параметр": 2,
    "ошибка": 3, "проблема": 3, "решение": 3,
    "алгоритм": 2, "процедура": 2, "функция": 2,
}
DOC_TYPES = {
    "руководство": ["настройка", "установка", "конфигурация"],
    "справочник": ["функция", "метод", "параметр", "свойство"],
    "инструкция": ["шаг", "действие", "выполните", "нажмите"],
    "описание": ["модуль", "компонент", "архитектура", "структура"],
}
QUESTION_TYPES = {
    "howto": ["как", "каким образом", "способ", "настроить", "установить", "создать"],
    "troubleshoot": ["ошибка", "проблема", "не работает", "исправить", "решение", "почему"],
    "explain": ["что такое", "объясни", "зачем", "почему", "принцип", "различие"],
    "reference": ["список", "параметры", "функции", "методы", "свойства", "команды"],
    "compare": ["сравни", "отличие", "разница", "лучше", "выбрать", "или"],
}
GREETING = r"^\s*(привет|здравств|добро(е|й)|hi|hello|hey)\b"
REALTIME_TOPICS = r"\b(погод[ауы]?|температур|дожд|снег|ветер|облачн|солнечн|гроза|курс|доллар|евро|биткоин|акци[ия]|новост|пробк|трафик|врем[яени]|который\s+час|часовой\s+пояс|расписани[ея]|рейс|самол[её]т|поезд)\b"
CODE_INTENT = r"\b(окпд2?|okpd)\b"
ITEM_SHAPE = r"\b(круг|квадрат|шестигранник|полоса|лист|лента|катанка|проволока|труба|уголок|швеллер|двутавр|арматура)\b"
ITEM_MATERIAL = r"\b(ст[0-9]+|сталь\s*\d+|aisi\s*\d+|12[хx]18[нnh]10[тt]|14[хx]17[нnh]2|40[хx]13|30[хx]гса|40[хx]|09г2с|65г|р6м5|[хx]12мф|амг\d?|1561|ад31|л[0-9]+|лс59|л63|бр[а-я0-9]+|м1|(?:vt|вт)\d?-?\d?)\b"
ITEM_AFTER, ITEM_NOISE = r"\b(?:для|по|на)\b", r"\b(какой|найд[ий]|подскажи|код|окпд2?|okpd)\b"
HIGHLIGHT = r"\b[а-яёА-ЯЁa-zA-Z0-9_\-]{4,}\b"
REALTIME_WORDS = r"\b(сегодня|завтра|послезавтра|вчера|на\s+недел\w*|на\s+выходн\w*|через\s+\d+\s*(?:минут[ауы]?|час(?:а|ов)?|дн(?:я|ей)?))\b"
VERSIONS = [r"[Вв]ерсия\s*([\d.]+)", r"v([\d.]+)", r"Version\s*([\d.]+)", r"Релиз\s*([\d.]+)"]
DATES = [(r"\d{2}\.\d{2}\.\d{4}", "dd.mm.yyyy"), (r"\d{4}-\d{2}-\d{2}", "yyyy-mm-dd"), (r"\d{2}/\d{2}/\d{4}", "dd/mm/yyyy")]
DASHES = "‐‑‒–—−"
ROLLED_FORMS = [("штрипс", "лента"), ("лента", "штрипс"), ("лист", "плита"), ("плита", "лист"), ("пруток", "круг"), ("круг", "пруток"), ("проволока", "катанка"), ("катанка", "проволока")]
QUOTES = [('"', '"'), ("«", "»"), ("“", "”"), ("‘", "’")]
# --------------------------------------------------------------------------------------------------

#: Flags for patterns over Cyrillic: case and word classes by Unicode.
_U = "(?iuU)"


def _fold_table() -> tuple[str, str]:
    """Characters of the Latin, Greek and Cyrillic blocks whose compatibility decomposition is one base
    character and marks, and that character: made from Unicode's own data."""
    src, dst = [], []
    for c in map(chr, [*range(0xA0, 0x530), *range(0x1E00, 0x2000), *range(0xFF01, 0xFF5F)]):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1 and not base.isspace():
            src.append(c)
            dst.append(base)
    return "".join(src), "".join(dst)


_FOLD = _fold_table()


def unaccent(x: Column) -> Column:
    """Base characters without marks, for the blocks of ``_fold_table``; decomposed marks go everywhere."""
    return F.regexp_replace(F.translate(x, *_FOLD), r"\p{Mn}+", "")


@pandas_udf(StringType())
def unaccent_exact(x: pd.Series) -> pd.Series:
    """The same for all of Unicode (Arrow)."""
    return x.map(lambda s: s if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if unicodedata.category(c) != "Mn"))


def is_ascii(x: Column) -> Column:
    return F.octet_length(x) == F.char_length(x)


def folded(x: Column) -> Column:
    """Lower case, ё as е, no marks, plain spaces, no invisible characters; runs of white space stay. One pass maps all characters, since each is judged by itself."""
    spaces, gone = "".join(map(chr, EXOTIC_SPACES)), "".join(map(chr, INVISIBLES))
    src, dst = _FOLD
    return F.regexp_replace(F.translate(F.lower(x), src + spaces + gone, dst + " " * len(spaces)), r"\p{Mn}+", "")


def normalize(x: Column, exact: bool = False) -> Column:
    """Lower case, ё as е, no marks, plain single spaces, no invisible characters. Null stays null.

    Texts of ASCII need no folding."""
    low = F.lower(x)
    if exact:
        spaces, gone = "".join(map(chr, EXOTIC_SPACES)), "".join(map(chr, INVISIBLES))
        plain = F.translate(unaccent_exact(F.replace(low, F.lit("ё"), F.lit("е"))), spaces + gone, " " * len(spaces))
        return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))
    return F.trim(F.when(is_ascii(x), F.regexp_replace(low, r"\s+", " ")).otherwise(F.regexp_replace(folded(x), r"(?U)\s+", " ")))


def normalize_query(x: Column) -> Column:
    out = normalize(x)
    for word, to in QUERY_REPLACEMENTS.items():
        out = F.regexp_replace(out, rf"{_U}\b{word}\b", to)
    return out


def content_hash(x: Column) -> Column:
    return F.md5(normalize(F.coalesce(x, F.lit(""))).cast("binary"))


def group_key(book: Column, title: Column) -> Column:
    part = lambda c: normalize(F.coalesce(c, F.lit("")))
    return F.md5(F.concat_ws("::", part(book), part(title)).cast("binary"))


def all_tokens(x: Column) -> Column:
    """Tokens of three or more letters and digits, in order, with repeats."""
    return F.regexp_extract_all(F.replace(F.lower(F.coalesce(x, F.lit(""))), F.lit("ё"), F.lit("е")), F.lit(TOKEN), 0)


def tokens(x: Column) -> Column:
    """The set of tokens, in order of appearance."""
    return F.array_distinct(all_tokens(x))


def stem(t: Column) -> Column:
    """Without the longest listed suffix that leaves four or more characters."""
    return F.regexp_replace(t, rf"(?<=^.{{4,60}})({'|'.join(SUFFIXES)})$", "")


def stem_tokens(x: Column) -> Column:
    stop = F.array(*map(F.lit, QUESTION_STOP_WORDS))
    return F.array_distinct(F.transform(F.array_except(all_tokens(x), stop), stem))


def overlap(query: Column, doc: Column) -> Column:
    """Share of the query's tokens that the document has; 0 for a query without tokens."""
    return F.size(F.array_intersect(query, doc)) / F.greatest(F.size(query), F.lit(1))


def sentences(x: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(x, F.lit(""))), r"(?<=[.!?…])\s+"), lambda s: s != "")


def importance(x: Column) -> Column:
    """1.0 and bonuses for weighted terms, lists, code and tables; at most 2.0."""
    low = F.lower(x)
    score = F.lit(10)  # in tenths, so that sums are exact
    for term, weight in IMPORTANT_TERMS.items():
        score = score + F.when(low.contains(term), weight).otherwise(0)
    score = score + F.when(x.rlike(r"(?m)^\s*[-•*]\s+"), 2).otherwise(0)
    score = score + F.when(x.rlike(r"(?m)```|^\s{4,}\S"), 3).otherwise(0)
    score = score + F.when(F.length(x) - F.length(F.replace(x, F.lit("|"))) > 5, 3).otherwise(0)
    return F.least(score, F.lit(20)) / 10.0


def _first_class(x: Column, classes: dict[str, list[str]], least: int) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(classes.items()):
        hits = sum((x.contains(w).cast("int") for w in words), F.lit(0))
        out = F.when(hits >= least, name).otherwise(out)
    return out


def doc_type(x: Column) -> Column:
    """The first class with two of its indicators in the first 3000 characters; null if none has."""
    return _first_class(F.lower(F.substring(x, 1, 3000)), DOC_TYPES, 2)


def question_type(x: Column) -> Column:
    return F.coalesce(_first_class(F.lower(F.coalesce(x, F.lit(""))), QUESTION_TYPES, 1), F.lit("general"))


def is_smalltalk(x: Column) -> Column:
    """Empty, or a greeting with at most one word after it."""
    q = F.trim(F.coalesce(x, F.lit("")))
    tail = F.regexp_replace(q, _U + GREETING, "")
    words = F.size(F.regexp_extract_all(tail, F.lit("[A-Za-zА-Яа-яЁё0-9]+(?:-[A-Za-zА-Яа-яЁё0-9]+)?"), 0))
    return (q == "") | (q.rlike(_U + GREETING) & (words <= 1))


def is_realtime(x: Column) -> Column:
    """Asks for what changes by the day (weather, rates) about a given day."""
    return x.rlike(_U + REALTIME_TOPICS) & x.rlike(_U + REALTIME_WORDS)


def asks_for_code(x: Column) -> Column:
    """Names the classifier of products, or a form together with a material."""
    x = F.lower(F.coalesce(x, F.lit("")))
    return x.rlike(_U + CODE_INTENT) | (x.rlike(_U + ITEM_SHAPE) & x.rlike(_U + ITEM_MATERIAL))


def item_asked_for(x: Column) -> Column:
    """What stands after the first preposition (or the whole question), without the words of asking."""
    x = F.coalesce(x, F.lit(""))
    tail = F.when(x.rlike(_U + ITEM_AFTER), F.regexp_replace(x, rf"(?s){_U}^.*?{ITEM_AFTER}", "")).otherwise(x)
    return F.trim(F.regexp_replace(F.regexp_replace(tail, _U + ITEM_NOISE, " "), r"(?U)\s+", " "))


def highlights(variants: Column) -> Column:
    """The set of words of four characters or more of a query's variants (an array), in lower case, sorted."""
    words = F.regexp_extract_all(F.array_join(variants, " "), F.lit("(?U)" + HIGHLIGHT), 0)
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.lower(w))))


def fuzzy_overlap(query: Column, doc: Column) -> Column:
    """``overlap`` that also counts a query token of four characters or more within one edit (two from ten) of a doc token."""
    near = lambda t: F.exists(doc, lambda v: F.levenshtein(t, v, 2) <= F.when(F.levenshtein(t, v, 2) < 0, -2).when(F.length(t) >= 10, 2).otherwise(1))
    hit = F.filter(query, lambda t: F.array_contains(doc, t) | ((F.length(t) >= 4) & near(t)))
    return F.size(hit) / F.greatest(F.size(query), F.lit(1))


def adaptive_min_score(n_tokens: Column) -> Column:
    return F.when(n_tokens <= 2, 0.35).when(n_tokens <= 4, 0.25).otherwise(0.15)


def token_estimate(x: Column) -> Column:
    """Tokens of a text without its tokenizer: four characters each, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(x) / 4)).cast("int")


def version(x: Column) -> Column:
    head = F.substring(x, 1, 1000)
    return F.coalesce(*[F.nullif(F.regexp_extract(head, f"(?iu){p}", 1), F.lit("")) for p in VERSIONS])


def date_found(x: Column) -> Column:
    """struct(date, date_format) of the first pattern with a match; null without any."""
    head, out = F.substring(x, 1, 1000), F.lit(None)
    for p, name in reversed(DATES):
        hit = F.regexp_extract(head, f"({p})", 1)
        out = F.when(hit != "", F.struct(hit.alias("date"), F.lit(name).alias("date_format"))).otherwise(out)
    return out


def retrieval_normalize(x: Column) -> Column:
    """One kind of dash, ``N x M`` sizes joined, single spaces."""
    s = F.translate(F.coalesce(x, F.lit("")), DASHES, "-" * len(DASHES))
    s = F.regexp_replace(s, r"(?iu)(?<=\d)\s*[xх×*]\s*(?=\d)", "x")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def query_expansions(x: Column, most: int = 12) -> Column:
    """Variants of a normalized query: joined designations, Latin look-alikes, other names of forms,
    standards by number; distinct without regard to case, the first ``most``."""
    base = F.translate(x, "Ёё", "Ee")
    standards = F.transform(F.regexp_extract_all(base, F.lit(r"(?iu)(?<!\d)(?:ГОСТ|GOST)?\s*([0-9]{3,6})(?:-\d{2,4})?(?!\d)"), 1), lambda n: F.array(F.concat(F.lit("ГОСТ "), n), F.concat(F.lit("GOST "), n)))
    forms = [F.when(base.rlike(rf"{_U}\b{a}\b"), F.regexp_replace(base, rf"{_U}\b{a}\b", b)) for a, b in ROLLED_FORMS]
    made = [x, F.regexp_replace(base, r"\s*-\s*", "-"), F.regexp_replace(base, r"(?<=\b[А-ЯA-Z]{2,12})\s+(?=\d)", ""), F.translate(base, "ХхНнСс", "XxHhCc"), *forms]
    every = F.concat(F.array(*made), F.flatten(standards), F.array(F.regexp_replace(base, r"(?i)\s*x\s*", "x")))
    every = F.filter(F.transform(every, F.trim), lambda v: v != "")
    low = lambda a: F.transform(a, lambda v: F.lower(v))
    return F.slice(F.filter(every, lambda v, i: ~F.array_contains(low(F.slice(every, 1, i)), F.lower(v))), 1, most)


def levenshtein_hit(word: Column, vocabulary: Column, most: int = 1) -> Column:
    """Whether a word is within ``most`` edits of one in an array."""
    return F.exists(vocabulary, lambda v: F.levenshtein(word, v, most) >= 0)


# Cleaning -----------------------------------------------------------------------------------------


def strip_quotes(x: Column) -> Column:
    """Each line without white space around it and without one pair of wrapping quotes."""

    def line(s: Column) -> Column:
        s = F.trim(s)
        out = s
        for a, b in reversed(QUOTES):
            inside = F.trim(F.substr(s, F.lit(2), F.length(s) - 2))
            out = F.when((F.length(s) >= 2) & s.startswith(a) & s.endswith(b), inside).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(x, "\n"), line), "\n")


def _keyed(parts: Column) -> Column:
    """One struct of an array's parts and their normalized forms, inside an array of one: made once, used often."""
    return F.transform(F.array(parts), lambda p: F.struct(p.alias("p"), F.transform(p, lambda x: normalize(x)).alias("k")))


def collapse_lines(x: Column) -> Column:
    """Without lines whose normalized form is that of the line before."""
    keep = lambda s: F.filter(s.p, lambda _, i: (i == 0) | ~F.get(s.k, i).eqNullSafe(F.get(s.k, i - 1)))
    return F.transform(_keyed(F.split(x, "\n")), lambda s: F.array_join(keep(s), "\n"))[0]


def drop_repeated_paragraphs(x: Column, short: int = 200) -> Column:
    """Repeated paragraphs under ``short`` characters stay once, at their first place."""
    keep = lambda s: F.filter(s.p, lambda p, i: (F.trim(p) == "") | (F.length(p) >= short) | (F.array_position(s.k, F.get(s.k, i)) == i + 1))
    return F.transform(_keyed(F.split(x, r"\n\s*\n+")), lambda s: F.array_join(keep(s), "\n\n"))[0]


#: Letters that the patterns over Cyrillic words can match, in either case.
_CYRILLIC = r"[\u0400-\u052F\u1C80-\u1C8F\uA640-\uA69F]"
_RULES_OFF = [(r"_{10,}", ""), (r"-{10,}", "")]
_PAGE, _HYPHEN = (r"(?iuU)Стр(?:аница)?\.?\s*\d+\s*(?:из\s*\d+)?", ""), (r"(?iu)([а-яё])\s*-\s*\n\s*([а-яё])", "$1$2")


def _replaced(s: Column, steps: list[tuple[str, str]]) -> Column:
    for p, to in steps:
        s = F.regexp_replace(s, p, to)
    return s


def clean(x: Column, keep_paragraphs: bool = False) -> Column:
    """The cleaning pipeline in its order; lines are joined over white space unless ``keep_paragraphs``.

    Texts without Cyrillic letters skip the patterns over them."""
    s = x
    for c, to in (("\u200b", " "), ("\ufeff", " "), ("\r\n", "\n"), ("\r", "\n")):
        s = F.replace(s, F.lit(c), F.lit(to))
    s = _replaced(s, [(r"\n{4,}", "\n\n\n"), (r"[ \t]{2,}|\t", " ")])
    s = F.replace(s, F.lit(" \n"), F.lit("\n"))  # no longer run of blanks is left
    s = F.transform(F.array(s), lambda s: F.when(s.rlike(_CYRILLIC), _replaced(s, [_PAGE, *_RULES_OFF, _HYPHEN])).otherwise(_replaced(s, _RULES_OFF)))[0]
    if not keep_paragraphs:
        s = F.regexp_replace(s, r"(?U)(\w)\s*\n\s*(\w)", "$1 $2")
    return F.trim(drop_repeated_paragraphs(collapse_lines(strip_quotes(s))))



