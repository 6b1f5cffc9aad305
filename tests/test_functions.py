"""Micro-fixtures: expected values traced by hand from the rules."""

import hashlib
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import codes as C
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import answers, chunking, context, labels


def col(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("x,want", [("  ЁЛКА  и ёж​ ", "елка и еж"), ("Crème BRÛLÉE", "creme brulee"), ("й", "и"), ("", ""), (None, None), ("ﬀ①", "ﬀ①"), ("é", "e")])
def test_normalize(spark, x, want):
    assert col(spark, x, T.normalize) == want


def test_exact_normalization_is_unicode(spark):
    x = "Ａﬀ① Ёлка ü ß é"
    want = "".join(c for c in unicodedata.normalize("NFKD", x.lower().replace("ё", "е")) if unicodedata.category(c) != "Mn")
    assert col(spark, x, lambda c: T.normalize(c, exact=True)) == want


def test_hashes(spark):
    assert col(spark, " A  Б ", T.content_hash) == hashlib.md5("a б".encode()).hexdigest()
    assert col(spark, "Book", lambda c: T.group_key(c, F.lit(None).cast("string"))) == hashlib.md5(b"book::").hexdigest()


def test_tokens(spark):
    assert col(spark, "Ёлка и ёж 12 abc abc", T.tokens) == ["елка", "abc"]
    assert col(spark, "расскажи про склады складами", T.stem_tokens) == ["склад"]
    assert col(spark, None, T.tokens) == []


@pytest.mark.parametrize("x,want", [("складами", "склад"), ("дома", "дома"), ("окнами", "окнам"), ("болтов", "болт"), ("abc", "abc")])
def test_stem(spark, x, want):
    assert col(spark, x, T.stem) == want


def test_importance(spark):
    assert col(spark, "важно: ошибка", T.importance) == 1.6
    assert col(spark, "- пункт\n```code```\n|a|b|c|d|e|f|", T.importance) == 1.8
    assert col(spark, "", T.importance) == 1.0


def test_classes(spark):
    assert col(spark, "Настройка и установка", T.doc_type) == "руководство"
    assert col(spark, "настройка", T.doc_type) is None
    assert [col(spark, x, T.question_type) for x in ("Как настроить", "почему ошибка", "что такое ХВГ", "привет", None)] == ["howto", "troubleshoot", "explain", "general", "general"]
    assert [col(spark, x, T.is_smalltalk) for x in ("привет", "Привет, друг!", "привет как дела", "", None, "вопрос")] == [True, True, False, True, True, False]
    assert col(spark, "какая погода сегодня", T.is_realtime) and not col(spark, "какая погода", T.is_realtime)
    assert [col(spark, n, T.adaptive_min_score, "int") for n in (2, 4, 5)] == [0.35, 0.25, 0.15]


def test_versions_and_dates(spark):
    assert col(spark, "Версия 2.10.3 от 01.02.2023", T.version) == "2.10.3"
    d = col(spark, "2024-05-06 и 01.02.2023", T.date_found)
    assert (d["date"], d["date_format"]) == ("01.02.2023", "dd.mm.yyyy")
    assert col(spark, "нет", T.date_found) is None


def test_retrieval_normalize_and_expansions(spark):
    assert col(spark, " лист 0,8 × 90  –  сталь ", T.retrieval_normalize) == "лист 0,8x90 - сталь"
    got = col(spark, "лента 12Х18Н10Т ГОСТ 4986-79", T.query_expansions)
    assert got[0] == "лента 12Х18Н10Т ГОСТ 4986-79" and "штрипс 12Х18Н10Т ГОСТ 4986-79" in got and "ГОСТ 4986" in got and "GOST 4986" in got and "леhта 12X18H10Т ГОCТ 4986-79" in got
    assert len(got) <= 12 and len({x.lower() for x in got}) == len(got)


def test_cleaning(spark):
    assert col(spark, "Heading\n\nBody text here.\n\nNext para", T.clean) == "Heading Body text here.\n\nNext para"
    assert col(spark, "«цитата»\n«цитата»\nx", T.strip_quotes) == "цитата\nцитата\nx"
    assert col(spark, "A\na \nB\nA", T.collapse_lines) == "A\nB\nA"
    assert col(spark, "p\n\nq\n\np", T.drop_repeated_paragraphs) == "p\n\nq"
    assert "Страница" not in col(spark, "текст.\nСтраница 3 из 9\nдальше", T.clean)


@pytest.mark.parametrize("x,want", [("1.2.3", "01.02.3"), ("24.10.31.000", "24.10.31.000"), ("5", "05"), ("", None), ("24.1.2.3", "24.01.02.3")])
def test_canonical(spark, x, want):
    assert col(spark, x, C.canonical_code) == want


def test_breadcrumbs(spark):
    assert col(spark, "24.10.31.000", C.breadcrumbs) == ["24", "24.10", "24.10.31", "24.10.31.000"]
    assert col(spark, None, C.breadcrumbs) == []
    assert col(spark, "ГОСТ 11326.37-79", C.standard_breadcrumbs) == ["11326", "11326.37", "11326.37-79"]
    assert col(spark, "ГОСТ Р 58144-2018", C.standard_breadcrumbs) == ["58144", "58144-2018"]


def test_standards_and_labels(spark):
    assert col(spark, "по ГОСТ Р 58144–2018 и", C.standard_code) == "ГОСТ Р 58144-2018"
    assert col(spark, "без", C.standard_code) is None
    got = col(spark, "Болт ГОСТ 7798-70, ГОСТ 7798-70, ОКПД2: 25.94.11.110 DIN 933 ISO 4014-1 ТУ 14-1-100 ОСТ 1", C.labels)
    assert [(r["ns"], r["code"]) for r in got][:2] == [("gost", "ГОСТ 7798-70"), ("okpd", "25.94.11.110")]
    assert {r["ns"] for r in got} == {"gost", "okpd", "ost", "tu", "din", "iso"}
    assert col(spark, "код 24.10.31.000 есть", C.find_codes) == ["24.10.31.000"]
    f = col(spark, "ст.45 Ø 12,5 мм", C.features)
    assert (f["steel_grade"], f["diameter"]) == ("45", "45")  # the first number that can be one


def test_safe_attach(spark):
    h = spark.createDataFrame([("24", 1), ("24.10", 2), ("24.10.31", 3), ("24.10.31.000", 4), ("25.94", 2)], "code string, level int")
    p = spark.createDataFrame([(1, "24.10.31.000", 0.95), (2, "24.10.31.000", 0.80), (3, "25.94.11.110", 0.96), (4, "99.1", 0.99), (5, "24.10", 0.98)], "id int, code string, conf double")
    got = {r["id"]: (r["code"], r["conf"], r["is_final"]) for r in labels.safely_attached(p, h).collect()}
    assert got == {1: ("24.10.31.000", 0.95, True), 2: ("24.10.31", 0.80, False), 3: ("25.94", 0.85, False), 4: (None, 0.85, False), 5: ("24.10", 0.98, True)}


def test_tail_and_head(spark):
    assert col(spark, "One two. tail without end", context.tail) == "tail without end"
    assert col(spark, "no sentence end", context.tail) == "no sentence end"
    assert col(spark, "First one. Second one. Third", context.head) == "Second one. Third"
    assert len(col(spark, "x" * 900, context.tail)) == 220


def test_overlap_length(spark):
    df = spark.createDataFrame([("abc" * 20 + "Z" * 60, "Z" * 60 + "tail"), ("abc", "abc"), ("q" * 300, "q" * 300)], "a string, b string")
    assert [r[0] for r in df.select(answers.overlap_length(F.col("a"), F.col("b"))).collect()] == [60, 0, 200]


def test_vector_repair(spark):
    got = col(spark, [3.0, float("nan"), 4.0], lambda c: V.repair(c, 4), "array<float>")
    assert got == pytest.approx([0.6, 0, 0.8, 0])
    assert col(spark, [1.0] * 6, lambda c: V.repair(c, 4), "array<float>") == pytest.approx([0.5] * 4)
    assert col(spark, None, lambda c: V.repair(c, 2), "array<float>") == [0, 0]


def test_sections(spark):
    text = "pre\n# Title\nbody one\n1 Введение ... 4\n2 Second Part\nbody two\nГлава 3. Конец\nend"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r["title"], r["level"], r["body"]) for r in chunking.sections(df).orderBy("section_no").collect()]
    assert got == [("Введение", 0, "pre"), ("# Title", 3, "body one\n1 Введение ... 4"), ("2 Second Part", 2, "body two"), ("Глава 3. Конец", 3, "end")]


def test_sentences_keep_abbreviations():
    assert chunking.split_sentences("Одно здесь. Второе там! третье тут. Конец") == ["Одно здесь.", "Второе там! третье тут.", "Конец"]
    assert len(chunking.split_sentences("См. рис. 5 здесь. И.И. Иванов")) == 2


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc .!?\n", max_size=3000))
def test_chunks_cover_the_text(text):
    for split in (chunking.pack_chars, chunking.pack_tokens):
        got = split(text)
        have = set("".join(got).split())
        assert all(w in "".join(got) or len(w) > 3000 for w in text.split())
        assert have or not text.split()
        assert all(len(c) <= chunking.CHAR_CAP for c in got) or split is chunking.pack_chars


@pytest.mark.parametrize(
    "text,code,conf",
    [
        ("Болт М10х40", "25.94.11.110", 0.85), ("привет", "UNSURE", 0.2), (None, "UNSURE", 0.2), ("Сталь 45", "UNSURE", 0.4),
        ("Лист АМг6 2x1200", "24.42.24", 0.90), ("Проволока Св-08Г2С 1.2", "24.34.13.120", 0.95), ("Припой ПОС-61", "24.43.24", 0.88),
        ("подшипник игольчатый", "28.15.10.128", 0.96), ("Клапан DN 50 фланцевый", "28.14.12", 0.92), ("изделие ГОСТ 7376-89", "UNSURE", 0.4),
        ("вещь DIN 933", "25.94.11.110", 0.92), ("Лента Л63 0.5x700", "24.44.24.110", 0.95), ("Круг Д16", "24.42.22", 0.90), ("наконечник", "25.99.29", 0.80),
    ],
)
def test_classifier(spark, text, code, conf):
    from tessera.operators import classify

    r = classify.classified(spark.createDataFrame([(text,)], "text string")).first()
    assert (r["code"], r["conf"]) == (code, conf), r


@pytest.mark.parametrize(
    "text,asks,item",
    [
        ("Подскажи код ОКПД2 для болта М10", True, "болта М10"), ("круг 12Х18Н10Т на склад", True, "склад"), ("круг на складе", False, "складе"),
        ("какой окпд у трубы", True, "у трубы"), (None, False, ""),
    ],
)
def test_code_questions(spark, text, asks, item):
    assert (col(spark, text, T.asks_for_code, "string"), col(spark, text, T.item_asked_for, "string")) == (asks, item)


def test_fuzzy_overlap_and_highlights(spark):
    df = spark.createDataFrame([(["маркировки", "склад", "кот", "нет"], ["моркировки", "склады", "код"])], "q array<string>, d array<string>")
    assert df.select(T.fuzzy_overlap(F.col("q"), F.col("d"))).first()[0] == 0.5
    assert col(spark, ["Склад и маркировка", "склад-2 x"], T.highlights, "array<string>") == ["маркировка", "склад", "склад-2"]


def test_bound_columns_are_made_once(spark):
    from tessera.functions.binding import bound

    x = spark.range(4)
    for _ in range(12):  # merged projections and pushed filters would double the expression each time
        x = bound(x, id2=F.col("id") + F.col("id") % 2).where("id2 >= 0").select(F.col("id2").alias("id"))
    assert x.count() == 4 and len(x._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_typos_beyond_first_letters(spark):
    from tessera.operators import retrieval

    q = spark.createDataFrame([(1, "ксладской пирбор")], "query_id int, text string")
    v = spark.createDataFrame([("складской",), ("прибор",), ("прибоя",)], "word string")
    assert retrieval.typos_fixed(q, v).first()["text"] == "складской прибор"


def test_pages_follow_keys(spark):
    from tessera.operators import analytics

    rows = spark.createDataFrame([(i,) for i in (9, 3, 7, 1)], "id int")
    first = [r[0] for r in analytics.page_after(rows, None, 3).collect()]
    assert first == [1, 3, 7] and [r[0] for r in analytics.page_after(rows, 7, 3).collect()] == [9]
