"""Synonyms of a query's words: a dictionary of keys, and an automaton that finds all of them in one pass.

A key is a word or phrase, or, with ``*`` at its end, the beginning of a word. The automaton is a trie of the keys
with failure links (to the longest proper suffix that is in the trie), so a text is read once, however many
keys there are.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The library's own dictionary: office, stock and engineering words, each with words that say about the same.
SYNONYMS = {
    "счет": ["инвойс", "счет на оплату"], "инвойс": ["счет"], "счет-фактура": ["фактура"], "фактура": ["счет-фактура"], "оплат*": ["платеж"],
    "платеж": ["оплата", "перевод"], "аванс": ["предоплата"], "предоплата": ["аванс"], "долг": ["задолженность"], "задолженност*": ["долг"],
    "договор": ["контракт", "соглашение"], "контракт": ["договор"], "соглашение": ["договор"], "приложение": ["дополнение"], "подпис*": ["визирование"],
    "заказ": ["заявка"], "заявк*": ["заказ"], "покупател*": ["клиент"], "клиент": ["покупатель", "заказчик"], "заказчик": ["клиент"],
    "поставщик": ["продавец"], "продавец": ["поставщик"], "закупк*": ["покупка", "снабжение"], "снабжение": ["закупка"], "продаж*": ["реализация", "сбыт"],
    "сбыт": ["продажа"], "реализация": ["продажа"], "скидк*": ["дисконт"], "наценка": ["надбавка"], "цена": ["стоимость"],
    "стоимост*": ["цена"], "склад": ["хранилище"], "хранилище": ["склад"], "остат*": ["запас"], "запас": ["остаток"],
    "инвентаризаци*": ["пересчет"], "пересчет": ["инвентаризация"], "приемк*": ["поступление"], "поступление": ["приход"], "приход": ["поступление"],
    "отгрузк*": ["отправка"], "отправк*": ["отгрузка"], "списание": ["расход"], "расход": ["списание"], "возврат": ["возвращение"],
    "перемещение": ["передача"], "доставк*": ["перевозка"], "перевозк*": ["доставка", "транспортировка"], "упаковк*": ["тара"], "тара": ["упаковка"],
    "партия": ["серия"], "серия": ["партия"], "номенклатура": ["перечень товаров"], "товар": ["продукция"], "продукция": ["товар", "изделия"],
    "изделие": ["деталь"], "деталь": ["изделие"], "заготовк*": ["полуфабрикат"], "полуфабрикат": ["заготовка"], "сырье": ["материал"],
    "материал": ["сырье"], "сталь": ["металл"], "труба": ["трубопровод"], "лист": ["пластина"], "болт": ["винт"],
    "гайка": ["крепеж"], "станок": ["оборудование"], "оборудование": ["техника"], "инструмент": ["оснастка"], "оснастка": ["приспособление"],
    "чертеж": ["схема"], "схема": ["чертеж"], "стандарт": ["норматив"], "норматив": ["стандарт"], "допуск": ["отклонение"],
    "брак": ["дефект"], "дефект": ["брак", "неисправность"], "неисправност*": ["поломка"], "поломка": ["неисправность"], "ремонт": ["починка"],
    "обслуживание": ["сервис"], "сервис": ["обслуживание"], "проверк*": ["контроль"], "контроль": ["проверка"], "испытани*": ["тест"],
    "отчет": ["сводка"], "сводка": ["отчет"], "справка": ["сведения"], "сведения": ["данные"], "документ": ["бумага"],
    "бланк": ["форма"], "форма": ["бланк"], "печать": ["распечатка"], "распечат*": ["печать"], "файл": ["документ"],
    "папка": ["каталог"], "каталог": ["справочник"], "справочник": ["каталог"], "реестр": ["журнал"], "журнал": ["реестр"],
    "учет": ["регистрация"], "регистраци*": ["учет"], "бухгалтер*": ["учетный работник"], "налог": ["сбор"], "зарплат*": ["оклад"],
    "оклад": ["зарплата"], "сотрудник": ["работник"], "работник": ["сотрудник"], "отпуск": ["отдых"], "начальник": ["руководитель"],
    "руководител*": ["начальник"], "отдел": ["подразделение"], "подразделение": ["отдел"], "пароль": ["код доступа"], "доступ": ["права"],
    "вход": ["авторизация"], "авторизаци*": ["вход"], "настройк*": ["параметры"], "параметр*": ["настройка"], "обновлени*": ["новая версия"],
    "удалить": ["стереть"], "изменить": ["исправить"], "исправить": ["изменить"], "создать": ["добавить"], "добавить": ["создать"],
}


def table(spark: SparkSession, words: dict[str, list[str]] = SYNONYMS) -> DataFrame:
    """(key, synonym) of a dictionary."""
    return spark.createDataFrame([(k, s) for k, of in words.items() for s in of], "key string, synonym string")


def _letter(c: str) -> bool:
    return c.isalnum() or c == "_"


def letter_of(letters: str = "") -> Callable[[str], object]:
    """Whether a character is one of ``letters`` (as in a pattern's brackets); without these, of Unicode's letters, digits and ``_``."""
    return re.compile(f"[{letters}]").match if letters else _letter


class Automaton:
    """Finds all keys in a text in one pass."""

    def __init__(self, keys: list[str], letters: str = ""):
        self.keys, self.letter = keys, letter_of(letters)
        self.step: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]  # keys that end in a state, those of its suffixes too
        for number, key in enumerate(keys):
            at = 0
            for c in key.removesuffix("*"):
                if c not in self.step[at]:
                    self.step[at][c] = len(self.step)
                    self.step.append({})
                    self.ends.append([])
                at = self.step[at][c]
            if at:
                self.ends[at].append(number)
        self.fail = [0] * len(self.step)
        queue = deque(self.step[0].values())
        while queue:
            at = queue.popleft()
            for c, to in self.step[at].items():
                self.fail[to] = self._next(self.fail[at], c)
                self.ends[to] = self.ends[to] + self.ends[self.fail[to]]
                queue.append(to)

    def _next(self, at: int, c: str) -> int:
        while at and c not in self.step[at]:
            at = self.fail[at]
        return self.step[at].get(c, 0)

    def found(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """For each key that the text has, where: whole words, or for ``stem*`` keys to the end of the word."""
        at, out = 0, {}
        for i, c in enumerate(text):
            at = self._next(at, c)
            for number in self.ends[at]:
                key = self.keys[number]
                open_ = key.endswith("*")
                lo, hi = i + 1 - len(key) + open_, i + 1
                if lo and self.letter(text[lo - 1]):
                    continue
                if open_:
                    while hi < len(text) and self.letter(text[hi]):
                        hi += 1
                elif hi < len(text) and self.letter(text[hi]):
                    continue
                places = out.setdefault(number, [])
                if not places or places[-1][1] <= lo:  # of places that overlap, the first
                    places.append((lo, hi))
        return out


def replaced(text: str, places: list[tuple[int, int]], by: str) -> str:
    out, last = [], 0
    for lo, hi in places:
        out += [text[last:lo], by]
        last = hi
    return "".join([*out, text[last:]])


def substituted(queries: DataFrame, dictionary: list, letters: str = "") -> DataFrame:
    """(query_id, key, n, text): ``queries`` (query_id, q) with each key that they have replaced by each of its synonyms.

    ``dictionary``: rows (key, n, synonym), a bounded list; the automaton is built once for each task.
    """
    kind = dict(queries.dtypes)["query_id"]
    keys = sorted({r["key"] for r in dictionary})
    of: dict[str, list] = {}
    for r in dictionary:
        of.setdefault(r["key"], []).append((r["n"], r["synonym"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(keys, letters)
        for b in batches:
            row, key, n, text = [], [], [], []
            for i, q in enumerate(b.column(1).to_pylist()):
                for number, places in automaton.found(q or "").items():
                    for k, synonym in of[keys[number]]:
                        row.append(i)
                        key.append(keys[number])
                        n.append(k)
                        text.append(replaced(q, places, synonym))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(key, pa.string()), pa.array(n, pa.int32()), pa.array(text, pa.string())], ["query_id", "key", "n", "text"])

    return queries.select("query_id", F.col("q")).mapInArrow(run, f"query_id {kind}, key string, n int, text string")
