"""Readers, sinks, search and answers end to end, context, analytics compat modes, and streams against batches."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import analytics, answers, context, labels, retrieval
from tessera.plans import ingest, search
from tessera.sources import files, tables
from tessera.streaming import activity

SF = "/root/testdata/sf0.001"


def xlsx() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="S1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>name</t></si><si><t>a|b</t></si></sst>')
        z.writestr("xl/styles.xml", '<styleSheet xmlns="m"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="m"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>when</t></is></c><c r="C1"><v>2.50</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" s="1"><v>45000</v></c><c r="C2" t="b"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A2:A3"/></mergeCells></worksheet>')
    return out.getvalue()


def docx() -> bytes:
    w = 'xmlns:w="w"'
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="1"/></w:numPr></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>h</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


@pytest.fixture()
def folder(tmp_path):
    sub = tmp_path / "in" / "deep"
    sub.mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("Заголовок\n\nТекст про склады. " * 5, encoding="cp1251")
    (tmp_path / "in" / "empty.txt").write_bytes(b"")
    (tmp_path / "in" / "b.md").write_text("# Head\n" + "body of the section with words enough to stay. " * 20, encoding="utf-8")
    (sub / "c.csv").write_text("name;qty\nbolt;1\nnut|x;22\n")
    (sub / "d.xlsx").write_bytes(xlsx())
    (sub / "e.docx").write_bytes(docx())
    (sub / "broken.xlsx").write_bytes(b"PK\x03\x04 no")
    (sub / "skip.exe").write_bytes(b"MZ")
    return str(tmp_path / "in")


def test_readers(spark, folder):
    found = files.scan(spark, folder)
    assert sorted(r["ext"] for r in found.select("ext").collect()) == ["csv", "docx", "md", "txt", "xlsx", "xlsx"]
    assert files.scan(spark, folder, recursive=False).count() == 2
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.texts(found).collect()}
    assert "Заголовок" in got["a.txt"]["text"]
    assert got["c.csv"]["text"] == "| name | qty |\n|---|---|\n| bolt | 1 |\n| nut\\|x | 22 |"
    assert got["d.xlsx"]["part"] == "S1" and got["d.xlsx"]["text"].split("\n") == ["| name | when | 2.5 |", "|---|---|---|", "| a\\|b | 2023-03-15 | TRUE |", "| a\\|b |  |  |"]
    assert got["e.docx"]["text"] == "# Title\n\n**bold**\n\n  - item\n\n| h |\n|---|\n| 1 |"
    assert got["broken.xlsx"]["text"] is None and got["broken.xlsx"]["error"]
    enc = {r["path"].rsplit("/", 1)[1]: r["e"] for r in found.withColumn("e", files.encoding(F.col("content"))).collect()}
    assert enc["a.txt"] == "cp1251" and enc["b.md"] == "utf-8"
    checks = {r["path"].rsplit("/", 1)[1]: r["ok"] for r in files.upload_checks(found).collect()}
    assert all(checks.values())


@pytest.mark.parametrize("text,sep", [("a,b\n1,2\n", ","), ("a;b\n1,5;2\n", ";"), ("a\tb\n1\t2\n", "\t"), ("a|b\n1|2\n", "|"), ("", ",")])
def test_delimiters(text, sep):
    assert files.delimiter(text) == sep


def test_csv_blocks():
    assert files.csv_blocks("") == []
    assert files.csv_blocks("1,2\n3,4\n")[0].startswith("| col1 | col2 |")
    assert len(files.csv_blocks("a,b\n" + "1,2\n" * 2500)) == 3
    assert files.csv_blocks(",".join(map(str, range(100))) + "\n")[0].split("\n")[0].count("|") == 61


def test_numbers_and_pages(spark):
    df = spark.createDataFrame([(2.0,), (2.5,), (0.1 + 0.2,), (1e-12,)], "v double")
    assert [r[0] for r in df.select(files.fmt_number(F.col("v"))).collect()] == ["2", "2.5", "0.3", "0"] == [files.number_text(r["v"]) for r in df.collect()]
    title, text = files.html_text("<html><head><title>T &amp; x</title><script>no()</script></head><body><h2>Head</h2><p>one<br>two</p></body></html>")
    assert title == "T & x" and text.split() == ["##", "Head", "one", "two"]


def test_resolve(spark):
    df = spark.createDataFrame([("b", "/x/y/b.txt", "txt"), ("b", "/x/b.docx", "docx"), ("b", "/x/z/b.pdf", "pdf"), ("c", "/c.md", "md")], "book string, path string, ext string")
    assert {r["book"]: r["ext"] for r in files.resolved(df).collect()} == {"b": "pdf", "c": "md"}


def test_ingest_is_idempotent(spark, folder, tmp_path):
    table = str(tmp_path / "chunks")
    first = ingest.ingest(spark, folder, table, dim=32)
    n = first.count()
    assert n >= 2 and first.where("size(emb) = 32").count() == n
    assert ingest.ingest(spark, folder, table, dim=32).count() == n
    assert tables.by_id(first, first.first()["id"]).count() == 1


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = [(k, "press", f"Раздел {k}", 1, "Настройка печати накладной выполняется в разделе отчётов. Нажмите кнопку печати.", "p1", k) for k in (1, 2)]
    rows += [(3, "press", "Ошибка печати", 1, "Ошибка печати накладной возникает без принтера. Проверьте кабель.", "p2", 0), (4, "metal", "Лист стальной", 1, "Лист стальной горячекатаный по стандарту. Толщина листа три миллиметра.", "m", 0)]
    c = spark.createDataFrame(rows, "id long, book string, section string, page int, text string, parent_group string, child_index int")
    c = c.withColumn("importance_score", F.lit(1.0)).withColumn("is_parent", F.lit(False)).withColumn("parent_title", F.col("section"))
    path = str(tmp_path_factory.mktemp("corpus") / "chunks")
    c.withColumn("emb", search.embedder()(F.concat(F.lit("passage: "), "text"))).write.parquet(path)
    return spark.read.parquet(path)


def test_search(spark, corpus):
    q = spark.createDataFrame([(1, "настройка печати накладной"), (2, "стальной лист толщина"), (3, "")], "query_id int, text string")
    hits = search.search(q, corpus, search.embedder(), top_k=3, expand=False).orderBy("query_id", "rnk").collect()
    best = {r["query_id"]: r for r in hits if r["rnk"] == 1}
    assert best[1]["id"] in (1, 2) and best[2]["id"] == 4 and 3 not in best
    assert all(0 <= r["score"] for r in hits)
    got = {r["query_id"]: r for r in search.answer(q, corpus, embed=search.embedder(), top_k=3, expand=False).collect()}
    assert "Настройка" in got[1]["answer"] and got[1]["confidence"] > 0 and got[1]["citations"] and got[3]["answer"] is None and got[3]["fallback"]


def test_label_filter_comes_before_the_cut(spark, corpus):
    q = spark.createDataFrame([(1, "печати накладной")], "query_id int, text string")
    only = corpus.where("section LIKE '%Ошибка%'").select(F.col("id").alias("doc_id"), F.lit("okpd").alias("ns"), F.lit("24.10").alias("code"), F.array(F.lit("24"), F.lit("24.10")).alias("path"))
    hits = search.search(q, corpus, top_k=3, label_filters=[{"ns": "okpd", "prefix": "24"}], bridge=only).collect()
    assert hits and all("Ошибка" in r["section"] for r in hits)


def test_websearch(spark):
    d = spark.createDataFrame([(1, "red apple pie"), (2, "green apple"), (3, "apple red sauce")], "doc_id int, text string")
    q = spark.createDataFrame([(1, 'apple "red apple"'), (2, "green or sauce"), (3, "apple -green"), (4, "apple missing")], "query_id int, text string")
    got = sorted((r["query_id"], r["doc_id"]) for r in retrieval.websearch(q, d).collect())
    assert got == [(1, 1), (2, 2), (2, 3), (3, 1), (3, 3)]


def test_rrf_and_gates(spark):
    rows = [(1, "vec", 10, 0.9, 1), (1, "fts", 10, 5.0, 3), (1, "trgm", 11, 0.9, 1), (1, "trgm", 12, 0.2, 2)]
    lists = spark.createDataFrame(rows, "query_id int, signal string, doc_id int, score double, rnk int")
    fused = {r["doc_id"]: r["fused"] for r in retrieval.rrf(lists).collect()}
    assert fused[10] == pytest.approx(0.013752277, abs=1e-9) and fused[11] == pytest.approx(0.002459016, abs=1e-9)
    q = spark.createDataFrame([(1, "печать накладной сегодня")], "query_id int, text string")
    ov = spark.createDataFrame([(1, 11, 0.9), (1, 12, 0.9)], "query_id int, doc_id int, overlap double")
    assert {r["doc_id"] for r in retrieval.gated(lists, q, ov).collect()} == {10, 11}


def test_mmr_against_a_loop(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(20, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q, groups = v[0] * 0.9 + v[1] * 0.2, [f"g{i % 4}" for i in range(20)]
    q /= np.linalg.norm(q)
    sims, picked = v @ v.T, [int(np.argmax(v @ q))]
    while len(picked) < 6:
        best = max((i for i in range(20) if i not in picked), key=lambda i: 0.7 * (v[i] @ q) - 0.3 * max(sims[i][j] for j in picked) - 0.2 * any(groups[i] == groups[j] for j in picked))
        picked.append(best)
    pool = spark.createDataFrame([(1, i, i + 1, v[i].tolist(), q.tolist(), groups[i]) for i in range(20)], "query_id int, doc_id int, pos int, vec array<double>, query_vec array<double>, group string")
    assert [r["doc_id"] for r in retrieval.mmr(pool, 6).orderBy("mmr_rank").collect()] == picked


def test_boost_expansion_typos(spark):
    s = spark.createDataFrame([(1, 5, 1.0)], "query_id int, doc_id int, score double")
    lab = spark.createDataFrame([(5, "okpd", "24.10", ["24", "24.10"]), (5, "gost", "1", None)], "doc_id int, ns string, code string, path array<string>")
    want = spark.createDataFrame([(1, "okpd", "24"), (1, "gost", "1")], "query_id int, ns string, code string")
    assert retrieval.label_boost(s, lab, want).first()["score"] == pytest.approx(1.1025)
    q = spark.createDataFrame([(1, "Как настроить печать"), (2, "болт")], "query_id int, text string")
    syn = spark.createDataFrame([("печат*", "вывод"), ("болт", "винт")], "key string, synonym string")
    got = sorted((r["query_id"], r["variant"], r["text"]) for r in retrieval.expanded(q, syn).collect())
    assert got == [(1, 1, "как настроить печать"), (1, 2, "как настроить вывод"), (1, 3, "каким образом настроить печать"), (2, 1, "болт"), (2, 2, "винт")]
    typed = spark.createDataFrame([(1, "моркировки склад")], "query_id int, text string")
    vocab = spark.createDataFrame([("маркировки",), ("складской",)], "word string")
    assert retrieval.typos_fixed(typed, vocab).first()["text"] == "маркировки склад"
    f = retrieval.inline_filters(spark.createDataFrame([(1, "лист okpd2:24.10 гост: 7798")], "query_id int, text string")).collect()
    assert sorted((r["ns"], r["code"], r["prefix"]) for r in f) == [("gost", "7798", None), ("okpd", None, "24.10")]


def test_confidence_and_citations(spark):
    h = spark.createDataFrame([(1, 1, 0.8), (1, 2, 0.6)], "query_id int, rnk int, score double")
    a = spark.createDataFrame([(1, "x" * 500, 0.5)], "query_id int, answer string, grounding double")
    assert answers.confidence(h, a).first()["confidence"] == pytest.approx(0.556)
    c = spark.createDataFrame([(1, 1, "b", "s", 1, 0.9, True), (1, 2, "b", "s", 1, 0.5, False), (1, 3, "b", "t", 1, 0.4, False)], "query_id int, rnk int, book string, section string, page int, score double, is_parent boolean")
    got = answers.citations(c).orderBy("pos").collect()
    assert [(r["section"], r["is_parent"]) for r in got] == [("s", False), ("t", False)]


def test_grounding(spark):
    h = spark.createDataFrame([(1, 1, "Настройка печати накладной выполняется в разделе.")], "query_id int, rnk int, text string")
    a = spark.createDataFrame([(1, "Настройка печати выполняется в разделе отчётов. Совершенно другое предложение про погоду."), (2, None)], "query_id int, answer string")
    got = {r["query_id"]: r["grounding"] for r in answers.grounding(a, h).collect()}
    assert got == {1: 0.5, 2: 0.0}


def test_context_assembly(spark):
    long = "слово " * 12 + "общий хвост который длиннее пятидесяти знаков и повторяется дословно"
    rows = [(1, 1, "b", "s", 1, long, 0.9, False), (1, 2, "b", "s", 2, long[-68:] + " дальше", 0.5, False), (1, 3, "b", "s", 9, "далеко", 0.1, False), (1, 4, "c", "p", 1, "родитель", 0.2, True)]
    h = spark.createDataFrame(rows, "query_id int, id int, book string, section string, page int, text string, score double, is_parent boolean")
    out = answers.context(h).first()["context"]
    assert out.count("повторяется дословно") == 1 and "далеко" in out and "родитель" in out and out.index("### b - s") < out.index("### c - p")


def test_widened(spark):
    rows = [(i, "g", i, f"Предложение {i} начинается. Часть {i} продолжается", False, "Родитель", "s") for i in range(4)] + [(9, "g", None, "текст родителя", True, "Родитель", "s")]
    c = spark.createDataFrame(rows, "id int, parent_group string, child_index int, text string, is_parent boolean, parent_title string, section string")
    h = spark.createDataFrame([(1, 1, 1), (1, 2, 9)], "query_id int, rnk int, id int")
    got = {r["id"]: r["text"] for r in context.widened(h, c).collect()}
    assert got[1].startswith("«Родитель» — краткий контекст:\nтекст родителя") and "Часть 0 продолжается" in got[1] and got[1].endswith("...")
    assert got[9].startswith("текст родителя")


def test_session_folds(spark):
    log = spark.createDataFrame([("s", 1, 0.9, 0.9), ("s", 2, 0.5, 0.5), ("s", 3, 0.7, 0.7)], "session_id string, seq int, confidence double, grounding double").withColumn("ts", F.timestamp_seconds("seq"))
    a, b = analytics.sessions(log).first(), analytics.sessions(log, compat=True).first()
    assert (a["message_count"], a["avg_confidence"]) == (3, 0.7) and (b["message_count"], b["avg_confidence"]) == (2, 0.6)
    assert log.agg(analytics.running_mean(F.array_sort(F.collect_list("confidence"))).alias("m")).first()["m"] == pytest.approx(0.7)


def test_phrases(spark):
    rows = spark.createDataFrame([("настройка печати накладной",)], "text string")
    got = [(r["phrase"], r["weight"]) for r in analytics.phrases(rows).collect()]
    assert len(got) == 6 and sum(w for _, w in got) == 5.0 and ("настройка печати накладной", 1.5) in got


def test_topic_shift_cooldown(spark):
    rows = [(1, 0, "первый вопрос склад", "a", 0), (1, 1, "совсем иная тема", "b", 10), (1, 2, "третье нечто новое", "c", 30), (1, 3, "четвёртая далёкая мысль", "d", 100)]
    t = spark.createDataFrame(rows, "conv_id int, turn int, text string, book string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert [r["shift"] for r in answers.topic_shifts(t).orderBy("turn").collect()] == [False, True, False, True]


def test_eviction_and_retag(spark):
    now = F.lit("2024-01-01 02:00:00")
    s = spark.createDataFrame([("a", "2024-01-01 01:30:00"), ("b", "2024-01-01 00:10:00"), ("c", "2024-01-01 01:59:00")], "session_id string, last_used string")
    assert {r["session_id"] for r in analytics.evicted(s, now, most=1).collect()} == {"a", "b"}
    b = spark.createDataFrame([(1, "okpd", "10", 0.86), (2, "okpd", "10", 0.95), (3, "gost", "x", 0.86)], "doc_id int, ns string, code string, conf double")
    g = spark.createDataFrame([(1, "20", 0.92), (2, "20", 0.99), (3, "20", 0.99)], "doc_id int, code string, conf double")
    assert sorted(tuple(r) for r in labels.retagged(b, g).collect()) == [(1, "okpd", "20", 0.92), (2, "okpd", "10", 0.95), (3, "gost", "x", 0.86)]


def test_streams_equal_batches(spark):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    stream = activity.read_events(spark, SF, batch.schema)
    counts = activity.run_to_memory(activity.counts(stream), "counts", "complete")
    want = batch.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").agg(F.count("*").alias("n"))
    assert counts.agg(F.sum("n")).first()[0] == batch.count() and counts.count() == want.count()
    s = activity.run_to_memory(activity.sessions(stream), "sessions", "append")
    all_sessions = {tuple(r) for r in analytics.sessionized(batch).select("user_id", "n_events", F.unix_micros(F.col("started_at").cast("timestamp"))).collect()}
    got = {tuple(r) for r in s.select("user_id", "n_events", F.unix_micros("started_at")).collect()}
    assert got and got <= all_sessions and len(got) >= 0.9 * len(all_sessions)
    once = activity.run_to_memory(activity.once(stream.withColumn("ts", F.col("ts").cast("timestamp"))), "once")
    assert once.count() == batch.count()


def test_rate_limit(spark):
    stream = activity.read_events(spark, SF, spark.read.parquet(f"{SF}/events.parquet").schema)
    out = activity.run_to_memory(activity.limited(stream.withColumn("user_id", F.col("user_id") % 2), rate=0.001, burst=3), "limited").collect()
    tokens, at, want = {}, {}, {}
    for r in sorted(spark.read.parquet(f"{SF}/events.parquet").select("event_id", (F.col("user_id") % 2).alias("u"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")).collect(), key=lambda r: (r["t"], r["event_id"])):
        u = r["u"]
        tokens[u] = min(3.0, tokens.get(u, 3.0) + (max(0.0, r["t"] - at[u]) * 0.001 if u in at else 0.0))
        at[u] = r["t"]
        want[r["event_id"]] = tokens[u] >= 1
        tokens[u] -= want[r["event_id"]]
    assert {r["event_id"]: r["allowed"] for r in out} == want and set(want.values()) == {True, False}


def test_history_of_wanted_users(spark):
    log = spark.createDataFrame([(1, 7, 10, False), (2, 7, 30, True), (3, 7, 20, None), (4, 8, 5, False), (5, None, 50, False), (6, 9, 60, False)], "id long, user_id long, ts long, is_hide boolean")
    who = spark.createDataFrame([("d", "a"), ("d", "a"), (None, None), ("no", "body")], "domain string, computer_name string")
    known = spark.createDataFrame([(7, "d", "a"), (8, "d", "b"), (9, None, None)], "id long, domain string, computer_name string")
    known = known.select("id", analytics.user_hash(F.col("domain"), F.col("computer_name")).alias("user_hash"))
    found = lambda **kw: sorted((r["user_id"], r["pos"], r["id"]) for r in analytics.user_history(log, known, who, **kw).collect())
    assert found() == [(7, 1, 3), (7, 2, 1), (9, 1, 6)]
    assert found(include_hidden=True, n=2) == [(7, 1, 2), (7, 2, 3), (9, 1, 6)]
    assert found(n=1) == [(7, 1, 3), (9, 1, 6)]


def test_snapshot_adds_what_is_not_stored(spark):
    log = spark.createDataFrame([(1, "old", 10, 2.0, None), (2, "new", 20, 4.0, None), (3, None, 30, 9.0, None)], "id long, question string, ts long, processing_time double, rating int")
    topics = spark.createDataFrame([("a", 3.0, 1), ("b", 2.0, 1), ("c", 1.0, 1)], "topic string, total_weight double, last_used long")
    held = spark.createDataFrame([("b", 2.0), ("z", 3.5)], "topic string, weight double")
    r = analytics.snapshot(log, topics, held, n_topics=3, n_recent=2).first()
    assert [tuple(t) for t in r["popular_topics"]] == [("b", 4.0), ("z", 3.5), ("a", 3.0)]
    assert (r["n"], r["avg_time"], r["median_time"], r["avg_rating"], r["n_rated"]) == (3, 5.0, 4.0, 0.0, 0)
    assert list(r["recent_queries"]) == [None, "new"]
    e = analytics.snapshot(log.limit(0), topics.limit(0)).first()
    assert (e["n"], e["avg_time"], list(e["popular_topics"]), list(e["recent_queries"])) == (0, 0.0, [], [])


def test_websearch_takes_rows_of_one_id_as_one_document(spark):
    """Rows of an id were counted twice, and so left out; a phrase doesn't go from one row to the next."""
    d = spark.createDataFrame([(1, "red apple"), (1, "red pie"), (2, "red pie"), (2, "cold"), (None, "red pie"), (None, "pie")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "red"), (2, '"apple red"'), (3, "red -cold"), (4, "apple pie"), (5, "-red"), (6, None)], "query_id int, text string")
    got = {(r["query_id"], r["doc_id"]) for r in retrieval.websearch(q, d).collect()}
    assert got == {(1, 1), (1, 2), (1, None), (3, 1), (3, None), (4, 1)}
