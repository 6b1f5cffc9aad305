"""Keyed merges, JSON metadata, tagging over stored tables, continuous ingestion and stores with state."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import codes, meta
from tessera.plans import ingest, tag
from tessera.sources import keyed
from tessera.streaming import activity, stores


def test_replay_changes_nothing(spark, tmp_path):
    t = keyed.topics(spark, str(tmp_path / "topics"))
    assert t.read() is None
    make = lambda rows: spark.createDataFrame(rows, "topic string, total_weight double, n long, last_at long")
    first = make([(f"t{i}", 1.0, 1, i) for i in range(200)] + [(None, 5.0, 1, 0)])
    written = t.merge(first, 1)
    assert 40 < written <= 64
    rows = lambda: sorted(t.read().collect(), key=str)
    second = make([("t3", 2.0, 2, 1), ("new", 1.0, 1, 9), (None, 1.0, 1, 4)])
    assert t.merge(second, 2) <= 3
    after = rows()
    assert t.merge(second, 2) <= 3 and t.merge(first, 1) == written and rows() == after
    got = {r.topic: (r.total_weight, r.n, r.last_at) for r in after}
    assert got["t3"] == (3.0, 3, 3) and got["new"] == (1.0, 1, 9) and got[None] == (6.0, 2, 4) and len(after) == 202
    assert t.merge(second.limit(0), 3) == 0


def test_only_touched_partitions_are_written(spark, tmp_path):
    s = keyed.sessions(spark, str(tmp_path / "s"))
    cols = "session_id string, started_at long, ended_at long, message_count long, confidence_sum double, n_confidence long"
    s.merge(spark.createDataFrame([(f"s{i}", i, i, 1, 0.5, 1) for i in range(300)], cols), 0)
    stamp = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "s").glob("bucket=*/*.parquet")}
    before = stamp()
    assert s.merge(spark.createDataFrame([("s7", 1, 99, 2, 1.0, 1)], cols), 1) == 1
    changed = {f.parent.name for f in before.keys() ^ stamp().keys()}
    assert len(changed) == 1
    assert [tuple(r) for r in s.read().where("session_id = 's7'").collect()] == [("s7", 1, 99, 3, 1.5, 2)]


def test_metadata(spark):
    rng = random.Random(1)
    value = lambda: rng.choice([1, 2.5, "s\"é\n", True, None, [1, {"x": 2}], {"in": {"deep": 3}}])
    rows = [(json.dumps({k: value() for k in rng.sample("abcd\"", 3)}), json.dumps({k: value() for k in rng.sample("abcd\"", 2)})) for _ in range(60)]
    rows += [(None, '{"a": 1}'), ("no json", '{"a": 1}'), ("[1, 2]", None), ("{}", "{}")]
    got = [json.loads(r.m) for r in spark.createDataFrame(rows, "o string, n string").select(meta.merged(F.col("o"), F.col("n")).alias("m")).collect()]

    def obj(x):
        try:
            x = json.loads(x or "{}")
        except ValueError:
            return {}
        return x if isinstance(x, dict) else {}

    assert got == [{**obj(a), **obj(b)} for a, b in rows]
    probed = spark.createDataFrame([('{"a": {"b": 7}}',), ('{"a": 1}',), (None,)], "m string").select(meta.probe(F.col("m"), "$.a.b", "int").alias("x")).collect()
    assert [r.x for r in probed] == [7, None, None]


def test_tagging_over_stored_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Раздел", "Болт ГОСТ 7798-70"), (2, None, "ОКПД2: 24.10.311 сталь"), (3, "", "ничего"), (4, "", None)], "doc_id long, section string, text string")
    guesses = spark.createDataFrame([(3, "25.94.11.110", 0.7, "x"), (4, "25.94.11.110", 0.95, "x"), (2, "01.02.03", 0.99, "x")], "doc_id long, code string, conf double, desc string")
    info = spark.createDataFrame([(3, ("сталь", 12))], "doc_id long, material struct<grade: string, size: int>")
    t = tag.Tags(spark, str(tmp_path / "tags"))
    assert t.guess_report(docs).count() == 0
    t.tag(docs, 1, guesses, info)
    known = sorted((r.doc_id, r.ns, r.code) for r in t.bridge.read().collect())
    t.tag(docs, 1, guesses, info)
    assert sorted((r.doc_id, r.ns, r.code) for r in t.bridge.read().collect()) == known
    assert (4, "okpd", "25.94.11.110") in known and any(d == 1 and ns == "gost" for d, ns, _ in known) and (2, "okpd", "24.10.31") in known
    assert json.loads(t.meta.read().where("doc_id = 3").first().meta) == {"okpd_guess": {"code": "25.94.11.110", "conf": 0.7}, "material_info": {"grade": "сталь", "size": 12}}
    assert [tuple(r) for r in t.guess_report(docs).collect()] == [("25.94.11.110", 1, 0.7)]
    assert sorted(r.doc_id for r in t.untagged(docs).collect()) == [1, 3]
    t.tag(docs.where("doc_id = 3").withColumn("text", F.lit("лист 24.10.31.000")), 2)
    t.retag(spark.createDataFrame([(2, "24.10.32", 0.97)], "doc_id long, code string, conf double"))
    assert [tuple(r) for r in t.untagged(docs).select("doc_id").collect()] == [(1,)]


def test_inline_codes_end_as_the_rule_says(spark):
    got = spark.createDataFrame([("ОКПД2: 24.10.311",), ("окпд 01.2.3",), ("ОКПД2 25.94.11.110",)], "t string").select(codes.code_of(F.col("t")).alias("c")).collect()
    assert [r.c for r in got] == ["24.10.31", "01.02.3", "25.94.11.110"]


def chunks(df):
    return sorted((r.book, r.is_parent, r.doc_hash, r.text) for r in df.collect())


def test_restarted_ingestion_gives_one_runs_table(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    (folder / "a").mkdir(parents=True)
    (folder / "b").mkdir()
    rng = random.Random(2)
    for i in range(6):
        (folder / ("a" if i % 2 else "b") / f"same{i // 2}.txt").write_text(f"Text of file {i}. " + " ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(200)))
    whole = ingest.ingest(spark, str(folder), str(tmp_path / "whole"))
    assert len({r.book for r in whole.collect()}) == 6  # files of one name in two folders are two documents
    run = lambda: ingest.continuous(spark, str(folder), str(tmp_path / "table"), str(tmp_path / "check"), files_at_once=2)
    real, calls = ingest.embedded, []

    def dies(rows, *a, **kw):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return real(rows, *a, **kw)

    monkeypatch.setattr(ingest, "embedded", dies)
    with pytest.raises(Exception, match="killed"):
        run().awaitTermination()
    run().awaitTermination()
    table = spark.read.parquet(str(tmp_path / "table"))
    assert table.select("batch").distinct().count() == 3 and chunks(table) == chunks(whole)
    run().awaitTermination()  # nothing new
    assert chunks(spark.read.parquet(str(tmp_path / "table"))) == chunks(whole)


@pytest.fixture
def rocksdb(spark):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stores.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def streamed(spark, tmp_path, name, batches, schema):
    """A file stream that reads ``batches`` one by one."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


def test_sessions_end_after_their_time(spark, tmp_path, rocksdb):
    rng = random.Random(4)
    rows = [(f"s{rng.randrange(6)}", 1_700_000_000 + t) for t in range(0, 40_000, 400)]
    rows += [("end", 1_700_000_000 + 90_000)]
    schema = "session_id string, sec long"
    stream = streamed(spark, tmp_path, "events", [rows[:50], rows[50:100], rows[100:]], schema).withColumn("ts", F.timestamp_seconds("sec"))
    got = sorted((r.session_id, int(r.started_at.timestamp()), int(r.last_used.timestamp()), r.n) for r in activity.run_to_memory(stores.ended_sessions(stream, 3600), "ended").collect())
    want = []
    for s in {r[0] for r in rows} - {"end"}:
        at = sorted(t for x, t in rows if x == s)
        group = [at[0]]
        for t in at[1:]:
            if t - group[-1] > 3600:
                want.append((s, group[0], group[-1], len(group)))
                group = []
            group.append(t)
        want.append((s, group[0], group[-1], len(group)))
    assert got == sorted(want)


def test_answer_cache(spark, tmp_path, rocksdb):
    rng = random.Random(6)
    rows, t = [], 1_700_000_000
    for i in range(240):
        t += rng.randrange(1, 30)
        rows.append((rng.choice("uv"), i, t, f"q{rng.randrange(8)}", f"a{i}" if rng.random() < 0.4 else None))
    schema = "user_id string, event_id long, sec long, question string, answer string"
    stream = streamed(spark, tmp_path, "asked", [rows[i : i + 60] for i in range(0, 240, 60)], schema).withColumn("ts", F.timestamp_seconds("sec"))
    got = {r.event_id: (r.hit, r.answer) for r in activity.run_to_memory(stores.cached_answers(stream, 300, 4), "cached").collect()}
    cache, want = {"u": {}, "v": {}}, {}
    for user, i, t, q, a in rows:
        mine = cache[user]
        for k in [k for k, v in mine.items() if t - v[1] >= 300]:
            del mine[k]
        if a is None:
            want[i] = (q in mine, mine[q][0] if q in mine else None)
            if q in mine:
                mine[q][2] = t
        else:
            mine[q] = [a, t, t]
            if len(mine) > 4:
                del mine[min(mine, key=lambda k: (mine[k][2], k))]
    assert got == want and {h for h, _ in want.values()} == {True, False}


def test_feedback_joins_the_log_as_it_comes(spark, tmp_path):
    log = [(f"p{i}", 1_700_000_000 + 60 * i) for i in range(40)]
    said = [(f"p{i}", 1_700_000_000 + 60 * i + 100 * k, k, f"c{k}") for i in range(0, 40, 2) for k in (1, 2, 3)]
    later = 1_700_000_000 + 50_000
    a = streamed(spark, tmp_path, "log", [log[:20], log[20:], [("last", later)]], "public_id string, sec long").withColumn("ts", F.timestamp_seconds("sec"))
    b = streamed(spark, tmp_path, "said", [said[:30], said[30:], [("none", later, 1, "x")]], "ref string, sec long, rating int, comment string").withColumn("ts", F.timestamp_seconds("sec"))
    for _ in range(2):
        stores.keep_newest(stores.joined_feedback(a, b), str(tmp_path / "newest"), str(tmp_path / "check")).awaitTermination()
    got = {r.public_id: r.newest and (r.newest.rating, r.newest.comment) for r in stores.newest_feedback(spark, str(tmp_path / "newest")).read().collect()}
    want = {p: (3, "c3") if int(p[1:]) % 2 == 0 else None for p, _ in log}
    assert {k: v for k, v in got.items() if k != "last"} == want
