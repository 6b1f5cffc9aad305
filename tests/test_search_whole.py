import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval
from tessera.plans import search


def test_trigram_list_sees_whole_chunks(spark, monkeypatch):
    """The passage lies beyond the first 420 characters."""
    c = spark.createDataFrame([(1, "Раздел", "слово " * 80 + "замена картриджа плоттера")], "id long, section string, text string")
    c = c.withColumns({"book": F.lit("b"), "page": F.lit(1), "importance_score": F.lit(1.0), "is_parent": F.lit(False), "parent_group": F.lit("p")})
    q = spark.createDataFrame([(1, "замена картриджа плоттера")], "query_id int, text string")
    lists, whole = [], retrieval.trigram

    class Seen(Exception):
        pass

    def trigram(*args):
        lists.append(whole(*args).collect())
        raise Seen

    monkeypatch.setattr(retrieval, "trigram", trigram)
    with pytest.raises(Seen):
        search.search(q, c, expand=False)
    want = whole(q, c.select(F.col("id").alias("doc_id"), F.concat_ws(" ", "section", "text").alias("text"))).first()["score"]
    assert [r["score"] for r in lists[0]] == [want] and want > 0.5


def test_words_end_where_the_named_letters_do(spark, monkeypatch):
    """A letter outside the named ones stands between two words, by the automaton and by the join."""
    q = spark.createDataFrame([(1, "erenßpfad und eren")], "query_id int, text string")
    syn = spark.createDataFrame([("eren", "und"), ("pfa*", "den")], "key string, synonym string")
    texts = lambda **kw: sorted(r.text for r in retrieval.expanded(q, syn, **kw).collect())
    for _ in range(2):
        assert texts(letters="a-z0-9_") == ["erenßden und eren", "erenßpfad und eren", "undßpfad und und"]
        assert texts() == ["erenßpfad und eren", "erenßpfad und und"]
        monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 1)
