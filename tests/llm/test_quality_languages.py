"""Quality rules on languages without a reference."""

from __future__ import annotations

from quillspark.llm import quality

RUSSIAN = (
    "Вчера вечером мы долго гуляли по набережной, и ветер с реки приносил запах мокрых листьев. Старый рыбак сидел у воды и молча смотрел "
    "на поплавок. Никто из нас не хотел возвращаться домой, хотя уже темнело и становилось холодно. Потом сестра рассказала смешную историю "
    "про соседскую кошку, которая однажды забралась на крышу школы. Все громко смеялись, даже рыбак улыбнулся и предложил нам горячего чая."
)


def test_other_languages_are_judged_by_base_rules(spark):
    words = RUSSIAN.split()
    junk = " ".join(w + "%#&$"[i % 4] * 3 for i, w in enumerate(words))
    few = " ".join(words[:30])
    df = spark.createDataFrame([(1, RUSSIAN), (2, junk), (3, few), (4, RUSSIAN + " " + RUSSIAN)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert got[1].kept and got[1].divergence is None
    assert not got[2].kept and got[2].divergence > quality.LIMIT and not got[2].base_failed
    assert got[3].base_failed and got[4].base_failed and not got[3].kept and not got[4].kept
    assert [r.doc_id for r in quality.keep_good(df).collect()] == [1]


def test_sql_knows_other_languages(spark, tmp_path):
    """The registered SQL on texts of another language, junk and a text too short."""
    import duckdb

    words = RUSSIAN.split()
    texts = [RUSSIAN, " ".join(w + "%#&$"[i % 4] * 3 for i, w in enumerate(words)), " ".join(words[:30]), RUSSIAN + " " + RUSSIAN, "the end of a line and of the text " * 20, None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_words, base_failed, kept FROM ({quality.oracle()})").fetchall())
    got = sorted((r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality.op9(spark, str(tmp_path)).collect())
    assert got == want and [r[3] for r in want][:3] == [True, False, False]
