"""The Jaccard join keeps no shuffle of all sets' shingles while postings and sets are sent."""

from pyspark.sql.classic.dataframe import DataFrame

from themeloom.llm.jaccard_join import near_duplicates


def test_frequent_shingles_are_read_from_a_written_table(spark, monkeypatch):
    plans, collect = [], DataFrame.toArrow

    def recorded(df):
        if df.columns == ["shingle", "n"]:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return collect(df)

    monkeypatch.setattr(DataFrame, "toArrow", recorded)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(reversed(words)), "", None, " ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs).collect()}
    assert found == {0: (56, 0), 1: (55, 0), 2: (56, 2), 3: (0, 3), 4: (0, 4), 5: (56, 0)}
    assert len(plans) == 1 and "Exchange" not in plans[0]
