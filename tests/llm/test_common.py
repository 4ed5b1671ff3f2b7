import pandas as pd

from tidemark.llm.common import BATCHES, give_back, materialise


def test_batches_of_a_written_table_are_bounded(spark):
    before = {key: spark.conf.get(key, None) for key in BATCHES}

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [len(batch)], "size": [int(batch["x"].str.len().sum())]})
        give_back()

    def written(rows, width):
        return materialise(spark.range(0, rows, 1, 1).selectExpr(f"repeat('x', {width}) AS x").mapInPandas(sizes, "n long, size long"), "sizes").collect()

    short, long = written(5000, 10), written(500, 100_000)
    assert sum(r["n"] for r in short) == 5000 and max(r["n"] for r in short) <= 1000
    assert sum(r["n"] for r in long) == 500 and max(r["size"] for r in long) <= 8 << 20
    assert {key: spark.conf.get(key, None) for key in BATCHES} == before
