import pytest

from tidemark.operators.scoring import score_texts


def test_all_of_a_long_text_counts(spark):
    texts = ["u" * 512 + "d" * 512, "u" * 512 + "d" * 256, "", "u" * 512, "d"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)

    def load():
        def model(some):
            assert len(some) <= 2 and all(len(t) <= 512 for t in some)
            return [(t.count("u") - t.count("d")) / max(len(t), 1) for t in some]

        return model

    got = [r.score for r in score_texts(df, "t", load, batch=2).orderBy("i").collect()]
    assert got == pytest.approx([0.0, (512 * 1.0 + 256 * 0.0) / 768, 0.0, 1.0, -1.0])
