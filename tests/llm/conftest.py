import random

import pytest

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, score double, h string, part int, raw string, first long, measures string, line_no int"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").cache()


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, white space of all kinds."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "The", "MIT", "License", "naïve", "日本", "a", "#x", "<|endoftext|>", "<|startoftext|>"]
    texts = [None, "", " ", "\n\n", "one", "One one", "x\ty\x0bz", "　wide space　", " lead and trail ", "a\n\nb", "double  blank", "tab\t tab", "é́e",
             "same words again and again " * 40, "short line\n" * 9]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(30)]
    texts += ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(8)) for _ in range(10)]
    texts.append(" ".join(rng.choice(words) for _ in range(20_000)))
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(5, "One one"), (100, texts[20]), (101, texts[20]), (None, "no id at all"), (None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with extra columns under names the operators use inside."""
    return spark.createDataFrame([(*r, 0.5, "h", 1, "r", 2, "m", 3) for r in odd_rows], ODD).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ODD)
