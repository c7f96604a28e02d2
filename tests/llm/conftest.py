import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every kind of oddity and columns whose names clash with those of results."""
    long = "wort " * 60_000
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa", "en"),
        (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa", "en"),
        (3, None, None),
        (4, "", "en"),
        (5, " \n\t ", None),
        (6, long, "de"),
        (7, "日本語のテキスト 👍🏽 <|endoftext|> it's '' 's", "ja"),
        (8, "kurz", "de"),
        (8, "kurz", "de"),
        (None, "no id at all but some words in here", "en"),
        (9, "12345 !!! ???", None),
        (10, "x" * 3000, None),
    ]
    return spark.createDataFrame([(a, b, c, "s", 0, 1.0, [1], "l") for a, b, c in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, ids array<int>, labels string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
