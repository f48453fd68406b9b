import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, key string, fingerprint int, copies string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", ",", ".\n", "é", "ß"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, odd characters; columns with clashing names."""
    long = prose(99, 30_000)
    texts = {
        1: prose(1, 80), 2: prose(1, 80), 3: None, 4: "", 5: "   \n\t ", 6: "one", 7: "one two", 8: "one two three four", 9: long,
        10: prose(2, 300), 11: prose(2, 300) + " tail", 12: "日本語 のテキスト 漢字", 13: "😀 émigré naïve x", 14: "#$% &&& *** |||",
        15: "a  b\r\n c\n\n\td ", 16: "x" * 3000, 17: "it's we'll I'M don't 's", 18: "12345 67 8٣٤", 19: prose(3, 120), 20: prose(3, 120).upper(),
    }
    rows = [(k, t, ("en", "de", None)[k % 3], (None, "a", "b", "c")[k % 4], "key", k, "c") for k, t in texts.items()]
    return rows + [rows[0], (None, prose(5, 60), "en", "a", None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
