import pytest

WORDS = "the of and to in that is was for on with as by at from his her they be have not are".split()
EXTRA = "h STRING, at STRING, fp STRING, key STRING, n INT, size STRING, taken INT, target STRING, kept STRING, comp STRING, n_words STRING, spans STRING, start STRING, bucket STRING, lang_pred STRING, __kept STRING, __new STRING, __lang STRING, __first STRING, __found STRING, new_text STRING, kept_id STRING, text_hash STRING, row_rank STRING, found STRING, own STRING"


def sentence(k: int, n: int = 40) -> str:
    out, x = [], k * 2654435761 % 2**32 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x // 65536 % len(WORDS)] + (str(x % 97) if x % 3 == 0 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and extra columns with clashing names."""
    long = "\n".join(sentence(k, 50) for k in range(400))
    texts = {1: sentence(1), 2: sentence(1), 3: sentence(1).replace("the", "thf", 1), 4: None, 5: "", 6: " \n\t ", 7: long, 8: "Wörter größer ß\nÄhnlich é", 9: "x", 10: "\U0001f600 \x00 \r\n a"}
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else f"s{i % 3}", None if i == 3 else len(t or "")) for i, t in texts.items()]
    rows += [(None, sentence(2), "en", "s1", 1), (None, None, None, None, None), rows[0], rows[0]]
    extra = tuple(["x"] * 4 + [1, "x", 1] + ["x"] * 19)
    return spark.createDataFrame([r + extra for r in rows], f"doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, {EXTRA}")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
