import pytest

WORDS = ("alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu")


def prose(seed: int, words: int = 120) -> str:
    """Sentences of pseudo-random words; equal for equal seeds."""
    out, state = [], seed * 2654435761 % 2**32 + 1
    for i in range(words):
        state = state * 1103515245 % 2**31 + 12345
        out.append(WORDS[state // 65536 % len(WORDS)] + str(state // 7 % 997))
        if i % 9 == 8:
            out[-1] += "."
    return " ".join(out)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, `_key` string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with columns whose names operators use inside."""

    def make(texts: dict | list):
        pairs = list(texts.items()) if isinstance(texts, dict) else texts
        rows = [(i, t, "en", "s", None if t is None else len(t), "x", "y") for i, t in pairs]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd():
    """Null, empty, blank, very long, repeated and near-equal texts."""
    long_ = prose(5, 4000)
    near = prose(1, 200).split()
    near[100] = "changed"
    return {
        0: None, 1: "", 2: " \n\t ", 3: "one", 4: long_, 5: long_, 6: prose(1, 200), 7: " ".join(near),
        8: prose(1, 200), 9: prose(2), 10: "\U0001f600 café 日本語", 11: "a" * 30000,
    }
