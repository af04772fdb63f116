import random

import pytest

#: Names that operators use inside, as extra columns of the input.
CLASHES = ["id", "node", "n", "draw", "held", "digest", "rank", "size", "target", "slot", "version", "label", "score", "ids", "_copy", "_keep", "copies", "component", "form", "vector", "key"]


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()) + str(rng.randint(0, 40)) for _ in range(n))


def odd_texts():
    """Null, empty, white space, very long, no letters, ties, repeats, near copies, unusual characters."""
    rng = random.Random(3)
    base = words(rng, 60)
    near = base.split()
    near[30] = "changed"
    long = words(rng, 30000)
    return [
        None, "", " \n\t ", "one", "one two three four", "One TWO three four", "one two three four five", base, base, base.upper(), " ".join(near), base + " tail",
        long, long + " end", "x" * 50000, "12345 !!! ...", "é è ü ñ 日本語 \U0001f600 \x85\xa0 ß", "É È Ü Ñ", "password = 'abcdef123456' <|endoftext|>", words(rng, 200), words(rng, 200),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every oddity, clashing extra columns and null ids; sources with ties and nulls."""
    rows = []
    for k, text in enumerate(odd_texts()):
        rows.append((k, text, ["en", "fr", None][k % 3], ["b", "a", None, "B"][k % 4], None if text is None else len(text), *[f"x{k}"] * len(CLASHES)))
    rows.append((None, "a null id", None, None, 1, *[None] * len(CLASHES)))
    rows.append((7, rows[7][1], "en", "B", 1, *["again"] * len(CLASHES)))
    ddl = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, ddl)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
