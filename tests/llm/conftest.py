import random

import pytest

from hearth.llm.common import Scratch

# Columns that clash with names the operators use inside.
EXTRA = "key string, row long, hash string, size long, bucket int, h double, node long, _text string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and long texts, repeated rows, repeated and null keys."""
    rng = random.Random(3)
    passage = words(rng, 40)
    texts = [None, "", "   \n\t ", "one", "two words", "Ärger é È ñ £ 日本語 text", "x" * 300, "ab" * 200,
             passage, passage, f"{words(rng, 30)} {passage} {words(rng, 20)}", f"{words(rng, 9)}\n{passage}",
             "Released under the MIT License.", "GNU General  Public\nLicense mit license MIT LICENSE cc-by",
             words(rng, 9000), "\n".join([words(rng, 12)] * 3), "### $$$ %%% " * 30, "a.\x0bb\x0cc\x1cd\x85e"]
    texts += [words(rng, rng.randint(5, 300)) for _ in range(60)]
    rows = []
    for i, t in enumerate(texts):
        rows.append([i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s0", None, "é"]), len(t or "")])
    rows.append([None, texts[20], "en", "s1", 3])
    rows.append([None, None, None, None, None])
    rows.append([5, words(rng, 60), "en", "s1", 1])  # a key that stands twice
    rows += [list(rows[30]), list(rows[30]), list(rows[8])]  # repeated rows
    full = [tuple(r) + ("k", 1, "x", 2, 3, 0.5, 4, "t") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def scratch(spark):
    return Scratch(spark, "test")


def fixture(spark, tmp_path, name, df):
    """A folder with ``df`` as table ``name``, for the registered queries."""
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
