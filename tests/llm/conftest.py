import random

import pytest

#: Names that the operators use themselves, inside.
CLASHES = (
    "node", "row", "words", "span", "spans", "cut", "copy", "key", "id", "of", "rest", "later_id__", "later_row__", "gone_spans__", "cut_text__", "span_key__",
    "span_id__", "span_of__", "copy__", "row__", "text_key", "found", "w", "bucket", "label", "n", "piece", "length", "bin_group", "n_tokens", "size", "odd name", "a.b", "p",
)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


@pytest.fixture(scope="session")
def texts():
    """Nulls, empty and very long texts, ties, copies, near copies, shared passages, odd bytes."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("aeioust") for _ in range(1 + rnd.randrange(6))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base, passage, line = say(120).split(), say(60), say(12)
    out = [None, "", " \t\n", "one", "One two", "ONE TWO", "É é \x0b\x0c\r x", "a\n\na\nb\na", "# $ % & | < > * " * 20, "Wait! Stop! No! Go! " * 5, "same " * 40]
    out += [" ".join(base), " ".join(base), " ".join(base).upper()]
    for k in range(12):
        near = list(base)
        for _ in range(1 + k % 4):
            near[rnd.randrange(len(near))] = rnd.choice(vocabulary)
        out.append(" ".join(near))
    for _ in range(10):
        out.append(say(30) + " " + passage + "\n" + say(20) + " " + line)
    out.append(passage + " " + passage)
    out.append(say(9000))
    for _ in range(20):
        out.append(line + "\n" + say(rnd.randrange(1, 60)))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as rows with extra columns whose names clash with the operators' own."""
    langs = ["en", "fr", None]
    rows = [(100 - 1 * k if k % 2 else 1000 + k, t, langs[k % 3]) for k, t in enumerate(texts)]
    return spark.createDataFrame([(r[0], r[1], r[2], "s", len(r[1] or ""), *(f"{c} {r[0]}" for c in CLASHES)) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def unchanged(docs, kept):
    """The rows kept have all other columns as they were."""
    assert kept.columns == docs.columns
    names = [f"`{c}`" for c in docs.columns if c not in ("text", "n_chars")]
    have = set(map(tuple, kept.select(*names).collect()))
    assert have <= set(map(tuple, docs.select(*names).collect()))
    return have


@pytest.fixture(scope="session")
def same_columns():
    return unchanged
