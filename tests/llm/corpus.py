"""A small corpus with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, digest string, kept string, _score double, shard int, key string"


def texts(seed=5):
    rng = random.Random(seed)
    words = ["the", "of", "stone", "river", "Hill", "moon", "walk", "été", "größe", "día", "x1", "a,b", "end."]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    out += [out[3], out[3], out[3].replace(" ", "\n\t"), out[4] + " ", " " + out[4], None, None, "", "   ", "\n", "word", "Word two", "a b c"]
    out += [" ".join(out[7].split()[:-1]) if len(out[7].split()) > 3 else "p q r s"]
    out += [" ".join(rng.choice(words) for _ in range(30_000)), "y" * 50_000, "tab\tand  two   blanks \x1c odd   nb"]
    return out


def rows():
    made = [(i, t, ("en", None, "fr")[i % 3], (None, "s1", "s1", "s2", "é", "S", "s1")[i % 7], None if t is None else len(t)) for i, t in enumerate(texts())]
    made += [made[5], made[5], (None, "no id", "en", "s2", 5), (None, made[3][1], "en", None, 1)]
    return [(*r, "x", "y", "z", 0.5, 9, "k") for r in made]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
