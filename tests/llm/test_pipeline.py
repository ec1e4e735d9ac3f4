import collections
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from tallymark.llm import components, near_copies, queries

from .test_free_operators import brute_components, brute_print
from .test_native_operators import norm


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with junk, exact copies, near copies and awkward rows, and labels of two thirds of them."""
    rng = random.Random(3)
    words = ["stone", "river", "hill", "moon", "walk", "été", "rain", "deep", "salt", "fern", "gold", "wind"]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        junk = i % 5 == 0
        rows.append((i, " ".join(f"{x.upper()}!!" for x in w) if junk else " ".join(w).capitalize() + ".", "en", rng.choice(["a", "b", "c", None]), 0))
        if i % 3:
            labels.append((i, int(not junk), 0))
    long = [rng.choice(words) for _ in range(3000)]
    rows += [(1000 + k, " ".join([*long[: 700 * k], "changed", *long[700 * k + 1 :]]), "en", "a", 0) for k in range(3)]
    rows += [(2000 + k, rows[1][1].replace(" ", "  " if k else "\t"), "en", "b", 0) for k in range(4)]
    rows += [(3000, None, None, None, None), (3001, "", "en", "c", 0), (3002, "  ", "en", "c", 2)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def staged(spark, corpus, n):
    """What the first n stages keep."""
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:n]:
        docs = corpus_pipeline.save(stage(spark, docs, corpus[0]), "stage")
    return docs


def test_stages_match_brute_force(spark, corpus):
    texts = {r[0]: r[1] for r in corpus[1]}
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    kept = [staged(spark, corpus, n) for n in range(1, 5)]
    assert all(k.columns == columns for k in kept)
    ids = [[r["doc_id"] for r in k.collect()] for k in kept]
    # quality: junk goes, the rest stays
    assert set(ids[0]) == {i for i, t in texts.items() if "!!" not in (t or "")}
    # one of each text, the one with the smallest id
    least = {}
    for i in sorted(ids[0]):
        least.setdefault(norm(texts[i]), i)
    assert sorted(ids[1]) == sorted(least.values())
    # one of each component of near copies
    left = sorted(ids[1])
    root = brute_components([brute_print(texts[i]) for i in left])
    assert sorted(ids[2]) == [left[i] for i in sorted(set(root))]
    assert len({1000, 1001, 1002} & set(ids[2])) == 1
    # the mix takes documents at most twice and meets the total
    times = collections.Counter(ids[3])
    assert set(times) <= set(ids[2]) and max(times.values()) <= 2
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", texts[i] or "")) for i in ids[2]}
    assert sum(size[i] * n for i, n in times.items()) == pytest.approx(1.5 * sum(size.values()), abs=4 * max(size.values()))


def test_run_packs_what_the_mix_took(spark, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    texts = {r[0]: r[1] or "" for r in corpus[1]}
    times = collections.Counter(r["doc_id"] for r in staged(spark, corpus, 4).collect())
    out = corpus_pipeline.run(spark, corpus[0]).collect()
    codes = {i: np.array([*tokenizer.encode(texts[i], add_special_tokens=False).ids, 0], "<u4") for i in times}
    cover = {i: np.zeros(len(c), int) for i, c in codes.items()}
    for r in out:
        piece = codes[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(piece.tobytes()) == r["ids_crc32"]
        cover[r["doc_id"]][r["start"] : r["start"] + r["length"]] += 1
    assert all((cover[i] == n).all() for i, n in times.items())


def test_registered(spark):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n in __spark_entry__.queries() if n.startswith("op")] == sorted((n for n in __spark_entry__.queries() if n.startswith("op")), key=lambda n: int(re.match(r"op(\d+)_", n)[1]))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def five_words(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_groups(texts, least=0.8):
    root, sets = list(range(len(texts))), [five_words(t) for t in texts]
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= least * len(a | sets[j]) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def test_near_copies_are_those_with_similar_five_word_shingles(spark):
    """Texts with a few changed words, most of them over three bits apart; rows without an id decide by themselves."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    made = []
    for _ in range(60):
        base = [word() for _ in range(rng.randint(40, 300))]
        made.append(" ".join(base))
        for share in (0.01, 0.02, 0.03):
            made.append(" ".join(word() if rng.random() < share else x for x in base))
    made += ["a b c", "A  b c", "a b", None, "", "  "]
    ids = list(range(len(made)))
    no_id = [word() for _ in range(90)]
    made += [" ".join(no_id), " ".join([*no_id[:45], "other", *no_id[46:]]), " ".join(word() for _ in range(80))]
    ids += [None] * 3
    docs = spark.createDataFrame(list(zip(ids, made, strict=True)), "doc_id long, text string").repartition(3)
    out = near_copies.keep_one(docs)
    assert out.columns == docs.columns
    root = brute_groups(made)
    got = collections.Counter(r["doc_id"] for r in out.collect())
    assert got == collections.Counter(ids[i] for i in set(root)) and got[None] == 2
    assert len(set(root)) < len(made) - 60


def test_every_pair_of_a_group_counts():
    rng = np.random.default_rng(0)
    base = np.arange(400, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(400) < share, rng.integers(1000, 10**6, 400), base).astype(np.uint64)) for share in np.linspace(0, 0.4, 60)]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(np.intersect1d(a, sets[j]))
            if 5 * shared >= 4 * (len(a) + len(sets[j]) - shared) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert near_copies.linked(sets, np.ones(len(sets), bool)).tolist() == root


def test_components_in_parts(spark):
    """Parts and blocks of a few shingles give the links that all pairs give."""
    rng = np.random.default_rng(1)
    sets = []
    for c in range(4):
        base = np.arange(c * 1000, c * 1000 + 200, dtype=np.uint64)
        sets += [np.unique(np.where(rng.random(200) < share, rng.integers(10**5, 10**6, 200), base).astype(np.uint64)) for share in np.linspace(0, 0.35, 25)]
    rows = [(i, i // 50, len(x), bytearray(x.tobytes())) for i, x in enumerate(sets)]
    edges = near_copies.exact_links(spark.createDataFrame(rows, "row long, root long, size long, found binary"), part=1500)
    found = {r["node"]: r["root"] for r in components.components(edges).collect()}
    want = near_copies.linked(sets, np.ones(len(sets), bool))
    groups = collections.defaultdict(set)
    for i, r in enumerate(want.tolist()):
        groups[r].add(i)
    got = collections.defaultdict(set)
    for i in range(len(sets)):
        got[found.get(i, -1 - i)].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))
