import collections
import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallymark.llm import exact_dedup, kd_shards, url_rules

from .corpus import documents, empty, rows

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def norm(t):
    return BLANK.sub(" ", t or "")


def brute_dedup():
    groups = collections.defaultdict(list)
    for r in rows():
        groups[norm(r[1])].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        first = True
        for i in sorted(ids, key=lambda x: (x is None, x)):
            out.append((i, keep, len(ids), first, hashlib.sha256(text.encode()).hexdigest()))
            first = False
    return collections.Counter(out)


def weak(text):
    """A digest of two bits: nearly all texts collide."""
    return F.unhex(F.lpad(F.hex(F.pmod(F.crc32(text.cast("binary")), F.lit(4))), 2, "0"))


def test_exact_dedup_matches_brute_force(spark):
    out = exact_dedup.exact_dedup(documents(spark)).select("id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("d"))
    assert collections.Counter(map(tuple, out.collect())) == brute_dedup()


def test_colliding_digests_are_told_apart_by_bytes(spark):
    out = exact_dedup.exact_dedup(documents(spark), digest=weak).select("id", "keep_id", "group_size", "kept")
    want = collections.Counter({k[:4]: 0 for k in brute_dedup()})
    for k, n in brute_dedup().items():
        want[k[:4]] += n
    assert collections.Counter(map(tuple, out.collect())) == want


@pytest.mark.parametrize("digest", [exact_dedup.sha256, weak])
def test_drop_copies_keeps_one_row_of_each_text(spark, digest):
    docs = documents(spark)
    out = exact_dedup.drop_copies(docs, digest=digest)
    assert out.columns == docs.columns
    kept = out.collect()
    assert collections.Counter(norm(r["text"]) for r in kept) == collections.Counter({norm(r[1]): 1 for r in rows()})
    want = {k[0] for k in brute_dedup() if k[3]}
    assert {r["doc_id"] for r in kept} == want


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    assert exact_dedup.drop_copies(empty(spark)).count() == 0


def test_full_filter_lets_all_through(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_FILTER_BLOCKS", 1)
    assert exact_dedup.exact_dedup(documents(spark)).where("kept").count() == len({norm(r[1]) for r in rows()})


def test_shards_are_even_and_slots_gapless(spark):
    out = kd_shards.document_shards(documents(spark), 8).collect()
    assert collections.Counter((r["id"], r["size"], r["crc"]) for r in out) == collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows())
    slots = collections.defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(8))


def test_shards_split_weights_at_the_median(spark):
    df = spark.range(0, 5000).select("id", (F.pmod(F.xxhash64("id"), F.lit(50)) + 1).alias("size"), F.lit("one").alias("lang"))
    for shards in (2, 3, 8):
        out = kd_shards.kd_shards(df, F.col("size"), {"lang": kd_shards.category(F.col("lang")), "id": F.col("id")}, F.xxhash64("id"), shards=shards)
        sums = [r["w"] for r in out.groupBy("shard").agg(F.sum("size").alias("w")).collect()]
        assert len(sums) == shards and max(sums) - min(sums) <= 150


def test_one_repeated_row_fills_all_shards(spark):
    df = spark.range(0, 4000).select(F.lit(7).alias("id"), F.lit(10).alias("size"))
    out = kd_shards.kd_shards(df, F.col("size"), {"id": F.col("id")}, F.xxhash64("id"), shards=4)
    sums = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert len(sums) == 4 and max(sums) - min(sums) <= 120


def test_target_bytes_and_empty(spark):
    df = spark.range(0, 1000).select("id", F.lit(10).alias("size"))
    out = kd_shards.kd_shards(df, F.col("size"), {"id": F.col("id")}, F.xxhash64("id"), target_bytes=2500)
    assert out.select("shard").distinct().count() == 4
    assert kd_shards.document_shards(empty(spark), 8).count() == 0


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"), ("block", "a.b.example.com/"), ("allow", "b.example.com/x")]
URLS = [
    None, "", "no scheme", "http://", "://com/en/1", "http://Example.COM/en/7?x", "https://www.example.com/en/70/a#b", "http://example.com/en/8", "http://notexample.com/en/7", "http://com/en", "http://com/en/",
    "ftp://a.example.net/de/81", "http://example.net/de/9", "http://net/de/", "http://xnet/de/", "http://org?/es/", "http://www.org/es/q", "http://org./es/", "http://.com/en/", "http://a.b.example.com/x/y", "http://b.example.com/xy",
    "http://c.a.b.example.com", "http://a.b.example.com/", "http://user@example.com/en/7", "http://example.com:80/en/7", "http://ÉX.com/en/", "a://b://com/en/", "http://com\x01/en/", "http://a\x00com/en/", "http://example\x00www.com/en/",
]


def brute_url(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for verdict, rule in RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0,), (len(rule), h, p, verdict))
    return host, path, best[1] + best[2] if best else None, best[3] if best else "allow"


def test_url_rules_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(URLS * 3)], "page_id long, url string, host string, verdict string").repartition(6)
    out = url_rules.match_urls(pages, url_rules.rule_frame(spark, RULES)).collect()
    assert sorted((r["id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in out if r["rule"]) == sorted((i, *brute_url(u)) for i, u in enumerate(URLS * 3) if brute_url(u)[2])
    assert {r["id"]: tuple(r)[1:] for r in out} == {i: brute_url(u) for i, u in enumerate(URLS * 3)}


def test_url_rules_of_no_pages_and_null_ids(spark):
    rules = url_rules.rule_frame(spark, RULES)
    assert url_rules.match_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    same = spark.createDataFrame([(None, "http://com/en/")] * 5, "page_id long, url string")
    assert [tuple(r) for r in url_rules.match_urls(same, rules).collect()] == [(None, "com", "/en/", "com/en/", "block")] * 5
