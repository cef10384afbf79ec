"""The pipeline's stages on a small corpus, each against what brute force says of its own input."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def sentence(rng, n):
    return (" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randrange(60)) for _ in range(n)) + ".").capitalize()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    items = [sentence(rng, 30) for _ in range(5)]
    good = [sentence(rng, rng.randrange(60, 200)) for _ in range(220)]
    texts = [(" ".join(w.upper() + "!!" for w in g.split()), 0) if i % 6 == 0 else (g, 1) for i, g in enumerate(good)]
    base = good[1].split()
    texts += [(good[1], 1), (" ".join(base[:30] + ["edited"] + base[31:]), 1), (good[2] + " " + items[0], 1), (items[1] + " " + good[3], 1)]
    rows = [(i, t, "en", f"src{i % 4}", len(t)) for i, (t, _) in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, (_, q) in enumerate(texts) if i % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, [q for _, q in texts], items


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_stages(spark, corpus):
    path, rows, quality, items = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, path)
        seen[name] = [r.asDict() for r in out.collect()]
        assert out.columns[:5] == COLUMNS
        docs = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in seen[name]], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in seen["quality classifier"]}
    assert sum((i in kept) == bool(q) for i, q in enumerate(quality)) >= 0.98 * len(quality)
    root = {r["doc_id"]: r["doc_id"] for r in seen["quality classifier"]}
    sets = {r["doc_id"]: shingles(r["text"]) for r in seen["quality classifier"]}
    for _ in range(3):
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert {r["doc_id"] for r in seen["near-dedup by shingles"]} == set(root.values())
    dirty = {r["doc_id"] for r in seen["near-dedup by shingles"] if any(i.lower().rstrip(".") in r["text"].lower() for i in items)}
    assert dirty and {r["doc_id"] for r in seen["benchmark decontamination"]} == set(root.values()) - dirty
    words = collections.Counter()
    for r in seen["mixing sources"]:
        words[r["source"]] += len(r["text"].split())
    assert words["src0"] > words["src2"] and set(words) == {"src0", "src1", "src2", "src3"}
    shards = collections.Counter(r["shard"] for r in seen["sharding"])
    assert sum(shards.values()) == len(seen["mixing sources"]) and max(shards.values()) - min(shards.values()) <= 1


def test_run_and_odd_rows(spark, corpus, tmp_path):
    path, rows, _, _ = corpus
    assert cp.run(spark, path).count() > 0
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard int"
    odd = spark.createDataFrame([(1, None, None, None, None, 1), (2, "", "en", "s", 0, 1), (None, "word " * 50, "en", "s", 4, 1), (3, "word " * 50, "en", "s", 4, 1), (3, "word " * 50, "en", "s", 4, 1)], schema)
    for name, stage in cp.STAGES:
        out = stage(spark, odd, path)
        assert out.columns == ([*COLUMNS, "shard", "slot"] if name == "sharding" else odd.columns)
        # Repeated rows stay or go together, but for the one of each group that near-dedup keeps.
        assert sum(r.doc_id == 3 for r in out.collect()) in ((1,) if name == "near-dedup by shingles" else (0, 2) if name != "mixing sources" else range(0, 9, 2))
        assert stage(spark, odd.where("doc_id > 99"), path).count() == 0
    assert sorted(r.doc_id for r in cp.near_dedup(spark, odd, path).select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id")).collect()) == [1, 3]


def test_run_on_empty_tables(spark, tmp_path):
    for name, schema in {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = cp.run(spark, str(tmp_path))
    assert out.columns == [*COLUMNS, "shard", "slot"] and out.count() == 0


def test_very_long_texts_pass_whole(spark, corpus):
    """Texts of a million characters and of one word: a copy goes, a benchmark item at the very end is found, the rest stays whole."""
    path, _, _, items = corpus
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150_000))
    docs = spark.createDataFrame([(1, long, "en", "s", 1), (2, long + " end", "en", "s", 1), (3, " ".join(reversed(long.split())) + " " + items[0], "en", "s", 1), (4, "x" * 1_000_000, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.near_dedup(spark, docs, path)
    assert sorted((r.doc_id, len(r.text)) for r in kept.collect()) == [(1, len(long)), (3, len(long) + 1 + len(items[0])), (4, 1_000_000)]
    clean = cp.decontaminate(spark, docs, path)
    assert sorted(r.doc_id for r in clean.collect()) == [1, 2, 4]
    placed = cp.shard(spark, docs, path).collect()
    assert sorted((r.doc_id, len(r.text)) for r in placed) == [(i + 1, len(t)) for i, t in enumerate((long, long + " end", " ".join(reversed(long.split())) + " " + items[0], "x" * 1_000_000))]
