"""Operators 3, 8 and 9 against plain Python."""

import collections
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from tablewright.llm import mixing, rendezvous, stream_dedup
from tests.llm.fixtures import edge_docs, edge_rows, empty_docs, prose


def test_dedup_edges(spark):
    rows = {}
    for i, t, *_ in edge_rows():
        rows.setdefault(t or "", []).append(i)
    got = stream_dedup.deduplicate(edge_docs(spark)).collect()
    assert len(got) == len(edge_rows())
    by_digest = collections.defaultdict(list)
    for r in got:
        by_digest[r.digest].append(r)
    assert len(by_digest) == len(rows)
    largest = {tuple(sorted(map(str, v))): max((x for x in v if x is not None), default=None) for v in rows.values()}
    for group in by_digest.values():
        keep = largest[tuple(sorted(str(r.doc_id) for r in group))]
        assert {(r.keep_id, r.group_size) for r in group} == {(keep, len(group))}
        assert all(r.kept == (r.doc_id == keep) for r in group)


def test_dedup_checks_bytes_behind_equal_digests(spark):
    docs = edge_docs(spark)
    weak = stream_dedup.deduplicate(docs, digest=lambda body: (F.length(body) % 2).cast("string"))
    strong = stream_dedup.deduplicate(docs)
    cols = ["doc_id", "keep_id", "group_size", "kept"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, weak.select(cols).collect()), key=key) == sorted(map(tuple, strong.select(cols).collect()), key=key)


def test_dedup_survivors_and_stream_in_several_batches(spark, scratch):
    docs = edge_docs(spark)
    out = stream_dedup.survivors(docs)
    texts = [r.text or "" for r in out.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, *_ in edge_rows()}) and out.columns == docs.columns
    docs.select("doc_id", "text").repartition(6).write.parquet(f"{scratch}/in")
    files = spark.read.parquet(f"{scratch}/in")
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 2).parquet(f"{scratch}/in")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, stream_dedup.deduplicate(files, stream).collect()), key=key) == \
        sorted(map(tuple, stream_dedup.deduplicate(docs).collect()), key=key)


def test_rendezvous_law(spark):
    docs = edge_docs(spark)
    got = rendezvous.assign_shards(docs, 8).collect()
    assert len(got) == len(edge_rows())
    texts = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in edge_rows())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == texts

    def shard(key, n):
        u = [(xxhash.xxh64_intdigest("\u0001".join(["shard", "" if key is None else str(key), str(i)]), seed=42) >> 11) for i in range(n)]
        return max(range(n), key=lambda i: u[i])
    slots = collections.defaultdict(list)
    for r in got:
        assert r.shard == shard(r.doc_id, 8) and r.grown_shard == shard(r.doc_id, 9)
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_rendezvous_weights_and_files(spark, scratch):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("mine").alias("shard"))
    counts = dict(rendezvous.assign_shards(ids, weights=[1, 2, 0, 5]).groupBy("shard").count().collect())
    assert 2 not in counts and abs(counts[3] / 20_000 - 0.625) < 0.02 and abs(counts[1] / 20_000 - 0.25) < 0.02
    rendezvous.write_shards(ids, f"{scratch}/shards", 3)
    assert spark.read.parquet(f"{scratch}/shards").count() == 20_000
    with pytest.raises(ValueError):
        rendezvous.shard_of(F.lit(1), [0, 0])


def _targets(sizes, weights=(5, 2, 1), cap=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        share = {s: cap * sizes[s] if s in capped else rest * w[s] / free for s in names}
        over = {s for s in names if s not in capped and share[s] > cap * sizes[s]}
        if not over:
            return share
        capped |= over


@pytest.mark.parametrize("block", [16, 512])
def test_mix_targets_and_bounds(spark, block):
    docs = edge_docs(spark)
    import re
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.defaultdict(int)
    for _, t, _, s, _ in edge_rows():
        sizes[s] += words(t)
    want = _targets(dict(sizes))
    got = mixing.mix(docs, block_words=block).collect()
    again = mixing.mix(docs.repartition(5), block_words=block).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)
    assert len(got) == len(edge_rows()) and all(0 <= r.taken <= 3 * r["size"] for r in got)
    source = {(i, words(t)): s for i, t, _, s, _ in edge_rows()}
    taken = collections.defaultdict(int)
    for r in got:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_permutation_and_multinomial(spark):
    for n in (1, 2, 7, 100):
        df = spark.range(n).select(F.col("id"), mixing.permuted(F.col("id"), F.lit(n), [F.lit(3)]).alias("to"))
        df = df.withColumn("back", mixing.permuted(F.col("to"), F.lit(n), [F.lit(3)], backwards=True))
        rows = df.collect()
        assert sorted(r.to for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(prose(5, 50)).alias("text"),
                                   F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    m = mixing.plan_mix(docs, block_words=10, shard_blocks=200)
    slots = m.slots.collect()
    assert len({(r.sid, r.slot) for r in slots}) == len(slots)
    shards = collections.Counter(r.shard for r in slots)
    assert len(shards) == -(-len(slots) // 200) and all(abs(n - 200) < 80 for n in shards.values())
    whole = [r for r in slots if r.epoch == 0 and r.sid == 0]
    assert len({r.block for r in whole}) == len(whole)


def test_mixed_documents_hold_the_taken_words(spark):
    docs = edge_docs(spark)
    mixed = mixing.mixed_documents(docs, block_words=32)
    assert mixed.columns == docs.columns
    n = mixed.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"))
    taken = mixing.mix(docs, block_words=32).groupBy("doc_id").agg(F.sum("taken").alias("n")).where("n > 0")
    assert {tuple(r) for r in n.collect()} == {tuple(r) for r in taken.collect()}
    texts = {t for _, t, *_ in edge_rows() if t}
    assert any(r.text in texts for r in mixed.collect())


def test_empty_tables(spark):
    docs = empty_docs(spark)
    assert stream_dedup.deduplicate(docs).count() == 0 and stream_dedup.survivors(docs).count() == 0
    assert rendezvous.assign_shards(docs).count() == 0
    assert mixing.mix(docs).count() == 0 and mixing.mixed_documents(docs).count() == 0
