import pytest
from pyspark.sql import functions as F

from gradus.llm import sharding


def frame(spark, n=400):
    rows = [(i, None if i % 50 == 0 else "text " * (i % 30), "mine") for i in range(n)] + [(3, "text text text ", "mine"), (None, "x" * 300_000, "mine")]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(6)


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def opened(spark, docs, **options):
    return sharding.Shards(spark, sharding.folder(spark, "t"), docs.schema, **options)


def test_round_trip_and_layout(spark):
    docs = frame(spark)
    shards = sharding.shard(docs, target=1 << 20)
    assert same(shards.read(), docs)
    assert [(r["files"], r["tier"], r["rows"]) for r in shards.manifest()] == [(1, 1, docs.count())] and shards.version() == 5
    numbered = shards.read(shard="_shard")
    assert numbered.columns == [*docs.columns, "_shard"] and numbered.agg(F.max("_shard")).first()[0] == 0


def test_arrivals_merge_by_tiers(spark):
    docs = frame(spark)
    shards = sharding.shard(docs, target=1 << 30, arrivals=5)
    assert same(shards.read(), docs)
    assert sorted(r["tier"] for r in shards.manifest()) == [0, 1]
    numbered = shards.read(shard="n").groupBy("n").count().collect()
    assert sorted(r["n"] for r in numbered) == list(range(sum(r["files"] for r in shards.manifest())))
    assert shards.compact(force=True) and [r["tier"] for r in shards.manifest()] == [-1]
    assert same(shards.read(), docs) and not shards.compact(force=True)


def test_versions_are_immutable_and_taken_once(spark):
    docs = frame(spark, 40)
    shards = opened(spark, docs)
    assert shards.version() == 0 and shards.read().count() == 0
    assert shards.append(docs) == 1
    assert not shards._commit(shards.manifest(1), 1)
    assert shards.append(docs) == 2
    assert shards.read(1).count() == docs.count() and shards.read().count() == 2 * docs.count()
    with pytest.raises(ValueError, match="not yet there"):
        shards.read(3)


def test_a_reader_of_an_old_version_sees_it_until_vacuum(spark):
    docs = frame(spark, 40)
    shards = opened(spark, docs)
    shards.append(docs)
    old = shards.read(1)
    assert shards.compact(force=True) and old.count() == docs.count()
    assert shards.vacuum(keep=2) == 0 and shards.read(1).count() == docs.count()
    assert shards.vacuum() == 1 and same(shards.read(), docs)
    with pytest.raises(ValueError, match="vacuumed"):
        shards.read(1)


def test_a_vacuum_between_write_and_commit_loses_nothing(spark, monkeypatch):
    """One writer compacts and vacuums after another has written its files, and before it commits them."""
    docs = frame(spark, 40)
    one, other = (sharding.Shards(spark, root, docs.schema) for root in [sharding.folder(spark, "t")] * 2)
    one.append(docs)
    commit = one._commit

    def late(live, version):
        monkeypatch.setattr(one, "_commit", commit)
        assert other.compact(force=True) and other.vacuum() == 1
        return commit(live, version)

    monkeypatch.setattr(one, "_commit", late)
    assert one.append(docs) == 3
    assert one.read().count() == 2 * docs.count()
    assert one.vacuum(abandoned_after=3600) == 0 and one.read().count() == 2 * docs.count()


def test_what_a_dead_writer_left_goes_with_age(spark):
    docs = frame(spark, 40)
    shards = opened(spark, docs)
    shards.append(docs)
    shards._written(docs)
    assert shards.vacuum() == 0 and shards.vacuum(abandoned_after=-60) == 1
    assert same(shards.read(), docs)


def test_two_merges_of_one_run(spark, monkeypatch):
    docs = frame(spark, 40)
    one, other = (sharding.Shards(spark, root, docs.schema) for root in [sharding.folder(spark, "t")] * 2)
    one.append(docs)
    commit = one._commit

    def late(live, version):
        monkeypatch.setattr(one, "_commit", commit)
        other.compact(force=True)
        return commit(live, version)

    monkeypatch.setattr(one, "_commit", late)
    assert one.compact(force=True) and one.version() == 2 and same(one.read(), docs)


def test_empty(spark):
    docs = frame(spark).limit(0)
    assert sharding.shard(docs).read(shard="n").count() == 0


@pytest.mark.parametrize(("size", "files", "tier"), [(0, 0, 0), (1, 1, 0), (1 << 20, 3, 0), ((1 << 20) + 1, 1, 1), (4 << 20, 9, 1), (5 << 20, 1, 2), (64 << 20, 1, -1), (64 << 20, 2, 3), (63 << 20, 1, 3), (512 << 20, 32, 5)])
def test_tiers(size, files, tier):
    assert sharding.tier_of(size, files, 128 << 20) == tier
