from gradus.operators import splits as S


def test_repeated_images_are_skipped(spark):
    rows = [(0, "a", 0, "s0", "t0"), (1, "b", 1, "s0", "t1"), (2, "c", 1, "s2", "t0"), (3, "d", 1, "s3", "t3")]
    ids = spark.createDataFrame(rows, "pos int, id string, scene int, student string, teacher string")
    assert {r["id"]: r["next_id"] for r in S.successors(ids, ("student", "teacher")).collect()} == {"a": "d", "d": "a"}
    assert {r["id"]: r["next_id"] for r in S.successors(ids).collect()} == {"a": "b", "b": "a", "c": "a", "d": "a"}
