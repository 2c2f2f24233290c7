from tidewheel.llm import common


def test_partitions_follow_the_size_of_files(spark, docs, tmp_path, monkeypatch):
    spark.range(200_000).write.parquet(str(tmp_path / "t"))
    files = spark.read.parquet(str(tmp_path / "t"))
    assert common.partitions(spark) == common.partitions(spark, files) == 4
    monkeypatch.setattr(common, "PART_BYTES", 10_000)
    assert common.partitions(spark, files.where("id > 3")) > 20
    assert common.partitions(spark, docs([(1, "a")])) == 4  # of a size that Spark does not know


def test_tuning_leaves_what_a_session_has_set(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for given, want in ((None, "1000"), ("77", "77")):
        session = spark.newSession()
        if given:
            session.conf.set(key, given)
        assert common.tune(session).conf.get(key) == want


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    try:
        common.shared_dir(Session())
    except RuntimeError as e:
        assert "spark.checkpoint.dir" in str(e)
    else:
        raise AssertionError("no error")
