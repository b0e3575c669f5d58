import os
import threading

import pytest

from tallytree import session
from tallytree.plans import sample_star


def test_pins_lie_in_the_configured_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    pinned = session.pin(spark.range(3).toDF("x"), "t")
    files = pinned.inputFiles()
    assert files and all(root.split(":")[-1] in f for f in files)
    assert pinned.count() == 3


def test_folders_by_column(spark):
    pinned = session.pin(spark.range(4).selectExpr("id", "concat('u', id % 2) AS unit"), "t", by=["unit"])
    assert pinned.filter("unit = 'u1'").count() == 2


def test_scope_drops_its_pins(spark):
    outside = session.pin(spark.range(3).toDF("x"), "t")
    with session.scratch_scope(spark):
        inside = session.pin(spark.range(3).toDF("x"), "t")
        folder = os.path.dirname(inside.inputFiles()[0].removeprefix("file://"))
        assert os.path.isdir(folder)
    assert not os.path.exists(folder)
    assert outside.count() == 3


def test_cluster_without_shared_folder_is_refused():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "app-1"

    class Fake:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.scratch_root(Fake())


def test_star_is_landed_again_if_it_is_gone(spark):
    sf_dir = "/root/testdata/sf0.001"
    key = (spark.sparkContext.applicationId, sf_dir)
    first = sample_star.landed_star_path(spark, sf_dir)
    assert sample_star.landed_star_path(spark, sf_dir) == first
    sample_star._LANDED[key] = first + "-gone"
    assert sample_star.landed_star_path(spark, sf_dir) not in (first, first + "-gone")


def test_scopes_of_threads_do_not_meet(spark):
    """The scope that closes first leaves the pins of the other alone."""
    opened, closed, kept = threading.Event(), threading.Event(), []

    def other():
        with session.scratch_scope(spark):
            kept.append(session.pin(spark.range(3).toDF("x"), "t"))
            opened.set()
            closed.wait(60)
            kept.append(kept[0].count())

    thread = threading.Thread(target=other)
    thread.start()
    opened.wait(60)
    with session.scratch_scope(spark):
        session.pin(spark.range(3).toDF("x"), "t")
    closed.set()
    thread.join()
    assert kept[1] == 3


def test_numbering_keeps_null_keys(spark):
    from tallytree.operators.ordering import numbered

    df = spark.createDataFrame([(None, 2), (None, 1), (1, 5)], "k INT, v INT")
    assert sorted((r.k or 0, r.v, r.n) for r in numbered(df, ["k"], ["v"], "n").collect()) == [(0, 1, 1), (0, 2, 2), (1, 5, 1)]
