import os

import pytest

from meshlark.operators import tables


def test_tables_are_kept_until_discarded(spark):
    t = tables.written(spark.range(5))
    folder = t.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert t.count() == 5 and os.path.isdir(folder) and "meshlark-" in folder
    tables.discard()
    assert not os.path.exists(folder)


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = {"spark.sql.warehouse.dir": "w"}, Context()

    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_dir(Session())
    Context.master = "local[4]"
    assert tables.shared_dir(Session()) == "w" and tables.shared_dir(spark)
