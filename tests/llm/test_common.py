"""The shared folder, Spark's schemes, and columns that clash with an operator's own."""

from types import SimpleNamespace

import pytest

from bitquarry.llm import common
from bitquarry.llm.op10_line_dedup import dedup_lines


def test_names_of_local_folders(tmp_path):
    for uri in (f"file://{tmp_path}/a/b", f"file:{tmp_path}/a/b", f"{tmp_path}/a/b"):
        common.write_file(uri, uri.encode())
        assert common.read_file(uri) == uri.encode()


def test_schemes_that_arrow_names_otherwise(monkeypatch):
    asked = []
    arrow = SimpleNamespace(FileSystem=SimpleNamespace(from_uri=asked.append))
    monkeypatch.setattr(common, "pafs", arrow)
    common.filesystem("s3a://bucket/x")
    common.filesystem("hdfs://host/x")
    assert asked == ["s3://bucket/x", "hdfs://host/x"]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session(), "x")


def test_columns_that_clash_with_line_dedup(spark):
    line = "a line that is long enough to be looked at"
    rows = [(1, f"{line}\nshort", 7, "a", None), (2, f"{line}\nother", 8, "b", [1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id long, __own string, __GONE array<int>")
    got = sorted(map(tuple, dedup_lines(docs).collect()))
    assert got == [rows[0], (2, "other", 8, "b", [1])]
