"""The query of streamed edits keeps no paths, which each of its batches would make anew."""

import pytest

from arborlake.queries import QUERIES
from arborlake.streaming import jobs


class Begun(Exception):
    pass


def test_a_stream_of_edits_starts_without_paths(spark, monkeypatch):
    def begin(nodes, versions, path):
        assert not {"ord_path", "depth"} & set(nodes.columns) and {"anc_ids", "fields", "content"} <= set(nodes.columns)
        raise Begun

    monkeypatch.setattr(jobs, "begin", begin)
    with pytest.raises(Begun):
        QUERIES["s1_edit_stream"](spark, "/root/testdata/sf0.001")
