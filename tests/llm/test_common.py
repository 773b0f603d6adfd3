"""What the operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import common


def test_slices_hold_all_rows_and_little_text():
    texts = ["a" * n for n in (5, 0, 30, 2, 2, 9, 100, 1, 1, 1)] + [None, "é" * 4]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["i", "t"])
    got = list(common.sliced([batch, batch.slice(3, 4), batch.slice(0, 0)], 1, 10))
    assert [x for b in got for x in b.column(0).to_pylist()] == [*range(12), 3, 4, 5, 6]
    assert all(b.num_rows <= 1 or sum(len((t or "").encode()) for t in b.column(1).to_pylist()) <= 10 for b in got)


def test_words_of_a_long_text_are_those_of_its_pieces(monkeypatch):
    text = b"One two\tTHREE \n four  five six\x0bseven " * 40
    whole = common.word_hashes(text, common.WordHashes())
    for size in (1, 3, 50, 333):
        monkeypatch.setattr(common, "CHUNK_BYTES", size)
        assert np.array_equal(common.word_hashes(text, common.WordHashes()), whole) and len(whole) == 280


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            @staticmethod
            def sc():
                class None_:
                    @staticmethod
                    def getCheckpointDir():
                        return type("O", (), {"isDefined": staticmethod(lambda: False)})

                return None_

        @staticmethod
        def getConf():
            return {}

    class Spark:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(Spark)
