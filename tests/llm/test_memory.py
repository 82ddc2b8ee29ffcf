"""What workers and tables between steps leave behind."""

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm.packing import tokens_of
from tidemark.llm.shared import written
from tidemark.llm.textutil import arrow_map


class Frame:
    """Gives what a worker would run."""

    def __init__(self, spark):
        self.sparkSession = spark

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def resident():
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 / 1e6


def test_a_worker_gives_back_what_a_task_has_freed(spark):
    pins = []

    def heavy(batch):
        arrays = [np.ones(12_000) for _ in range(3000)]  # some 290 MB, each too small for a mapping of its own
        pins.append(arrays[-1])  # what lives on at the heap's end keeps all below it
        return batch

    before = resident()
    list(arrow_map(Frame(spark), heavy, "a long")(iter([pa.record_batch({"a": [1]})])))
    assert resident() < before + 100


def test_words_of_packing_go_when_another_operator_runs(spark, path):
    tokens_of(path("word_bpe_49k.json"), 1000)
    assert list(arrow_map(Frame(spark), lambda b: b, "a long")(iter([pa.record_batch({"a": [1]})])))
    assert tokens_of.cache_info().currsize == 0


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    rows = spark.range(0, 600, 1, 1).select(F.repeat(F.lit("abcdefgh"), 8000).alias("text"))

    def sizes(batch):
        return pa.record_batch({"n": [batch.num_rows], "size": [batch.get_total_buffer_size()]})

    got = arrow_map(rows, sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 600
    assert max(r["size"] for r in got) < 10e6


def test_a_table_between_steps_starts_two_processes_a_file_not_three(spark):
    df = written(spark.range(0, 100, 1, 4).toDF("a"), "plain")
    files = [p.name for p in Path(df._shared_path.removeprefix("file://").removeprefix("file:")).iterdir()]
    assert sum(n.endswith(".parquet") for n in files) == 4
    assert not [n for n in files if n.endswith(".crc")]
    assert sorted(r["a"] for r in df.collect()) == list(range(100))
