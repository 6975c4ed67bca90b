"""Context-tree weighting over several blocks: its disk, and results that do not hang on the blocks."""

from __future__ import annotations

import json
import os
import random
import subprocess
import sys

import pytest
from conftest import ROOT
from pyspark.sql import functions as F

from splitloom.llm import ctw

#: Scores a table in a session of its own, whose event log tells the bytes shuffled.
SCRIPT = """
import sys
from pyspark.sql import SparkSession
from splitloom.llm import ctw

folder, conf = sys.argv[1], {"spark.ui.enabled": "false", "spark.eventLog.enabled": "true", "spark.eventLog.compress": "false"}
conf |= {"spark.eventLog.rolling.enabled": "false", "spark.eventLog.dir": f"file://{folder}/events"}
conf |= {"spark.sql.files.openCostInBytes": "128m"}  # a task for each file
conf |= {"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{folder}/shared", "spark.local.dir": f"{folder}/local"}
spark = SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()
ctw.score(spark.read.parquet(f"{folder}/docs")).write.parquet(f"{folder}/out")
spark.stop()
"""


def made_rows(count: int, words: int) -> list[tuple[int, str, bool, int]]:
    """Texts of made-up words; 200 neighbours are a block, whose halves lie in different files."""
    rng = random.Random(3)
    syllables = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "i", "on", "er")]
    word = lambda: "".join(rng.choices(syllables, k=rng.choice((1, 1, 2, 3, 4))))
    return [(n, " ".join(word() for _ in range(words)), n % 7 != 2, n // 200) for n in range(count)]


def bytes_in(folder: str) -> int:
    return sum(os.path.getsize(os.path.join(top, name)) for top, _, names in os.walk(folder) for name in names)


def test_strings_are_shuffled_once_for_each_block(spark, tmp_path):
    rows = spark.createDataFrame(made_rows(1600, 400), "doc_id long, text string, train boolean, block long")
    rows.repartitionByRange(16, "doc_id").write.parquet(f"{tmp_path}/docs")
    (tmp_path / "events").mkdir()
    (tmp_path / "score.py").write_text(SCRIPT)
    path = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
    subprocess.run([sys.executable, f"{tmp_path}/score.py", str(tmp_path)], check=True, env=os.environ | {"PYTHONPATH": path}, timeout=300)
    shuffled = 0
    for log in (tmp_path / "events").iterdir():
        for event in map(json.loads, log.read_text().splitlines()):
            if event["Event"] == "SparkListenerTaskEnd" and event.get("Task Metrics"):
                shuffled += event["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Bytes Written"]
    text = sum(len(row.text) for row in rows.select("text").collect())
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1600
    assert shuffled + bytes_in(f"{tmp_path}/shared") < 12 * text


def test_scores_do_not_hang_on_blocks(spark):
    rows = [*made_rows(60, 30), (60, None, True, 0), (61, "", False, 0), (3, "bada bada", False, 0), (None, "bada xyz", True, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean, block long").repartition(5)
    one = {(r.doc_id, r.train): r for r in ctw.score(docs).collect()}
    blocks = F.coalesce(F.col("doc_id"), F.lit(1)) % 4
    many = {(r.doc_id, r.train): r for r in ctw.score(docs.withColumn("block", blocks)).collect()}
    assert len(one) == len(rows) and many.keys() == one.keys()
    for key, row in one.items():
        assert many[key][:5] == row[:5]
        assert many[key][5:] == pytest.approx(row[5:], rel=1e-9)
