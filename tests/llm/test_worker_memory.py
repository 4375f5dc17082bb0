"""Python workers outlive their tasks; the pipeline's stages leave them small."""

from __future__ import annotations

import os
import random
import time
from pathlib import Path

import corpus_pipeline


def workers_mb() -> float:
    """Anonymous memory of the largest Python worker under this process."""
    parents, most = {}, 0.0
    for p in Path("/proc").glob("[0-9]*"):
        try:
            status = dict(x.split(":\t", 1) for x in (p / "status").read_text().splitlines() if ":\t" in x)
            parents[int(p.name)] = int(status["PPid"]), b"pyspark.daemon" in (p / "cmdline").read_bytes(), int(status.get("RssAnon", "0").split()[0]) / 1024
        except (OSError, KeyError):
            pass
    for pid, (_, python, mb) in parents.items():
        up = pid
        while python and up in parents and up != os.getpid():
            up = parents[up][0]
        if python and up == os.getpid():
            most = max(most, mb)
    return most


def test_workers_are_small_after_a_stage(spark):
    rnd = random.Random(4)
    texts = [(i, " ".join(f"{rnd.getrandbits(60):015x}" for _ in range(400)), "en", "s", 0) for i in range(1500)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string, n_chars int").coalesce(1)
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.encode):
        stage(spark, docs, "").write.format("noop").mode("overwrite").save()
        time.sleep(2)
        assert 0 < workers_mb() < 110
