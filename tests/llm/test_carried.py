"""Operators on executors that have no copy of this package."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
AWAY = """
import sys; sys.path.insert(0, {root!r})
import public_tokenizers, sentencepiece, tiktoken
from tiktoken.load import load_tiktoken_bpe
from pyspark.sql import SparkSession, functions as F
from tickloom.llm import bpe, lbl, pii, piece_counts
conf = {{"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "512m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1",
        "spark.sql.shuffle.partitions": "2", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": {shared!r}}}
spark = SparkSession.builder.config(map=conf).getOrCreate()

def there(_):
    try:
        import tickloom
        yield True
    except ImportError:
        yield False

assert spark.sparkContext.parallelize(range(4), 4).mapPartitions(there).collect() == [False] * 4
texts = ["one two two three", "Mail to ann@example.org or 10.1.2.3", "", None, "two  words\\nand a line", "one two four"]
docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
model = public_tokenizers.path("piece_bpe_32k.model")
plain = sentencepiece.SentencePieceProcessor(model_file=str(model))
assert {{r.doc_id: r.n_tokens for r in piece_counts.count_tokens(docs, model).collect()}} == {{i: len(plain.encode(t or "")) for i, t in enumerate(texts)}}
scores = lbl.score(docs, lbl.held_out(F.col("doc_id"))).collect()
assert {{r.doc_id: r.n_tokens for r in scores}} == {{i: len((t or "").split()) + 1 for i, t in enumerate(texts)}}
ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
whole = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(str(ranks)), special_tokens={{}})
assert {{r.doc_id: r.ids for r in bpe.encode(docs, ranks, public_tokenizers.PATTERN).collect()}} == {{i: whole.encode_ordinary(t or "") for i, t in enumerate(texts)}}
assert [s.kind for r in pii.detect(docs).where("doc_id = 1").collect() for s in r.spans] == ["email", "ip"]
spark.stop()
"""


def test_values_for_all_tasks_travel_with_their_code(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", AWAY.format(root=ROOT, shared=f"file://{tmp_path}/shared")], env=env, capture_output=True, text=True, timeout=600, cwd=tmp_path)
    assert run.returncode == 0, run.stderr[-3000:]
