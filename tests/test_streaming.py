import random
import re

from conftest import rows
from pyspark.sql import functions as F

from corvane.streaming import filters, sessions


def test_think_over_chunks():
    assert filters.run_steps(filters.think_step, ["intro ", "<think>hidden", " more hidden</think>", "conclusion"]) == "intro conclusion"
    rng = random.Random(0)
    for _ in range(300):
        text = "".join(rng.choice(["a", "<", "<think>", "</think>", "b\n", "think>"]) for _ in range(12))
        cuts = sorted(rng.sample(range(len(text) + 1), min(4, len(text))))
        chunks = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        want = re.sub(r"(?s)<think>.*?(?:</think>|\Z)", "", text)
        assert filters.run_steps(filters.think_step, chunks) == want


def test_references_over_chunks():
    for text, want in (("Answer.\n\n**References:**\n- a", "Answer."), ("Answer\nwith lines\n\nand more", "Answer\nwith lines\n\nand more"), ("x\n\n---\n# References\ny", "x")):
        for n in (1, 3, 50):
            assert filters.run_steps(filters.references_step, [text[i : i + n] for i in range(0, len(text), n)]) == want


def test_state_is_kept_between_batches(spark, tmp_path):
    parts = [[(1, 0, "a <thi", False), (2, 0, "x", True)], [(1, 1, "nk>secret", False)], [(1, 2, "</thi", False)], [(1, 3, "nk>b<", True), (3, 0, None, True)]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, "stream_id int, seq int, chunk string, is_last boolean").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    schema = spark.read.parquet(str(tmp_path / "in" / "b0")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    shown = sessions.run_to_folder(filters.hide_reasoning(stream), str(tmp_path / "shown"), str(tmp_path / "cp"), mode="append")
    got = shown.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "shown"))), lambda x: x["shown"]), "").alias("t"))
    assert dict(rows(got)) == {1: "a b<", 2: "x", 3: ""}


def test_append_stream_writes_once(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "src"))
    for _ in range(2):
        q = sessions.append_stream(sessions.stream_of(spark, str(tmp_path / "src")), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    seen = []
    sessions.each_batch(sessions.stream_of(spark, str(tmp_path / "src")), lambda df, n: seen.append(df.count()), str(tmp_path / "cp2")).awaitTermination()
    assert sum(seen) == 10
