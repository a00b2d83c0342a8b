"""The streaming extension: running counts equal those of all files together."""

from collections import Counter

from quirework.streaming import lines

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_repeated_lines_of_a_stream(spark, tmp_path):
    folder, batches = str(tmp_path / "in"), [["One  line\nother\n\n", "one line"], ["OTHER\nlast", None, ""]]
    for k, texts in enumerate(batches):
        spark.createDataFrame([(10 * k + i, t, None, None, None) for i, t in enumerate(texts)], DOCS).coalesce(1).write.mode("append").parquet(folder)
    counts = lines.repeated_lines(lines.read_documents(spark, folder))
    run = counts.writeStream.format("memory").queryName("lines_of_a_stream").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    run.awaitTermination(120)
    got = {r.key: r.n for r in spark.table("lines_of_a_stream").collect()}
    want = Counter(" ".join(line.lower().split()) for texts in batches for t in texts for line in (t or "").split("\n") if line.strip())
    assert got == {k: n for k, n in want.items() if n >= 2} == {"one line": 2, "other": 2}
