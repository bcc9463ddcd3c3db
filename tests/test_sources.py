from quernel.functions.digest import _one
from quernel.sources import documents
from quernel.streaming import failures


def test_sections():
    page = "<h1>A &amp; B</h1><p>one<br>two</p><script>x</script><h2>C</h2><ul><li>x<li>y</ul> tail"
    assert documents.sections_of(page) == [("A & B", "one two"), ("C", "x y tail")]
    assert documents.sections_of(None) == []


def test_chunks_slice_back(spark):
    text = "".join(chr(97 + k % 26) for k in range(4001))
    got = documents.chunks(spark.createDataFrame([(1, text), (2, "")], "k long, text string"), ["k"]).collect()
    assert all(text[r["start_char"] : r["end_char"]] == r["chunk"] for r in got if r["k"] == 1)
    assert max(r["end_char"] for r in got) == 4001 and [r["chunk"] for r in got if r["k"] == 2] == [""]


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    documents.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(map(tuple, documents.read_jsonl(spark, str(tmp_path / "j"), df.schema).collect())) == [(1, "a"), (2, None)]


def test_canonical_digest():
    assert _one('{"b": 1, "a": [1.5, null]}') == _one('{"a":[1.5,null],"b":1}') and _one(None) is None


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = failures.failure_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "user_id")
    q = stream.writeStream.format("memory").queryName("failures").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = failures.failure_counts(events, "user_id").collect()
    assert sorted(map(tuple, spark.sql("SELECT * FROM failures").collect())) == sorted(map(tuple, want))
