import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from strataforge import work
from strataforge.operators import chunking, export, fulltext


def peak(run) -> int:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_parts_hold_all_values_in_order_and_are_small():
    for values in (["x" * (i % 900) for i in range(5000)] + [None, "y" * 3_000_000, ""], [["w"] * (i % 90) for i in range(5000)] + [None, []]):
        held = pa.array(values).slice(3)
        cut = list(work.parts(held, 100_000))
        assert [v for p in cut for v in p.to_pylist()] == values[3:]
        assert all(len(p) == 1 or sum(len(v or "") for v in p.to_pylist()) <= 100_000 for p in cut) and len(cut) > 10
    assert list(work.parts(pa.array([], pa.string()))) == []


def test_a_batch_of_texts_is_chunked_part_by_part():
    batch = pa.array([("word. " * 400) + str(i) for i in range(8000)])  # 19 MB
    made = []
    assert peak(lambda: made.extend(work.mapped([batch], chunking.chunk_text, pa.list_(pa.string())))) < 8_000_000
    assert made[0][7999].as_py() == chunking.chunk_text(batch[7999].as_py())


def test_documents_are_cut_as_texts_are(spark):
    texts = ["a. b\n\n\n" * 300, None, " ", "x" * 2000]
    got = chunking.with_chunks(spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)).orderBy("i").select(F.col("chunks")).collect()
    assert [r.chunks for r in got] == [chunking.chunk_text(t) for t in texts]


def test_tokens_of_a_segment_stay_in_arrow():
    words = pa.array([[f"w{(i * j) % 997}" for j in range(300)] for i in range(1000)])
    assert peak(lambda: sum(1 for _ in fulltext.inverted(words))) < 40_000_000
    assert list(fulltext.inverted(words.slice(1, 50))) == list(fulltext.inverted(words.to_pylist()[1:51]))


def test_database_files_in_parts_are_the_whole_files(spark):
    docs = spark.createDataFrame([("a", "d1", "x.txt", "txt", 2), ("a", "d0", "y.txt", "txt", 1), (None, "d2", "z.txt", "txt", 1)], "owner string, document_id string, filename string, file_type string, position int")
    chunks = spark.createDataFrame([("a", "d1", i, f"part {i} " * 40) for i in range(50)] + [("a", "d0", 0, "first"), ("a", "gone", 0, "no document"), ("b", "d9", 0, "no file")], "owner string, document_id string, chunk_index int, content string")
    whole = {r.owner: bytes(r.content) for r in export.sqlite_files(docs, chunks, "owner", "now").collect()}
    parts = export._sqlite_built(docs, chunks, "owner", "now", 4096).collect()
    assert len(parts) > 3 and {o: b"".join(bytes(p.content) for p in sorted(parts, key=lambda p: p.offset) if p.owner == o) for o in whole} == whole and set(whole) == {"a", None}
    rows = sorted((r.owner, r.row_id, r.document_id, r.chunk_index, r.found) for r in export.sqlite_contents(export.sqlite_parts(docs, chunks, "owner", "now"), "owner", '"part 7"').collect())
    assert rows == [("a", 1, "d0", 0, False)] + [("a", i + 2, "d1", i, i == 7) for i in range(50)]
