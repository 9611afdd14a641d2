"""Files, sinks, contracts and streams on odd input."""

import hashlib
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from loomery.operators import contracts as K
from loomery.operators import flows as L
from loomery.operators import near as N
from loomery.operators import ordering as O
from loomery.operators import reviews as V
from loomery.sources import files as X
from loomery.streaming import events as S


def archive(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, data, kind in members:
            info = tarfile.TarInfo(name)
            info.size, info.type, info.linkname = len(data), kind, "x"
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archive_members(spark):
    good = archive([("a/b.md", "ä text".encode(), tarfile.REGTYPE), ("c.rst", b"", tarfile.REGTYPE)])
    frame = lambda data: spark.createDataFrame([("one", bytearray(data))], "path string, content binary")
    assert sorted(map(tuple, X.archive_members(frame(good)).collect())) == [("one", "a/b.md", "ä text"), ("one", "c.rst", "")]
    for name, data, kind in (("../x", b"", tarfile.REGTYPE), ("/x", b"", tarfile.REGTYPE), ("x", b"", tarfile.SYMTYPE), ("x", b"\xff", tarfile.REGTYPE)):
        with pytest.raises(Exception):
            X.archive_members(frame(archive([(name, data, kind)]))).collect()


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = X.numbered_lines(spark, str(tmp_path / "lines.txt")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["line"], r["value"]) for r in rows) == [(i + 1, f"line {i}") for i in range(5000)]


def test_pinned_and_published(spark, tmp_path):
    data = b'{"a": 1}\n{"a": 2}\n'
    (tmp_path / "x.jsonl").write_bytes(data)
    path, digest = str(tmp_path / "x.jsonl"), hashlib.sha256(data).hexdigest()
    assert X.pinned(spark, path, digest, 2).count() == 2
    for wrong in ((digest, 3), ("0" * 64, 2)):
        with pytest.raises(ValueError):
            X.pinned(spark, path, *wrong)
    frame = spark.range(7)
    first = X.publish(frame, str(tmp_path / "a"), {"k": 1}).first()
    again = X.publish(frame.repartition(3), str(tmp_path / "b"), {"k": 1}).first()
    assert first == again and first["rows"] == 7
    with pytest.raises(Exception):
        X.publish(frame, str(tmp_path / "a"), {})
    assert len(X.tree_digest(spark, str(tmp_path / "a" / "data"))) == 64


def test_contracts_reject_and_raise(spark):
    rows = spark.createDataFrame([("x", 1), (None, 2), ("", 3)], "text string, n int")
    rules = {"text": K.filled("text"), "small": F.col("n") < 3}
    kept, rejects = K.split(rows, rules)
    assert [r["n"] for r in kept.collect()] == [1] and {r["n"]: r["broken"] for r in rejects.collect()} == {2: ["text"], 3: ["small", "text"]}
    with pytest.raises(Exception):
        K.required(rows, rules).collect()
    assert K.required(kept, rules).count() == 1


def test_altered_receipts_are_not_sound(spark):
    made = L.receipt(spark.createDataFrame([(1, "b", None)], "z int, a string, n string"))
    assert L.sound_receipts(made).first()["sound"] and not L.sound_receipts(made.withColumn("z", F.lit(2))).first()["sound"]


def test_greedy_keep_is_not_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "first long")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (4, 5)], "a long, b long")
    assert sorted(r["first"] for r in N.greedy_kept(nodes, pairs).collect()) == [0, 2, 4]


def test_blake_sketches_of_copies_agree(spark):
    text = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(0, text), (1, text + " end"), (2, "one two"), (3, text.upper())], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in N.without_near_duplicates(docs, blake=True).collect())[:1] == [0]
    assert 2 in {r["doc_id"] for r in N.without_near_duplicates(docs).collect()} and 3 not in {r["doc_id"] for r in N.without_near_duplicates(docs).collect()}


def test_interleaving_blocks_follow_the_recurrence(spark, monkeypatch):
    counts = spark.createDataFrame([("foundation", 0, 7), ("composition", 0, 5), ("reasoning", 0, 0), ("specialization", 0, 2), ("foundation", 1, 6), ("composition", 1, 4)], "band string, phase_index int, n long")
    whole = sorted(map(tuple, O.interleaved(counts).collect()))
    monkeypatch.setattr(O, "BLOCK", 3)
    assert sorted(map(tuple, O.interleaved(counts).collect())) == whole
    target, sent = [7, 5, 0, 2], [0] * 4
    for _, position, band, k in whole[:14]:
        best = max(range(4), key=lambda i: (target[i] * (position + 1) / 14 - sent[i] if sent[i] < target[i] else -9, -i))
        assert (list(O.SHARES)[best], sent[best]) == (band, k)
        sent[best] += 1


def test_monotone_across_partitions(spark):
    rows = spark.createDataFrame([(i, 0 if i == 37 else i // 10) for i in range(100)], "doc long, phase int")
    assert [r["doc"] for r in V.not_monotone(rows, "doc", "phase", 7).collect()] == [37]


def test_batches_are_handed_over_once(spark, tmp_path):
    spark.range(20).withColumn("ts", F.current_timestamp()).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id long, ts timestamp").parquet(str(tmp_path / "in"))
    got = []
    for _ in range(2):
        S.for_each_batch(stream(), lambda batch, number: got.append((number, batch.count())), str(tmp_path / "checkpoint"))
    assert sum(n for _, n in got) == 20
