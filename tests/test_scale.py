"""Steps that must stay bounded: in pieces they give what they give at once."""

import hashlib
import os
import unicodedata

from pyspark.sql import functions as F

from loomery.functions import text as T
from loomery.operators import decisions as X
from loomery.operators import near as N
from loomery.operators import ordering as O
from loomery.operators import quality as Q
from loomery.plans import decision_queries as D
from loomery.plans import stream_queries as R
from loomery.sources import files as B
from loomery.streaming import events as S


def test_oracle_bootstrap_draws_as_often_as_the_reference():
    assert D.REPLICATES == 10_000 and "range(10000)" in D.ORACLES["oracle_bootstrap"]


def test_resampled_sums_over_pieces(spark, monkeypatch):
    values = {"x": [(i * 37) % 11 - 5 for i in range(50)], "y": [3, None, 4]}
    rows = spark.createDataFrame([(s, i, v) for s, vs in values.items() for i, v in enumerate(vs)], "s string, i long, v long")
    wanted = {}
    for s, vs in values.items():
        for r in range(90):
            at = [int(hashlib.sha256(f"{r}:{s}:{slot}".encode()).hexdigest()[:12], 16) % len(vs) for slot in range(len(vs))]
            wanted[r, s] = (sum(vs[a] or 0 for a in at), sum(vs[a] is not None for a in at))
    for held in (1 << 18, 7):
        monkeypatch.setattr(X, "HELD_ROWS", held)
        monkeypatch.setattr(X, "SLOTS_AT_ONCE", 9)
        got = X.resampled_sums(rows, "s", "i", 90, {"v": F.col("v"), "n": F.col("v").isNotNull().cast("int")})
        assert {(r["replicate"], r["s"]): (r["v"] or 0, r["n"]) for r in got.collect()} == wanted


def test_normal_form_stays_in_the_jvm_and_equals_pythons(spark):
    fold = lambda t: " ".join(unicodedata.normalize("NFKC", t).casefold().split())
    known = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Cs")]
    texts = ["".join(f"a{c} {c}b\u0301" for c in known[i : i + 500]) for i in range(0, len(known), 500)] + ["", "  Straße\u3000ﬁ \n\x1cⅣ ", "e\u0301\u0323 \uac00\u11a8 İ"]
    frame = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", T.nfkc_casefold(F.col("t")).alias("n"))
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()
    wrong = [r["t"][:20] for r in frame.collect() if r["n"] != (None if r["t"] is None else fold(r["t"]))]
    assert not wrong


def written(df, what):
    """How often the optimized plan has ``what``."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


def test_digests_of_a_sketch_are_made_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert written(N.with_sketch(docs, "doc_id"), "sha2(") == 1


def test_what_is_exploded_is_made_once(spark):
    docs = spark.createDataFrame([(1, "poker"), (2, "none"), (3, None)], "doc_id long, text string").repartition(2)
    out = T.exploded(docs, ["doc_id"], Q.risk_reasons(F.col("text")), "risk")
    assert [tuple(r) for r in out.collect()] == [(1, "casino_or_betting")] and written(out, "sportsbook") == 1


def test_signals_behind_a_filter_are_found_once(spark):
    docs = spark.createDataFrame([(1, "Because a proof. " * 40), (2, None)], "doc_id long, text string").repartition(2)
    out = Q.with_signals(docs).filter(F.size("quality_reasons") == 0).select("doc_id", "band", "difficulty", "longest_run", "url_density")
    assert written(out, "(.)") == 1 and written(out, "https?") == 1 and written(out, "NORMALIZE") + written(out, "foldCase") == 1


def test_a_curriculum_takes_its_order_from_buckets_or_texts(spark):
    rows = spark.createDataFrame([(i, f"text {i}", "reasoning") for i in range(60)], "doc_id long, text string, band string")
    whole = sorted(map(tuple, O.curriculum(rows).collect()))
    assert sorted(map(tuple, O.curriculum(rows.select("doc_id", "band", O.bucket(F.col("text")).alias("bucket"))).collect())) == whole


def test_running_counts_of_a_hot_key_over_batches(spark, tmp_path):
    for part in range(2):
        rows = spark.range(part * 15_000, (part + 1) * 15_000).select(F.floor(F.col("id") % 3 / 2).alias("user_id"), F.col("id").alias("event_id"), F.lit("x").alias("event_type"))
        rows.repartition(1).orderBy(F.xxhash64("event_id")).coalesce(1).write.parquet(str(tmp_path / f"in{part}"))
        (made,) = (tmp_path / f"in{part}").glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        made.rename(tmp_path / "in" / f"{part}.parquet")
        os.utime(tmp_path / "in" / f"{part}.parquet", (1_700_000_000 + 100 * part,) * 2)
    for files in ("1", "9"):
        stream = spark.readStream.schema("user_id long, event_id long, event_type string").option("maxFilesPerTrigger", files).parquet(str(tmp_path / "in"))
        got = sorted((r["user_id"], r["event_id"], r["prior"]) for r in S.running_counts(stream).collect())
        keys = [[e for e in range(30_000) if e % 3 // 2 == u] for u in (0, 1)]
        assert got == [(u, e, i) for u, events in enumerate(keys) for i, e in enumerate(events)]


def test_bundles_are_cut_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(B, "PIECE", 8)
    content, cuts = bytes(range(60)), [0, 3, 3, 20, 24, 60]
    index = [("a", lo, hi - lo, hashlib.sha256(content[lo:hi]).hexdigest() if lo != 24 else "x") for lo, hi in zip(cuts, cuts[1:], strict=False)]
    frame = spark.createDataFrame(index, "bundle string, offset long, length int, sha256 string")
    for size, sound in ((60, True), (61, False)):
        bundles = spark.createDataFrame([("a", bytearray(content[:60] + b"+" * (size - 60))), ("b", bytearray(b"unused"))], "bundle string, content binary")
        rows = sorted((r["offset"], r["length"], bytes(r["blob"]), r["sound"]) for r in B.bundle_blobs(bundles, frame).collect())
        assert rows == [(lo, n, content[lo : lo + n], sound and lo != 24) for _, lo, n, _ in index]
    assert all("content" not in f.name for f in B.bundle_blobs(bundles, frame).schema)


def test_packed_documents_need_no_token_ids(spark, tmp_path):
    docs = [(0, "a b c", "en"), (1, "a b c", "en"), (2, "", "de"), (3, " d  e ", "fr")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = R.packed(spark, str(tmp_path))
    assert "tokens" not in plan.columns and sorted((r["doc_id"], r["n_tokens"], r["kept"]) for r in plan.collect()) == [(0, 3, 4), (2, 0, 1), (3, 2, 3)]
