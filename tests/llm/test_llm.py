"""The operators of loomery.llm against brute force, public libraries and odd tables."""

import base64
import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.llm import bpe, components, jaccard, langid, linededup, lm, media, neighbours, oracles, packing, toxicity, urlrules
from loomery.llm.common import tokenizer_path
from loomery.llm.queries import URL_RULES

RANKS, VOCAB = tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("byte_bpe_50k.json")
random.seed(5)
LANGS = {"en": "the of and ing tion er ea ou st re", "de": "der die sch ung keit ein zu ver ich ä", "fr": "le la que eux tion oi é ai en re"}


def sentence(lang, n):
    parts = LANGS[lang].split()
    return " ".join("".join(random.choices(parts, k=random.randint(1, 3))) for _ in range(n))


def rows():
    out = []
    for i in range(160):
        lang = ("en", "de", "fr")[i % 3]
        text = sentence(lang, random.randint(20, 120)) + "\n" + sentence(lang, 12) + "."
        if i % 5 == 0:
            text += " you idiot scum " + sentence(lang, 5) + " idiot"
        out.append((i, text, lang, f"src{i % 12}", len(text)))
    base = out[1][1]
    out += [(200 + i, base, "de", f"src{i % 12}", len(base)) for i in range(30)]
    out += [(240 + i, base.replace(base.split()[i + 3], "changed", 1), "de", "src1", 0) for i in range(10)]
    out += [(300, None, "en", "src0", 0), (301, "", None, None, 0), (302, "   \n ", "en", "src0", 4), (303, "word", "en", "src0", 4), (None, "an id that is missing", "en", "src0", 4)]
    out += [(304, "7 8 9 !", "en", "src0", 7), (305, sentence("fr", 6000), "fr", "src3", 0), (306, "x" * 30000, None, "src0", 0), (3, out[3][1], "en", "src3", 0)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).withColumn("score", F.lit("extra")).withColumn("rank", F.lit(1)).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 160)] + [(7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_tiktoken(spark, docs, none):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    signs = [*"aest'rvlmd  \n\t1é漢　!?.😀\x1c\x85\xa0²", "'s", "'re", "'ll ", "  "]
    texts = ["".join(random.choices(signs, k=random.randint(0, 40))) for _ in range(3000)] + ["a" * 3000, "!" * 500, "", " ", "''s", "<|endoftext|>"]
    codec = bpe.Codec(RANKS)
    for part in bpe.portions(texts, 5000):
        for text, (data, ids) in zip(part, codec.encode(part), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
            assert codec.decode(ids) == data == text.encode()
            assert codec.offsets(ids)[-1] == len(data)
    for r in bpe.round_trip(docs, RANKS).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = np.array(library.encode_ordinary(r["text"] or ""), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.round_trip(docs, RANKS).count() == docs.count() and bpe.round_trip(none, RANKS).count() == 0


def test_packing_holds_every_id_once(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCAB)
    found = packing.pack(docs, VOCAB).collect()
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in text.items()}
    assert sum(r["length"] for r in found) == sum(len(ids[r["doc_id"]]) for r in docs.select("doc_id").collect())
    by = {}
    for r in found:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (len(part), zlib.crc32(part.tobytes()), len(ids[r["doc_id"]])) == (r["length"], r["ids_crc32"], r["doc_tokens"])
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.LENGTH
    assert len(by) <= sum(r["length"] for r in found) / packing.LENGTH * 1.05 + 2
    assert packing.pack(none, VOCAB).count() == 0
    assert list(packing.tokenizer(VOCAB).encode(["a<|endoftext|> b"]))[0] == np.array(library.encode("a<|endoftext|> b").ids, "<u4").tobytes()


def test_media_round_trip_and_resync(docs, none):
    for r in media.digests(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        data = (r["text"] or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media.digests(docs).count() == docs.count() and media.digests(none).count() == 0
    payload = bytes(range(64)) * 100
    stream = media.wrap(payload)
    clean = media.parse(stream)
    assert clean["payload"] == payload and clean["sound"] and not clean["failed"] and clean["table"]["frames"] == len(clean["seek"])
    size = media.parse_tag(stream)[0]
    junk = media.parse(stream[:size] + b"\xff\x00junk\xff\xfb" + stream[size:])
    assert junk["payload"] == payload and junk["skipped"] == 8
    at = clean["seek"][1] + 8
    assert media.parse(stream[:at] + b"\x01" + stream[at + 1 :])["failed"] == 1
    assert media.parse(b"")["payload"] is None and media.parse(b"no audio")["seek"] == []


def test_media_survives_any_bytes():
    random_ = random.Random(8)
    stream = media.wrap(bytes(range(64)) * 20)
    for _ in range(400):
        data = bytearray(stream[: random_.randrange(len(stream))])
        for _ in range(random_.randrange(6)):
            if data:
                data[random_.randrange(len(data))] = random_.choice([0, 0xFF, 0xF3, 0xB2, random_.randrange(256)])
        media.parse(bytes(data))
    header = bytes([0xFF, 0xF3, 0x10, 0xC4])
    size, _, _, side, _ = media.parse_header(header + bytes(4), 0)
    table = media.parse(header + bytes(side) + (b"Xing" + b"\0\0\0\x0f").ljust(size - 4 - side, b"\1")[: size - 4 - side])["table"]
    assert table is None or set(table) <= {"frames", "bytes", "toc"}
    for value in ("\u00b2", "9" * 5000, "-1", ""):
        assert media.parse(media._tag({"payload_bytes": "1"}).replace(b"\x001", b"\0" + value.encode("latin-1")))["payload"] in (None, b"")


def test_media_reads_vbri_table():
    stream = bytearray(media.wrap(bytes(range(64)) * 100))
    want, at = media.parse(bytes(stream)), media.parse_tag(bytes(stream))[0]
    table = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 1234, len(want["seek"]), 2, 10, 2, 3) + struct.pack(">HH", 7, 8)
    stream[at + 23 : at + 36] = bytes(13)  # after the header, its checksum and the side information
    stream[at + 36 : at + 36 + len(table)] = table
    found = media.parse(bytes(stream))
    assert (found["seek"], found["samples"], found["payload"]) == (want["seek"], want["samples"], want["payload"])
    assert (found["table"]["bytes"], found["table"]["frames"], found["table"]["steps"]) == (1234, len(want["seek"]), [70, 80])


def test_language_id(docs, none):
    found = langid.predict(docs).collect()
    truth = {r["doc_id"]: r for r in docs.collect()}
    held = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 160]
    assert sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held)
    assert {r["doc_id"]: r["lang_pred"] for r in found if r["doc_id"] in (300, 301, 302, 304)} == {300: "und", 301: "und", 302: "und", 304: "und"}
    assert all(0 <= r["score"] <= 1 for r in found) and len(found) == docs.count()
    assert langid.predict(none).count() == 0
    text = "abracadabra"
    states = langid.suffix_automaton([ord(c) for c in text])
    for word in ("abra", "cad", "abracadabra"):
        state = 0
        for c in word:
            state = states[state][ord(c)]
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (300, 301, 302, 304)").count() == 0 and kept.count() == docs.count() - 4


def greedy_phrases(sample, text):
    count, at = 0, 0
    while at < len(text):
        n = 0
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        count, at = count + 1, at + max(1, n)
    return count


def test_phrases_are_greedy_longest_matches(monkeypatch):
    samples = ("the cat sat on the mat and the dog aaa", "der hund sass auf der matte aaaa")
    model = langid.Model(tuple(zip(("en", "de"), samples, strict=True)))
    texts = ["the mat sat xx on", "a" * 1000, "a", "the cat sat on the mat " * 40, *("".join(random.choices("the catsondrhu m", k=random.randint(1, 900))) for _ in range(60))]
    for segment in (256, 16):
        monkeypatch.setattr(langid, "SEGMENT", segment)
        assert model.phrases(texts).tolist() == [[greedy_phrases(s, t) for s in samples] for t in texts]


def test_toxicity(docs, labels, none):
    found = {r["doc_id"]: r for r in toxicity.predict(docs, labels).collect()}
    held = [i for i in range(160) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i]["predicted"] == int(i % 5 == 0) for i in held)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    spans = [text[5][s["begin"] : s["end"]] for s in found[5]["spans"]]
    assert "idiot" in spans and set(spans) <= {"idiot", "scum", "you"}
    assert found[300]["predicted"] == found[301]["predicted"] == 0
    assert toxicity.predict(none, labels).count() == 0 and toxicity.predict(docs, labels.limit(0)).filter("score > 0").count() == 0
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns


def test_toxicity_finds_words_in_their_own_case():
    weights = {"lexicon": {"idiot": 9.0}, "bias": -3.0, "transition": [[0.0, 0.0], [0.0, 0.0]], "slope": 1.0, "shift": 0.0, "none": 0.0}
    for text in ("İstanbul IDIOT", "İa b Idiot zz qq yy", "ŉ idiot", "idiot"):
        score, spans = toxicity.Tagger(weights).tag(text)
        assert score > 0.9 and [text[a:b].lower() for a, b, _ in spans] == ["idiot"]


def test_toxicity_fit_takes_every_labelled_text_and_hit(spark, monkeypatch):
    same = "a" * 90
    texts = [(1, f"{same} one {same}", 1), (2, f"{same} two {same}", 0), (3, f"{same} two {same}", 0)]
    taken = []
    monkeypatch.setattr(toxicity, "fit", lambda toxic, clean: taken.append((toxic, clean)))
    toxicity.learn(spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string"), spark.createDataFrame([(i, m) for i, _, m in texts], "doc_id long, toxic int"))
    assert taken == [([texts[0][1]], [texts[1][1]])]
    monkeypatch.undo()
    sizes = []
    monkeypatch.setattr(toxicity, "lexicon", lambda toxic, clean: toxicity.features("idiot"))
    monkeypatch.setattr(np, "zeros", lambda shape, *a, old=np.zeros, **b: (sizes.append(shape), old(shape, *a, **b))[1])
    toxicity.fit([" ".join(["idiot"] * 20)], ["idiot fine"])
    assert sizes[0][0] == 21


def test_forward_backward_equals_enumeration():
    weights = {"lexicon": {"bad": 2.0, "vile": 1.0}, "bias": -1.0, "transition": [[0.3, -0.2], [-0.4, 0.5]], "slope": 1.0, "shift": 0.0, "none": 0.0}
    words = ["a", "bad", "b", "c", "vile", "d"]
    total, mass = 0.0, [0.0] * len(words)
    for code in range(2 ** len(words)):
        tags = [code >> i & 1 for i in range(len(words))]
        energy = sum(weights["lexicon"].get(w, 0) * t + weights["bias"] * t for w, t in zip(words, tags, strict=True)) + sum(weights["transition"][a][b] for a, b in zip(tags, tags[1:], strict=False))
        total += math.exp(energy)
        for i, t in enumerate(tags):
            mass[i] += t * math.exp(energy)
    _, spans = toxicity.Tagger(weights).chain(" ".join(words))
    assert [p for _, _, p in spans] == pytest.approx([mass[1] / total, mass[4] / total])


def test_line_dedup_equals_sql(spark, docs, none):
    lines = [(i, f"own line number {i} stays here\nshared line of many sites here\nshort one", "en", f"s{i % 10}", 0) for i in range(40)]
    table = spark.createDataFrame([*lines, *rows()], SCHEMA).filter("doc_id is not null").dropDuplicates(["doc_id"])
    found = sorted(tuple(r) for r in linededup.digests(table).collect())
    con = duckdb.connect()
    documents = table.toPandas()  # noqa: F841
    assert found == sorted(con.execute(oracles.OP10).fetchall())
    assert sum(r[2] for r in found) >= 39
    assert linededup.remove_boilerplate(docs).columns == docs.columns and linededup.remove_boilerplate(docs).count() == docs.count()
    assert linededup.digests(none).count() == 0


def test_url_rules_and_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    pages = spark.createDataFrame(
        [
            (1, "https://example.com/en/a", ""), (2, "http://WWW.example.com/en/a?x", ""), (3, "https://b.net/es/x", ""), (4, "https://plain.org/a", link.format("https://b.net/fr/1")),
            (5, "https://plain.org/b", link.format("/a")), (6, "https://other.org/c", "<meta http-equiv=refresh content='0;url=https://b.net/es/q'>" + link.format("https://www.example.com/en/z")),
            (7, None, None), (8, "no host", ""), (9, "https://x.com", ""), (9, "https://x.com", ""),
        ],
        "page_id long, url string, html string",
    )
    found = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in urlrules.judge(pages, URL_RULES).collect()}
    assert found == {
        1: ("example.com", "example.com/en/", "block"), 2: ("www.example.com", "www.example.com/en/", "allow"), 3: ("b.net", "net/es/", "block"), 4: ("plain.org", None, "block"),
        5: ("plain.org", None, "block"), 6: ("other.org", None, "allow"), 7: ("", None, "allow"), 8: ("", None, "allow"), 9: ("x.com", None, "allow"),
    }
    assert urlrules.judge(pages, URL_RULES).count() == 10 and urlrules.judge(pages.limit(0), URL_RULES).count() == 0


def test_components(spark):
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: root(x) for x in parent}


def brute_groups(table):
    sets, parent = {}, {}
    for i, text in table:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard_equals_brute_force(spark, docs, none):
    near = []
    for i in range(150):
        n = random.choice([4, 5, 6, 7, 8, 9, 12, 15, 20, 30, 45])
        words = [random.choice("abcdefghij") + str(random.randrange(300)) for _ in range(n)]
        for j in range(random.randint(1, 3)):
            near.append((1000 + 4 * i + j, " ".join(words)))
            at = random.randrange(len(words))
            words = [*words[:at], "edit", *words[at + random.randrange(2) :]] if random.random() < 0.5 else words[: max(1, len(words) - 1)]
    table = near + [(r[0], r[1]) for r in rows() if r[0] is not None]
    wanted = brute_groups(dict(table).items())
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()}
    assert found == wanted
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id between 200 and 250").count() == 0 and kept.filter("doc_id in (1, 300, 301, 303)").count() == 4
    assert jaccard.groups(none).count() == 0


def test_jaccard_large_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON", 4)
    monkeypatch.setattr(jaccard, "LARGE", 4)
    random_ = random.Random(21)
    word = lambda: random_.choice("abcdefghij") + str(random_.randrange(3000))
    base, passage, table = [word() for _ in range(150)], [word() for _ in range(60)], []
    for i in range(140):  # copies of one text at all distances around the threshold, in families with edits in common
        words = list(base)
        family = random.Random(i % 9)
        for at in sorted(family.sample(range(150), family.randrange(4)), reverse=True):
            words[at] = f"family{i % 9}"
        for at in sorted(random_.sample(range(150), random_.choice([0, 1, 1, 2, 2, 3, 4])), reverse=True):
            words[at : at + 1] = random_.choice([[], [word()], [words[at], word()]])
        table.append((i, " ".join(words)))
    table += [(200 + i, " ".join([word() for _ in range(20)] + passage + [word() for _ in range(random_.randrange(60))])) for i in range(60)]
    wanted = brute_groups(dict(table).items())
    frame = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    for each in (64, 0):
        monkeypatch.setattr(jaccard, "PAIRS_EACH", each)
        monkeypatch.setattr(jaccard, "ROUNDS", 3)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(frame).collect()} == wanted


def test_one_deletion_neighbourhoods_decide(spark, monkeypatch):
    table = [(2 * i + j, " ".join(f"w{i}x{k}" for k in range(14 - j))) for i in range(40) for j in (0, 1)]  # 10 and 9 shingles
    frame = spark.createDataFrame(table, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.groups(frame).collect()} == {i: i // 2 * 2 for i, _ in table}
    assert jaccard.plan(10)[1] and not jaccard.plan(1000)[1]


def test_keep_one_without_ids(spark):
    x, y, z = (sentence("en", 30) for _ in range(3))
    rows = [(5, x), (None, x), (None, y), (None, y), (6, z), (6, z), (7, z), (8, None), (8, "")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(5, x), (None, y), (None, y), (6, z), (6, z), (8, None), (8, "")], key=str)


def test_neighbours_equal_brute_force(spark):
    random_ = np.random.default_rng(3)
    x = random_.normal(size=(700, 12)).astype(np.float32)
    x[50:80] = x[0]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(800, None), (801, [0.0] * 12), (802, [None] + [1.0] * 11), (803, [float("nan")] + [1.0] * 11), (850, [1.0, 2.0])]
    found = {}
    for r in neighbours.nearest(spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0))).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    y = x.astype(np.float64)
    hits = total = 0
    assert set(found) == {i for i in range(0, 700, 50)}
    for q, got in found.items():
        score = (y[q] * y).sum(1) / (np.sqrt((y[q] * y[q]).sum()) * np.sqrt((y * y).sum(1)))
        score[q] = -2
        best = np.lexsort((np.arange(700), -np.round(score, 12)))[:5]
        hits += len({v for v, _ in got.values()} & set(best.tolist()))
        total += 5
        assert sorted(got) == [1, 2, 3, 4, 5] and all(abs(score[v] - s) < 1e-12 for v, s in got.values())
    assert hits >= 0.9 * total
    assert [found[0][k][0] for k in range(1, 6)] == [50, 51, 52, 53, 54]
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours_keep_recall_beyond_the_least_window(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "WINDOW", 8)
    monkeypatch.setattr(neighbours, "BUCKET", 50, raising=False)
    x = np.random.default_rng(4).normal(size=(3000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {(r["query_id"], r["vec_id"]) for r in neighbours.nearest(df, every=10).collect()}
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = unit[::10] @ unit.T
    near[np.arange(300), np.arange(0, 3000, 10)] = -1
    want = {(q * 10, int(v)) for q, row in enumerate(np.argsort(-near, axis=1)[:, :5]) for v in row}
    assert len(found & want) >= 0.9 * len(want)


def test_hilbert_is_a_walk():
    cells = np.array([(a, b, c) for a in range(4) for b in range(4) for c in range(4)])
    order = cells[np.argsort(neighbours.hilbert(cells, 2))]
    assert sorted(neighbours.hilbert(cells, 2).tolist()) == list(range(64)) and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_lm_counts_and_scores(docs, none):
    found = lm.predict(docs, RANKS).collect()
    counts, texts = Counter(), {}
    for r in docs.collect():
        words = [*(r["text"] or "").encode().lower().split(), 0]
        texts[r["doc_id"]] = words
        if zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 7 != 2:
            counts.update(words)
    n, v = sum(counts.values()), len(counts)
    assert len(found) == docs.count()
    for r in found:
        words = texts[r["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] <= 0
    assert lm.predict(none, RANKS).count() == 0


def test_lm_head_does_not_change_scores(docs, monkeypatch):
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["n_tokens"])
    whole = sorted(lm.predict(docs, RANKS).collect(), key=key)
    monkeypatch.setattr(lm, "HEAD", 40)
    for a, b in zip(whole, sorted(lm.predict(docs, RANKS).collect(), key=key), strict=True):
        assert key(a) == key(b) and a["n_known"] == b["n_known"]
        assert a["score"] == pytest.approx(b["score"]) and a["base_score"] == pytest.approx(b["base_score"])


def test_lm_trains_on_every_unit():
    common = sentence("en", 40)
    texts = [common + " " + sentence("de", 700), common + " " + sentence("fr", 700), "word", "", None]
    of = (np.arange(200_000) % 90).astype(np.int16)
    want = Counter()
    for text in texts:
        units = [int(of[u]) for word in lm.units_of(lm.words_of(text), RANKS) for u in word]
        want.update(zip([lm.START, *units], [*units, lm.END], strict=True))
    got = Counter()
    for lines, real in lm.training_windows(iter([texts[:2], texts[2:]]), RANKS, of):
        for line, n in zip(lines.tolist(), real.tolist(), strict=True):
            got.update(zip(line[:n], line[1 : n + 1], strict=True))
    assert got == want


def test_lm_spells_words_in_one_call_and_those_of_the_head_never(monkeypatch):
    words = [w.encode() for w in ["plain", "it's", "'s", "a\u00a0b", "\u00a0", "\u2003x\u2003", "\x1cy", "12ab", "größe", "漢字", "x" * 3000, "--", "é"]]
    one_by_one = [lm.encoding(RANKS).encode_ordinary(" " + w.decode()) for w in words]
    for few in (words, [w for w in words if w.decode().split() == [w.decode()]], words[:1], []):
        got = [(x // 2).tolist() for x in lm.units_of(few, RANKS)]
        assert got == [one_by_one[words.index(w)] for w in few]
        assert all((x % 2).tolist() == [0] * (len(x) - 1) + [1] for x in lm.units_of(few, RANKS))
    texts = [sentence("en", 300), " \n" + sentence("de", 200) + "\t", None, "", "New words"]
    of = (np.arange(200_000) % 90).astype(np.int16)
    want = list(lm.training_windows(iter([texts]), RANKS, of))
    calls, true = [], lm.encoding(RANKS)

    class Counted:
        def __getattr__(self, name):
            if name.startswith("encode"):
                calls.append(name)
            return getattr(true, name)

    lm.spellings([b"a"], RANKS)
    monkeypatch.setattr(lm, "encoding", lambda path: Counted())
    got = list(lm.training_windows(iter([texts]), RANKS, of))
    assert len(calls) == 1
    every = sorted({w for t in texts[:4] for w in lm.words_of(t)})
    head = (every, np.ones(len(every), np.int64), *lm.spellings(every, RANKS))
    calls.clear()
    assert len(list(lm.training_windows(iter([texts[:4]]), RANKS, of, head))) == 1 and not calls
    monkeypatch.undo()
    known = list(lm.training_windows(iter([texts]), RANKS, of, head))
    assert all(np.array_equal(a, b) and np.array_equal(a, c) for x, y, z in zip(want, got, known, strict=True) for a, b, c in zip(x, y, z, strict=True))


def test_lm_log_shares_equal_plain_sums():
    random_ = np.random.default_rng(4)
    w = {k: v * 20 if k == "out" else v for k, v in lm.start_weights(random_.normal(size=lm.CLASSES)).items()}
    half = lm.WIDTH // 2
    for bias in (0, 200):  # beyond what exp takes as it is
        w["bias"] = w["bias"] + np.float32(bias) * (np.arange(lm.CLASSES) % 2).astype(np.float32)
        classes, target = random_.integers(0, lm.CLASSES, (70, lm.WIDTH)), random_.integers(0, lm.CLASSES, (70, half))
        used = np.arange(lm.WIDTH) >= random_.integers(0, half, 70)[:, None]
        got = lm.log_shares(w, classes, used, target, half)
        v = {k: x.astype(np.float64) for k, x in w.items()}
        for b in range(0, 70, 7):
            x = v["embed"][classes[b]] + v["place"]
            for t in range(half, lm.WIDTH):
                near = np.exp([x[t] @ v["query"] @ (x[j] @ v["key"]) / math.sqrt(lm.DEPTH) for j in range(t + 1)]) * used[b, : t + 1]
                logits = (x[t] + near / near.sum() @ (x[: t + 1] @ v["value"])) @ v["out"] + v["bias"]
                want = logits[target[b, t - half]] - logits.max() - math.log(np.exp(logits - logits.max()).sum())
                assert got[b, t - half] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_lm_slopes_equal_differences():
    random_ = np.random.default_rng(2)
    w = {k: v.astype(np.float64) for k, v in lm.start_weights(np.zeros(lm.CLASSES)).items()}
    classes, target = random_.integers(0, lm.CLASSES, (3, lm.WIDTH)), random_.integers(0, lm.CLASSES, (3, lm.WIDTH))
    used = np.ones((3, lm.WIDTH), bool)
    slope, _ = lm.gradient(w, classes, target, used)
    for name, at in (("query", (1, 2)), ("key", (3, 4)), ("value", (0, 5)), ("out", (2, 7)), ("place", (4, 1)), ("embed", (int(classes[0, 0]), 3)), ("bias", (9,))):
        up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        numeric = (lm.gradient(up, classes, target, used)[1] - lm.gradient(down, classes, target, used)[1]) / 2e-5
        assert slope[name][at] == pytest.approx(numeric, rel=2e-3, abs=1e-6)


def test_pipeline_equals_brute_force(spark, docs, labels, tmp_path):
    """Every stage against plain Python: letters, dense forward-backward, a count of sites, all pairs, every id once."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    plain = docs.drop("score", "rank").filter("doc_id is not null").dropDuplicates(["doc_id"])
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "line_dedup", "ngram_jaccard_join", "packing"]
    left = {r["doc_id"]: (r["text"], r["source"]) for r in plain.collect() if r["text"] and any(c.isalpha() for c in r["text"])}
    weights = toxicity.learn(toxicity.training(plain.filter(F.col("doc_id").isin(list(left)))), labels)

    def toxic(text):
        held = [[weights["lexicon"][f] for f in toxicity.features(w) if f in weights["lexicon"]] for w in toxicity.words_of(text)]
        if not any(held):
            return weights["none"]
        emission = np.array([[[0.0, sum(x) + weights["bias"]] for x in held]])
        tags, _, _ = toxicity.marginals(emission, np.array(weights["transition"]), np.ones((1, len(held)), bool))
        none = sum(math.log1p(-min(max(p, 1e-12), 1 - 1e-12)) for p, x in zip(tags[0, :, 1], held, strict=True) if x)
        return 1 / (1 + math.exp(-(weights["slope"] * (math.log(-math.expm1(none)) - none) + weights["shift"])))

    left = {i: x for i, x in left.items() if toxic(x[0]) < toxicity.THRESHOLD}
    sites, first = {}, {}
    for i, (text, source) in left.items():
        for line in {x.strip(" ") for x in text.split("\n")}:
            if len(line.split(" ")) >= linededup.MIN_WORDS:
                sites.setdefault(line, set()).update([source] if source else [])
                first[line] = min(i, first.get(line, i))
    gone = {x for x, s in sites.items() if len(s) >= linededup.MIN_SITES}
    left = {i: "\n".join(x for x in text.split("\n") if x.strip(" ") not in gone or first[x.strip(" ")] == i) for i, (text, _) in left.items()}
    left = {i: left[i] for i, (_, root) in brute_groups(left.items()).items() if i == root}
    library, found = Tokenizer.from_file(VOCAB), {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    assert set(found) == set(left) and 1 in found and not set(found) & {300, 301, 304, 5, 10}
    for i, text in left.items():
        ids, end = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4"), 0
        for start, length, crc in sorted(found[i]):
            assert start == end and crc == zlib.crc32(ids[start : start + length].tobytes())
            end += length
        assert end == len(ids)
    empty = tmp_path / "empty"
    plain.limit(0).write.parquet(f"{empty}/documents.parquet")
    labels.limit(0).write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
    clash = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        clash = stage(spark, clash, str(tmp_path))
        assert clash.columns == docs.columns


def test_url_aliases_equal_recursive_sql(spark):
    """Chains, cycles, a hub, and components with blocked and allowed members, against reachability in SQL."""
    random_ = random.Random(31)
    names = [f"https://p{i}.org/a{i}" for i in range(160)]
    names += [f"https://b{i}.net/{random_.choice(['es', 'fr', 'it'])}/{i}" for i in range(30)] + [f"https://s{i}.com/{i}" for i in range(12)]
    links = [(names[i], names[i + 1]) for i in range(20)] + [(names[30 + i], names[30 + (i + 1) % 9]) for i in range(9)] + [(names[i], names[50]) for i in range(51, 90)]
    links += [(random_.choice(names), random_.choice(names)) for _ in range(70)]
    target = {}
    for u, v in links:
        target.setdefault(u, v)
    more = [(u, v) for u, v in links if target[u] != v]
    pages = [(i, u, f'<link rel="canonical" href="{target[u]}">' if u in target else "") for i, u in enumerate(names)]
    found = {r["page_id"]: r["verdict"] for r in urlrules.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES, spark.createDataFrame(more, "u string, v string")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE p (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO p VALUES (?, ?, ?)", pages)
    con.execute("CREATE TABLE l (u VARCHAR, v VARCHAR)")
    con.executemany("INSERT INTO l VALUES (?, ?)", links)
    wanted = con.execute("""
        WITH RECURSIVE e AS (SELECT u, v FROM l UNION SELECT v, u FROM l UNION SELECT url, url FROM p),
        r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
        own AS (SELECT url, CASE WHEN contains(url, '.com/') THEN 'allow' WHEN regexp_matches(url, '[.]net/(es|fr)/') THEN 'block' END AS own FROM p),
        s AS (SELECT r.u AS url, bool_or(own = 'block') AND NOT coalesce(bool_or(own = 'allow'), false) AS bad FROM r JOIN own ON own.url = r.v GROUP BY 1)
        SELECT page_id, coalesce(own, CASE WHEN bad THEN 'block' ELSE 'allow' END) FROM p JOIN own USING (url) JOIN s USING (url)""").fetchall()
    assert found == dict(wanted) and {"allow", "block"} == set(found.values())
    extra = spark.createDataFrame([(1, "https://x.net/es/", None, "x")], "page_id long, url string, html string, verdict string")
    assert urlrules.judge(extra, URL_RULES).first()["verdict"] == "block"


def test_operators_ignore_columns_of_other_names(docs):
    clash = docs.select("doc_id", "text", "lang", "source", F.lit(1).alias("ids"), F.lit(2).alias("sequence_id"), F.lit(3).alias("media"), F.lit(4).alias("u"))
    assert packing.pack(clash, VOCAB).select("sequence_id").distinct().count() >= 1
    assert bpe.round_trip(clash, RANKS).count() == media.digests(clash).count() == docs.count()
