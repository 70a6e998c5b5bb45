"""The training-data operators on small tables: brute force, round trips, held-out accuracy and odd input."""

import hashlib
import io
import random
import struct
import textwrap
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thresher.llm import decontaminate, langid, licences, mixing, registry, rollups, simhash, tiff, tokens, toxicity, warc
from thresher.llm._common import held_out, join_hot, shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(3)
EN, FR = "the of and thing there with this that are with ation".split(), "le la de une pour avec dans été eaux mentre oiseau".split()


def prose(words, n):
    return " ".join(R.choice(words) + R.choice(["", "s", "er", "on"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    out = [(k, prose(EN if k % 2 else FR, 5 + 7 * (k % 30)), "en" if k % 2 else "fr", f"s{k % 3}", 0) for k in range(240)]
    base = prose(EN, 300)
    out += [(1000 + k, base + f" x{k}" * (k % 3), "en", "hot", 0) for k in range(40)]
    out += [(2000, None, "en", None, None), (2001, "", None, "s0", 0), (2002, "  \t\n", "fr", "s1", 0), (None, "a b", None, None, None), (3, out[3][1], "en", "s0", 0), (2003, "!!! 123", None, "s1", 0), (2004, prose(EN, 20000), "en", "s2", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1


def test_language(docs, empty, rows):
    model = langid.fit(docs.where("doc_id % 5 <> 0"))
    got = langid.predict(docs.withColumn("score", F.lit("clash")), model)
    assert got.columns.count("score") == 1 and got.count() == len(rows)
    seen = {r["doc_id"]: r for r in got.collect()}
    marked = [r for r in rows if r[0] is not None and r[0] < 240 and len(r[1] or "") > 60]
    assert sum(seen[r[0]]["lang_pred"] == r[2] for r in marked) > 0.97 * len(marked)
    for k in (2000, 2001, 2002, 2003):
        assert (seen[k]["lang_pred"], seen[k]["score"], seen[k]["lang_rejected"]) == ("und", 0.0, True)
    assert all(0 <= r["score"] <= 1 for r in seen.values())
    none = langid.predict(docs, langid.fit(empty)).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"] and langid.predict(empty, model).count() == 0


def test_language_rejects_foreign_script(spark, docs):
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, "это совсем другой язык " * 30, None, None, 0)], DOCS)
    assert langid.predict(odd, model).first()["lang_rejected"]


def test_language_rejects_unlearned_latin_script(spark):
    r = random.Random(5)
    make = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))
    known = [("aa", "etaoinshr"), ("bb", "eaisulvqr")]
    sizes = [1] * 40 + [60] * 60 + [1500] * 5  # short texts have low cosines; the longest class has too few texts
    learn = [(k, make(letters, n), lang, None, 0) for lang, letters in known for k, n in enumerate(sizes)]
    model = langid.fit(spark.createDataFrame(learn, DOCS))
    own = [(k, make(letters, 60), lang, None, 0) for lang, letters in known for k in range(30)]
    other = [(k, make("etaocdfgjk", 60), None, None, 0) for k in range(30)]
    rejected = lambda x: sum(r["lang_rejected"] for r in langid.predict(spark.createDataFrame(x, DOCS), model).collect())
    assert rejected(other) == 30 and rejected(own) == 0 and rejected(learn) == 0
    assert langid._floors([(3, 0.2)] * 20 + [(6, 0.8)] * 20 + [(7, 0.1)] * 3, model.config) == pytest.approx([0.06] * 5 + [0.24] * 3)


# 2


def test_tokens_round_trip(spark, docs, empty, rows):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    t = Tokenizer.from_file(path)
    want, at = [], 0
    for i, x in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(x, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    for width in (2, 4):
        got = tokens.encode(docs, tokens.TokenConfig(path, width=width), ids=True).collect()
        assert Counter((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(want)
    assert tokens.encode(empty, tokens.TokenConfig(path)).count() == 0


def test_one_document_by_offset(spark, docs):
    path = shared_dir(spark, "t")
    config = tokens.TokenConfig(registry.tokenizer_path())
    tokens.write_tokens(docs, path, config)
    shard = spark.read.parquet(f"{path}/manifest").orderBy("part", "seq").first()
    whole = {r["doc_id"]: r["ids"] for r in tokens.read_tokens(spark, path).collect()}
    assert tokens.read_document(path, shard["file"], 1).tolist() == whole[0]


def test_encoder_equals_the_library():
    e = tokens.encoder(registry.tokenizer_path())
    for s in ["It's  x", " lead", "tail ", "a\n b", "Ünï çödé", "日本 語", "a<|endoftext|>b", "x \t y", "don't\n\n\nstop 12 3", "²½ a", "a b", ""]:
        assert e(s) == e._whole(s), s


# 3


def _components(fps, ids, radius=3):
    label = {k: k for k in range(len(fps))}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    least = {}
    for k in range(len(fps)):
        if ids[k] is not None:
            least[root(k)] = min(least.get(root(k), 1 << 64), ids[k])
    return [least.get(root(k)) for k in range(len(fps))]


def test_simhash_against_all_pairs(docs, empty, rows):
    fps = [simhash.fingerprint(r[1] or "") for r in rows]
    want = Counter(zip([r[0] for r in rows], [f"{f:016x}" for f in fps], _components(fps, [r[0] for r in rows]), strict=True))
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("leaf", [4, 64])
def test_local_links_on_dense_balls(leaf):
    rng = np.random.default_rng(1)
    x = [int(v) for v in rng.integers(0, 1 << 63, 60)]
    for c in x[:3]:
        for _ in range(150):
            y = c
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                y ^= 1 << int(b)
            x.append(y)
    fps = np.unique(np.array(x, np.uint64))
    a, b = simhash.local_links(fps, np.ones(len(fps), bool), 3, leaf)
    label = {int(f): int(f) for f in fps} | {int(i): int(j) for i, j in zip(a, b, strict=True)}
    want = _components([int(f) for f in fps], [int(f) for f in fps])
    assert [label[int(f)] for f in fps] == want


def test_dealing_loses_no_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    near = base.copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    x = np.concatenate([base, near])
    met = np.zeros(400, bool)
    for shift in (0, 32):
        rows, shard, home = simhash.DealTree(np.sort(base), shift, 16, 1).deal(x)
        assert Counter(rows[home]) == Counter(range(800))
        lives = {int(r): int(s) for r, s in zip(rows[home], shard[home], strict=True)}
        asks = {(int(r), int(s)) for r, s in zip(rows, shard, strict=True)}
        met |= np.array([(k + 400, lives[k]) in asks for k in range(400)])
    assert met.all()


def test_overfull_shards_and_hot_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = [int(v) for v in rng.integers(0, 1 << 62, 150)]
    for c in x[:4]:
        for _ in range(60):
            y = c
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                y ^= 1 << int(b)
            x.append(y)
    fps = sorted(set(x))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in fps], "fp long")
    links = simhash.links(df, simhash.SimHashConfig(shard_rows=8, sample=40)).collect()
    label = {f: f for f in map(signed, fps)}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    groups = Counter(tuple(sorted(signed(v) for v in fps if root(signed(v)) == r)) for r in {root(signed(v)) for v in fps})
    want = _components(fps, fps)
    assert groups == Counter(tuple(sorted(signed(v) for v, w in zip(fps, want, strict=True) if w == r)) for r in set(want))
    # The ways beyond the broadcast bound: hot keys by broadcast, the rest by shuffle.
    table = spark.createDataFrame([(k, 9000 if k == 1 else 1, k * k) for k in range(50)], "k int, n int, v int")
    rows = spark.createDataFrame([(1,)] * 9000 + [(k,) for k in range(60)], "k int")
    for how, n in (("inner", 9050), ("left", 9060)):
        met = join_hot(rows, table, "k", "n", 9060, how, most=10)
        assert met.count() == n and met.where("v IS NULL").count() == n - 9050 and met.where("k = 1 AND v = 1").count() == 9001


def test_deduplicate_null_ids_and_repeats(spark, empty):
    a, b = prose(EN, 40), prose(FR, 40)
    data = [(None, a, "x"), (None, a, "x"), (4, a, "x"), (4, a, "x"), (4, a, "y"), (None, b, "x"), (None, b, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, component_id string")
    got = simhash.deduplicate(df).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(4, a), (None, b)], key=str)
    assert simhash.deduplicate(empty).count() == 0


def test_deduplicate(docs, rows):
    kept = simhash.deduplicate(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    want = {c for c in _components([simhash.fingerprint(r[1] or "") for r in rows], [r[0] for r in rows])}
    assert sorted(i for i in ids if i is not None) == sorted(c for c in want if c is not None) and kept.columns == docs.columns


# 4


def test_warc(spark):
    big = "é" * 600
    pages = [(1, "http://a/x?y", big), (2, None, big), (3, "http://b/\r\nz", big), (4, "u", "small"), (5, "u", "small"), (6, None, None), (None, "n", big), (3, "http://b/\r\nz", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc.archive_pages(df, payloads=True).collect()
    assert len(got) == len(pages)
    by = {r["page_id"]: r for r in got}
    assert by[1]["response"]["warc_type"] == by[2]["response"]["warc_type"] == by[None]["response"]["warc_type"] == "revisit"
    assert by[1]["refers_to"] == 3 and by[1]["response"]["payload_bytes"] == 1200 and by[1]["response"]["payload_digest"] == by[3]["response"]["payload_digest"]
    assert by[4]["response"]["warc_type"] == by[5]["response"]["warc_type"] == "response" and by[4]["refers_to"] is None
    assert bytes(by[3]["response"]["payload"]).decode() == big and by[6]["response"]["payload_bytes"] == 0
    assert all(r["n_requests"] >= 1 and r["n_metadata"] >= 1 for r in got)
    assert warc.archive_pages(df.where("false")).count() == 0


def test_warc_captures_of_repeated_pages(spark):
    big = "x" * 1500
    pages = [(7, "http://c/", big), (7, "http://d/", big), (None, "http://e/", "s"), (None, "http://f/", "s"), (1, "http://g/", big), (8, "http://h/", "small")] + [(8, "http://h/", "small")] * 2 + [(None, "n", "z" * 1200)] * 2
    got = warc.archive_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), payloads=True).collect()
    assert Counter((r["page_id"], r["request"]["target_uri"], r["response"]["target_uri"]) for r in got) == Counter((i, u, u) for i, u, _ in pages)
    assert len({r["capture"] for r in got}) == len(pages) and all(r["n_requests"] == r["n_metadata"] == 1 for r in got)
    kinds = {(r["page_id"], r["response"]["target_uri"]): (r["response"]["warc_type"], r["refers_to"]) for r in got}
    assert kinds[7, "http://c/"] == kinds[7, "http://d/"] == ("response", None) and kinds[1, "http://g/"] == ("revisit", 7)


def test_warc_of_others(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2;x=y\r\nde\r\n0\r\n\r\n"
    ask = b"GET / HTTP/1.1\r\n\r\n"
    tie = lambda *ids: [("WARC-Concurrent-To", f"<{i}>") for i in ids]
    good = warc.record("response", "urn:r1", http, "d", "application/http;msgtype=response", tie("urn:q1", "urn:m1"))
    good += warc.record("request", "urn:q1", ask, "d", "application/http;msgtype=request") + warc.record("metadata", "urn:m1", b"a: 1\r\n", "d", "application/warc-fields")
    good += warc.record("response", "urn:r2", http, "d", "application/http;msgtype=response") + warc.record("request", "urn:q2", ask, "d", "application/http;msgtype=request", tie("urn:gone", "urn:r2"))
    good += warc.record("metadata", "urn:m2", b"a: 2\r\n", "d", "application/warc-fields", tie("urn:q2"))
    files = {"good.warc": good, "cut.warc.gz": warc.member(good, 6)[:-30], "odd.warc": good.replace(b"Content-Length: 18", b"Content-Length: many"), "junk.warc": b"nothing\n"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    paths = spark.createDataFrame([(f"file://{tmp_path}/{name}",) for name in files], "file string")
    rows = warc.read_paths(spark, paths).collect()
    assert Counter(r["target_uri"].rpartition("/")[2] for r in rows if r["warc_type"] == "error") == Counter(["cut.warc.gz", "odd.warc", "junk.warc"])
    one = warc.read_paths(spark, paths.where("file LIKE '%good.warc'"))
    got = {r["capture"]: r for r in warc.assemble(one).collect()}
    assert set(got) == {"urn:r1", "urn:r2"} and bytes(got["urn:r1"]["response"]["payload"]) == b"abcde"
    assert [(got[c]["request"]["record_id"], got[c]["metadata"]["record_id"]) for c in ("urn:r1", "urn:r2")] == [("urn:q1", "urn:m1"), ("urn:q2", "urn:m2")]


def test_warc_parser_and_orphans(spark):
    one = warc.record("warcinfo", "urn:i", b"x: y\r\n", "d", "application/warc-fields")
    for data in (one * 3, warc.member(one, 6) * 3, warc.member(one * 3, 6)):
        assert [b for _, b in warc.parse(io.BytesIO(data))] == [b"x: y\r\n"] * 3
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(one[:-10])))
    rows = [("request", "q", "gone", None, None, None, None, None, None, None, None), ("metadata", "m", "q", None, None, None, None, "f", None, None, None)]
    got = warc.assemble(spark.createDataFrame(rows, warc.RECORD_TYPE)).collect()
    assert len(got) == 1 and got[0]["capture"] == "gone" and got[0]["response"] is None and got[0]["metadata"]["record_id"] == "m"


# 5


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, 16])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trip(compression, predictor, tile, order):
    rng = np.random.default_rng(4)
    images = [rng.integers(0, 4, (37, 50), np.uint8), np.zeros((5, 3), np.uint8), rng.integers(0, 256, (20, 70, 3), np.uint8), rng.integers(0, 256, (90, 90), np.uint8)]
    pages = tiff.decode(tiff.encode([(x, f"p{k}") for k, x in enumerate(images)], compression, predictor, 7, tile, order))
    assert [p.description for p in pages] == ["p0", "p1", "p2", "p3"]
    assert all(p.pixels == x.tobytes() and (p.height, p.width) == x.shape[:2] for p, x in zip(pages, images, strict=True))


def _file(directories, order="<", big=False):
    """A TIFF of directories, each (tags, stored strips); offsets and counts are filled in."""
    head = struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)
    out = bytearray((b"II" if order == "<" else b"MM") + head)
    link, word = len(out) - (8 if big else 4), "Q" if big else "I"
    for tags, strips in directories:
        offsets = []
        for x in strips:
            offsets.append(len(out))
            out += x
        tags = {**tags, 273: (16 if big else 4, offsets), 279: (4, [len(x) for x in strips])}
        entries = b""
        for tag, (kind, values) in sorted(tags.items()):
            raw = struct.pack(order + {3: "H", 4: "I", 16: "Q"}[kind] * len(values), *values)
            if len(raw) > struct.calcsize(order + word):
                at = len(out)
                out += raw
                raw = struct.pack(order + word, at)
            entries += struct.pack(order + "HH" + word, tag, kind, len(values)) + raw.ljust(struct.calcsize(order + word), b"\0")
        struct.pack_into(order + word, out, link, len(out))
        out += struct.pack(order + ("Q" if big else "H"), len(tags)) + entries
        link = len(out)
        out += bytes(8 if big else 4)
    return bytes(out)


def _tags(w, h, s=1, bits=8, **more):
    return {256: (4, [w]), 257: (4, [h]), 258: (3, [bits] * s), 277: (3, [s])} | {{"compression": 259, "predictor": 317, "planar": 284, "fill": 266}[k]: (3, [v]) for k, v in more.items()}


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_tiff_other_forms(order, big):
    rng = np.random.default_rng(6)
    wide, rgb, bits = rng.integers(0, 1 << 16, (5, 7), np.uint16), rng.integers(0, 256, (4, 6, 3), np.uint8), rng.integers(0, 4, (3, 9), np.uint8)
    real = rng.normal(size=(4, 5)).astype(np.float32)
    steps = np.concatenate([wide[:, :1], wide[:, 1:] - wide[:, :-1]], axis=1).astype(order + "u2")
    packed = np.packbits(np.concatenate([(bits[:, :, None] >> np.array([1, 0])) & 1], axis=2).reshape(3, 18), axis=1).tobytes()
    planes = real.view("<u4").view(np.uint8).reshape(4, 5, 4)[:, :, ::-1].transpose(0, 2, 1).reshape(4, 20)
    diff = np.concatenate([planes[:, :1], planes[:, 1:] - planes[:, :-1]], axis=1)
    got = tiff.decode(_file([
        (_tags(7, 5, bits=16, compression=8, predictor=2), [zlib.compress(steps.tobytes())]),
        (_tags(6, 4, 3, planar=2), [rgb[:, :, k].tobytes() for k in range(3)]),
        (_tags(9, 3, bits=2, fill=2), [packed.translate(tiff._FLIP)]),
        (_tags(5, 4, bits=32, compression=8, predictor=3), [zlib.compress(diff.tobytes())]),
    ], order, big))
    assert [p.error for p in got] == [None] * 4 and [p.bits for p in got] == [16, 8, 2, 32]
    assert [p.pixels for p in got] == [wide.astype("<u2").tobytes(), rgb.tobytes(), bits.tobytes(), real.tobytes()]


def test_tiff_errors_stay_in_their_directory():
    one = (_tags(4, 2), [b"abcdefgh"])
    mixed = _file([one, (_tags(4, 2, compression=7), [b"x"]), (_tags(1 << 31, 1 << 20), [b"x"]), (_tags(1 << 16, 1 << 16, compression=8), [zlib.compress(b"x")]), (_tags(4, 2), [b"short"]), (_tags(0, 2), [b""]), one])
    rows = tiff.page_rows(mixed)
    assert [r["page"] for r in rows] == list(range(7)) and [r["error"] is None for r in rows] == [True] + [False] * 5 + [True]
    assert rows[0]["pixels"] == rows[6]["pixels"] == b"abcdefgh" and "compression 7" in rows[1]["error"]
    cut = _file([one, one])
    broken = cut[: len(cut) - 30]
    assert [(r["page"], r["error"] is None) for r in tiff.page_rows(broken)] == [(0, True), (1, False)]
    assert [r["page"] for r in tiff.page_rows(b"II" + struct.pack("<HI", 42, 99))] == [-1] and tiff.page_rows(None) == []


def test_tiff_query_against_brute_force(spark, rows, tmp_path):
    rows = [*rows, (9000, "long " * 60_000, None, None, 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op5_tiff(spark, str(tmp_path)).collect()
    want, forms = Counter(), Counter()
    for i, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        media = tiff.text_media(t or "")
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest()] += 1
    for r in got:
        forms[tuple(r["feature"].split(":")[0].split("x")[1:3])] += 1
    assert Counter(tuple(r)[:7] for r in got) == want and len(forms) >= 5
    assert max(int(r["feature"].split(":")[0].split("x")[3]) for r in got) > 1
    by_text = {}
    for i, t, *_ in rows:
        by_text.setdefault(t or "", set()).add(next(r["feature"] for r in got if r["doc_id"] == i and r["n_bytes"] == len((t or "").encode())))
    assert all(len(v) == 1 for v in by_text.values())


def test_tiff_column(spark, docs):
    good = tiff.encode([(np.ones((2, 2), np.uint8), "a"), (np.zeros((1, 4), np.uint8), "b")])
    df = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"junk")), (4, bytearray(good[:40]))], "k int, media binary").withColumn("tiff", F.lit(0))
    got = [(r["k"], r["tiff"]["page"], r["tiff"]["error"] is None) for r in tiff.pages(df).collect()]
    assert sorted(got) == [(1, 0, True), (1, 1, True), (3, -1, False), (4, -1, False)]
    rows = tiff.decoded(tiff.from_text(docs)).select("text", F.col("pages.pixels").alias("pixels")).collect()
    for r in rows:
        raw = (r["text"] or "").encode()
        assert b"".join(map(bytes, r["pixels"])) == raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


# 6


def test_mix(docs, empty, rows):
    got = mixing.plan(docs).withColumn("taken", F.col("size") * F.size("draws")).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    goal = dict(zip(names, mixing.targets([sizes[n] for n in names]), strict=True))
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
    largest = {n: max(r["size"] for r in got if r["source"] == n) for n in names}
    assert all(abs(taken[n] - goal[n]) <= largest[n] + 1 for n in names)
    again = mixing.plan(docs.repartition(7)).collect()
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["source"] or "", r["size"])
    assert [r["draws"] for r in sorted(again, key=key)] == [r["draws"] for r in sorted(got, key=key)]
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    mixed = mixing.mix(docs).groupBy("doc_id", "text").count().collect()
    drawn = Counter()
    for r in got:
        drawn[r["doc_id"]] += len(r["draws"])
    assert Counter({r["doc_id"]: r["count"] for r in mixed if r["doc_id"] is not None}) == Counter({k: v for k, v in drawn.items() if v and k is not None})


def _fill(sizes):
    """Targets by bisecting for the level at which the shares use up 150 % of all words."""
    goal, lo, hi = 1.5 * sum(sizes), 0.0, 1e12
    weigh = lambda x: [min(2.0 * n, x * (5, 2, 1)[k % 3]) for k, n in enumerate(sizes)]
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(weigh(mid)) < goal else (lo, mid)
    return weigh(hi)


@pytest.mark.parametrize("config", [mixing.MixConfig(), mixing.MixConfig(shards=5, groups=3, broadcast_rows=4, block_rows=4, part_words=500)])
def test_mix_of_many_sources_and_copies(spark, config):
    r = random.Random(6)
    data = [(k, prose(EN, r.randint(0, 60)), None, f"s{r.randint(0, 12):02d}" if k % 3 else "hot", k) for k in range(700)]
    data += [(5000, "one two three", None, "copies", 7)] * 400 + [(None, "", None, None, 0)] * 30 + [(None, "w " * 5, None, None, 0)] * 20
    df = spark.createDataFrame(data, DOCS).repartition(6).withColumn("mix_shard", F.lit("clash"))
    got = mixing.plan(df, config=config).collect()
    assert len(got) == len(data)
    sizes, largest = Counter(), Counter()
    for _, t, _, src, _ in data:
        n = len(t.split())
        sizes[src] += n
        largest[src] = max(largest[src], n)
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    goal = dict(zip(names, _fill([sizes[n] for n in names]), strict=True))
    taken, shards = Counter(), Counter()
    for x in got:
        taken[x["source"]] += x["size"] * len(x["draws"])
        shards.update(d["shard"] for d in x["draws"])
        assert len(x["draws"]) <= 2 and len({d["pass"] for d in x["draws"]}) == len(x["draws"])
        assert x["source_size"] == sizes[x["source"]] and x["target"] == pytest.approx(goal[x["source"]], abs=1e-3)
    assert all(abs(taken[n] - goal[n]) <= largest[n] + 1 for n in names)
    assert set(shards) == set(range(config.shards))
    key = lambda x: (x["doc_id"] or -1, x["source"] or "", x["size"], str(x["draws"]))
    assert sorted(map(key, mixing.plan(df.repartition(3), config=config).collect())) == sorted(map(key, got))
    mixed = mixing.mix(df, config=config)
    places = Counter((x["doc_id"], d["shard"], d["place"]) for x in got for d in x["draws"])
    assert Counter((x["doc_id"], x["mix_shard"], x["mix_place"]) for x in mixed.collect()) == places
    parts = max(1, -(-sum(taken.values()) // (config.shards * config.part_words)))
    assert mixed.rdd.getNumPartitions() == config.shards * parts


def test_targets_and_split():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([]) == [] and mixing.targets([0, 10]) == pytest.approx([0, 15])
    q = np.array([30, 5, 0])
    out = mixing.split(q, 7, np.random.default_rng(1))
    assert (out.sum(0) == q).all() and out.sum(1).max() - out.sum(1).min() <= 2


# 7


def test_licences(spark, docs):
    model = licences.fit(docs)
    lines = ["Released under the MIT License.", "xx yy Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", *licences.DECOYS, "license", None, "", "the driver's license"]
    df = spark.createDataFrame([(k, "some words here\n" + x if x else x, "clash") for k, x in enumerate(lines)], "doc_id long, text string, family string")
    got = {r["doc_id"]: (r["family"], r["paragraph"]) for r in licences.scan(df, model).collect()}
    assert got == {0: ("MIT", 1), 1: ("Apache-2.0", 1), 2: ("CC-BY-NC", 1), 3: ("GPL", 1)}
    for family, pairs in ((f, set(p)) for f, _, p in model.templates):
        touched = sum(bool(set(x.split()) & set(model.triggers)) for x in pairs)
        assert touched > (1 - model.config.coverage) * len(pairs), family
    plan = licences.scan(df, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("width", [1, 30, 72])
def test_licences_wrapped(spark, docs, width):
    model = licences.fit(docs)
    named = {k: next(x for x in licences.TEMPLATES if x[1].startswith(start)) for k, start in (("bsd", "Redistribution"), ("gpl", "This program is free"), ("isc", "Permission to use"), ("nc", "This work is licensed under a Creative Commons Attribution-NonCommercial"))}
    wrap = lambda t: textwrap.wrap(t, width, break_long_words=False, break_on_hyphens=False)
    rows = [(k, "\n * ".join(["/* Copyright 2020", "", *wrap(t), "", "words of another kind"])) for k, (_, t) in enumerate(named.values())]
    lone = [(100, "this work\n\nis licensed\n\nunder the MIT\n\nLicense"), (101, "some words\nReleased under the MIT License.\nother words\nand more"), (102, "the driver showed\na license and\nregistration")]
    got = Counter((r["doc_id"], r["family"]) for r in licences.scan(spark.createDataFrame(rows + lone, "doc_id long, text string"), model).collect())
    assert got == Counter([*((k, f) for k, (f, _) in enumerate(named.values())), (101, "MIT")])


def test_licences_whole_wrapped_and_reworded(spark, docs, tmp_path):
    model = licences.fit(docs)
    r = random.Random(2)
    wrap = lambda t, n: textwrap.wrap(t, n, break_long_words=False, break_on_hyphens=False)

    def reword(text):
        w = text.split()
        for _ in range(len(w) // 15):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([[], ["notably"], [w[k], "hereby"]])
        return " ".join(w)

    data, want = [], []
    for k, (family, t) in enumerate(licences.TEMPLATES):
        data += [(k, "\n".join(["some lines", "", *wrap(t, 40), "", prose(EN, 50)])), (1000 + k, prose(EN, 60) + "\n" + "\n# ".join(wrap(reword(t), 60)) + "\n" + prose(EN, 60))]
        want += [(k, family), (1000 + k, family)]
    data += [(5000 + k, prose(EN, 200) + f"\n{d}\n" + prose(EN, 30)) for k, d in enumerate(licences.DECOYS)]
    data += [(None, "x\n\nReleased under the MIT License."), (None, "nothing"), (7000, "a " * 40_000 + licences.TEMPLATES[0][1] + " b" * 40_000), (7001, None), (7002, "")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("family", F.lit("clash"))
    found = licences.scan(df, model).collect()
    got = {(x["doc_id"], x["family"]) for x in found}
    whole, edited = [x in got for x in want[::2]], [x in got for x in want[1::2]]
    assert all(whole) and sum(edited) >= 0.9 * len(edited), (sum(whole), sum(edited), len(edited))
    assert {x["doc_id"] for x in found} <= {None, 7000, *range(2000)} and (None, "MIT") in got and (7000, "MIT") in got
    assert {x["paragraph"] for x in found if x["doc_id"] in range(1000)} == {2} and {x["paragraph"] for x in found if x["doc_id"] == 7000} == {0}
    # Calibration: the stated probability is near the share that is right.
    truth = dict(want)
    judged = [(x["probability"], truth[x["doc_id"]] == x["family"]) for x in found if x["doc_id"] in truth]
    assert abs(np.mean([p for p, _ in judged]) - np.mean([ok for _, ok in judged])) < 0.1
    assert licences.scan(df.where("false"), licences.fit(df.where("false"))).count() == 0
    df.drop("family").withColumn("family", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {x["doc_id"]: x for x in registry.op7_licences(spark, str(tmp_path)).collect()}
    assert len(rows) == len({d for d, _ in data}) and rows[None]["families"] == "MIT" and rows[7002]["families"] is None and rows[7002]["paragraphs"] == 0


def test_licences_underscores_and_sample(spark, docs):
    model = licences.fit(docs)
    odd = spark.createDataFrame([(1, "xx Released_under_the_MIT_License_ yy")], "doc_id long, text string")
    assert [r["family"] for r in licences.scan(odd, model).collect()] == ["MIT"]
    few, many = (licences.fit(docs, config=licences.LicenceConfig(corpus_rows=n)) for n in (1, 200))
    assert few.weights.shape == many.weights.shape and not np.allclose(few.weights, many.weights)  # a small table gives its rows


# 8


def test_leaks_equal_brute_force(spark):
    r = random.Random(9)
    common = [f"w{k}" for k in range(30)]
    items = {k: [r.choice(common) for _ in range(n)] for k, n in enumerate([3, 4, 8, 15, 30, 40, 55])}
    texts = {}
    for k, ws in items.items():
        for every in (2, 3, 4, 5, 6):
            texts[k, every, "replaced"] = [f"x{i}" if i % every == every - 1 else w for i, w in enumerate(ws)]
            texts[k, every, "dropped"] = [w for i, w in enumerate(ws) if i % every != every - 1]
            texts[k, every, "padded"] = [x for i, w in enumerate(ws) for x in ([w, f"x{i}"] if i % every == every - 1 else [w])]
        texts[k, 1, "padded"] = [x for i, w in enumerate(ws) for x in (w, f"x{i}")][:-1]
    docs = [(k, " ".join([r.choice(common) for _ in range(40)] + ws + [r.choice(common) for _ in range(40)])) for k, ws in enumerate(texts.values())]
    c = decontaminate.AlignConfig()
    number = {w: k for k, w in enumerate(sorted({w for _, t in docs for w in t.split()}))}
    arr = lambda ws: np.array([number[w] for w in ws])
    score = {(d, k): decontaminate.align(arr(ws), arr(t.split()), c)[0] for d, t in docs for k, ws in items.items()}
    want = {x: n for x, n in score.items() if n >= c.least * c.match * len(items[x[1]])}
    bench = spark.createDataFrame([(k, " ".join(ws)) for k, ws in items.items()], "item_id long, text string")
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(x["doc_id"], x["item_id"]): x["score"] for x in got} == want
    at = {x: d for d, x in enumerate(texts)}
    assert all((at[k, e, "replaced"], k) in want for k in (4, 5, 6) for e in (4, 5, 6)) and (at[4, 3, "replaced"], 4) in want


@pytest.mark.parametrize("swap", [6, 5])
def test_leaks_recall_of_edited_copies(spark, swap):
    r = random.Random(swap)
    vocab = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmnrst"]
    items = [[r.choice(vocab) for _ in range(r.randint(20, 60))] for _ in range(40)]
    edit = lambda ws: [x for k, w in enumerate(ws) for x in ([] if k % (2 * swap) == 3 else ["zz"] if k % (2 * swap) == 9 else [w])]
    noise = lambda: [r.choice(vocab) for _ in range(80)]
    docs = [(k, " ".join(noise() + edit(ws) + noise())) for k, ws in enumerate(items)] + [(100 + k, " ".join(noise() + noise())) for k in range(40)]
    bench = spark.createDataFrame([(f"item-{k}", " ".join(ws)) for k, ws in enumerate(items)], "item_id string, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(k, f"item-{k}") for k in range(40)}


def test_leaks(spark, rows, docs):
    # Corpus words come and go in every passage: items need words of their own to be rare.
    item = lambda k: " ".join(f"{R.choice(EN)}{R.choice('abcdefghij')}{R.choice('klmnop')}{k}" for _ in range(30))
    items = [item(k) for k in range(6)] + [None, "", "one"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    words = items[1].split()
    edited = " ".join("zzz" if k % 6 == 5 else w for k, w in enumerate(words))
    planted = [(9000, prose(EN, 50) + " " + items[0] + " " + prose(EN, 50), "en", "x", 0), (9001, prose(EN, 500) + "," + edited.upper() + ".", "en", "x", 0), (9002, " ".join(words[:6]) + prose(EN, 20), "en", "x", 0)]
    df = docs.unionByName(spark.createDataFrame(planted, DOCS)).withColumn("score", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(df, bench).collect()}
    assert set(got) == {(9000, 0), (9001, 1)}
    assert got[9000, 0]["normalised"] == 1.0 and (got[9000, 0]["doc_start"], got[9000, 0]["doc_end"]) == (50, 80)
    small = decontaminate.AlignConfig(group_seeds=40)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, bench, config=small).collect()} == set(got)
    assert decontaminate.leaks(df, bench.where("false")).count() == 0
    assert decontaminate.decontaminate(df, bench, config=small).count() == df.count() - 2
    assert decontaminate.decontaminate(df, bench.where("false")).count() == df.count() and decontaminate.leaks(df.where("false"), bench).count() == 0
    kept = decontaminate.decontaminate(df, bench)
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString().split("Scan ExistingRDD")[0].replace("BroadcastExchange", "")
    assert kept.count() == df.count() - 2 and kept.columns == df.columns


def test_alignment_against_a_plain_table():
    c = decontaminate.AlignConfig()
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = rng.integers(1, 5, rng.integers(1, 15)), rng.integers(1, 5, rng.integers(1, 15))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (c.match if a[i - 1] == b[j - 1] else c.mismatch), h[i - 1, j] + c.gap, h[i, j - 1] + c.gap)
        assert decontaminate.align(a, b, c)[0] == h.max()
        s, i, j, x, y = decontaminate.align_spans(a, b, c)
        assert decontaminate.align(a[i:j], b[x:y], c)[0] == s


# 9


def test_toxicity(spark, empty):
    bad = ["vileword", "nastyterm", "badname"]
    data, labels = [], []
    for k in range(1500):
        toxic = k % 6 == 0
        w = prose(EN, 30).split()
        if toxic:
            w[5], w[9] = R.choice(bad), R.choice(bad)
        data.append((k, " ".join(w), "en", "s", 0))
        if k % 5 < 3:
            labels.append((k, int(toxic)))
    data += [(5000, None, None, None, None), (5001, "", None, None, 0)]
    df, lab = spark.createDataFrame(data, DOCS), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    may = ~held_out("doc_id")
    model = toxicity.fit(df.where(may), lab.where(may))
    got = {r["doc_id"]: r for r in toxicity.predict(df.where(held_out("doc_id") | (F.col("doc_id") >= 5000)).withColumn("score", F.lit("clash")), model).collect()}
    test = [(r["predicted"], k % 6 == 0) for k, r in got.items() if k < 5000]
    assert sum(p == t for p, t in test) > 0.97 * len(test) and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[5000]["score"] == got[5001]["score"] < 0.5
    none = toxicity.fit(empty, lab.where("false"))
    assert toxicity.predict(df, none).where("predicted = 1").count() == 0 and toxicity.predict(empty, none).count() == 0


# 10


def test_rollup_query_against_brute_force(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sizes = {n.removesuffix(".json"): Tokenizer.from_file(registry.tokenizer_path(n)) for n in registry.TOKENIZERS}
    want: dict = {}
    first: dict = {}
    for r in rows:
        if r[1] is not None and r[0] is not None:
            first[r[1]] = min(first.get(r[1], r[0]), r[0])
    for i, t, lang, source, _ in rows:
        if t is not None and t in first and (i is None or i > first[t]):
            continue
        a, b = (len(x.encode(t or "", add_special_tokens=False).ids) for x in sizes.values())
        key = (source, lang, list(sizes)[a != b])
        n, m = want.get(key, (0, 0))
        want[key] = n + 1, m + (b if a != b else a)
    got = registry.op10_token_rollups(spark, str(tmp_path)).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == want and len(got) == len(want)


def test_encoder_pieces_of_two_tokenizers():
    r = random.Random(8)
    bits = ["a", "bé", "日", "\U0001f642", " ", " ", "\n", "\t", "'s", "'", "1", "²", ".", "\u00a0", "\u0308", "\0", "<|endoftext|>", "Σ", "\x1c", "\u3000", "don't", "\r\n", "x" * 80]
    odd = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    for name in registry.TOKENIZERS:
        e = tokens.Encoder(registry.tokenizer_path(name), 2, memory=20_000)
        assert e.lead is not None and list(e.batch(pa.array([*odd, None]))) == [*map(e._whole, odd), b""]
        assert e.held <= 20_000 and len(e.young) + len(e.old) < 300


def test_hot_id_splits_over_shards(spark):
    r = random.Random(4)
    df = spark.createDataFrame([(7 if k % 3 else None, prose(EN, r.randint(1, 40)), None, None, 0) for k in range(600)], DOCS)
    path = shared_dir(spark, "t")
    tokens.write_tokens(df, path, tokens.TokenConfig(registry.tokenizer_path(), shard_bytes=6 * 1024))
    shards = spark.read.parquet(f"{path}/manifest").collect()
    assert len({s["part"] for s in shards}) > 3 and max(s["docs"] for s in shards) < 300 and sum(s["docs"] for s in shards) == 600


def test_rollups(spark):
    ledger = rollups.Ledger(spark, shared_dir(spark, "ledger"))
    rows = lambda *x: spark.createDataFrame(x, "source string, lang string, tokenizer_version string, n_tokens long, extra int")
    a = rows(("s", "en", "1", 5, 0), ("s", "en", "1", 7, 0), (None, None, "1", None, 0))
    assert ledger.totals().count() == 0
    assert ledger.commit("b1", rollups.insert(a)) and not ledger.commit("b1", rollups.insert(a))
    assert ledger.commit("b2", rollups.revise(rows(("s", "en", "1", 5, 0)), rows(("s", "en", "2", 9, 0))))
    ledger.snapshot()
    assert ledger.commit("b3", rollups.delete(rows(("s", "en", "1", 7, 0))))
    assert ledger.commit("b4", rollups.insert(a.where("false"))) and not ledger.commit("b2", rollups.insert(a))
    got = {tuple(r) for r in ledger.totals().collect()}
    assert got == {("s", "en", "2", 1, 9), (None, None, "1", 1, 0)}
    ledger.snapshot()
    assert {tuple(r) for r in ledger.totals().collect()} == got and ledger.committed() == ["b1", "b2", "b3", "b4"]
    with pytest.raises(ValueError):
        ledger.commit("../x", rollups.insert(a))
