"""The operators against brute force on a small fixture with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate, media, packing, quality, scratch, simhash, substring, token_store, toxicity, urls, vec, warc
from corpusmill.llm.labelled import auc, sample

P = pytest.importorskip("public_tokenizers")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def held_out(ids):
    return [i is None or zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


def fixture():
    rng = random.Random(3)
    vocabulary = ["alpha", "beta", "Gamma", "délta", "epsilon,", "zeta.", "eta", "théta", "iota", "kappa"]
    text = lambda n: " ".join(rng.choice(vocabulary) + str(rng.randint(0, 30)) for _ in range(n))
    passage = text(60)
    base = text(200)
    rows = [(i, text(rng.randint(1, 120))) for i in range(40)]
    rows += [(40, f"{text(10)}\n{passage}  {text(5)}"), (41, f"{passage}\t{text(30)}"), (42, passage), (43, base), (44, base), (45, base.replace(base.split()[100], "edit")), (46, None), (47, ""), (48, " \n "), (49, "the " * 90), (50, text(6000)), (None, text(20)), (None, base), (43, base), (51, "one two"), (52, "ONE TWO"), (53, "a b   c <|endoftext|> x")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return fixture()


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = [(i, t, "en", "s", n, 0.5, "x") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, n_words string, path long, score double, _text string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_xxh64():
    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in [*range(70), 100, 255, 1000]]
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(x) for x in parts])
    assert simhash.xxh64(data, np.cumsum(size) - size, size).tolist() == [xxhash.xxh64_intdigest(x, 42) for x in parts]


def fingerprint(text):
    w = SPACE.findall(lower(text))
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows, empty):
    got = sorted((str(x["doc_id"]), x["fp"] % 2**64, x["component_id"]) for x in simhash.near_duplicates(docs).collect())
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    assert got == sorted((str(i), f, least[r]) for (i, _), f, r in zip(rows, fps, root))
    assert simhash.near_duplicates(empty).count() == 0


def test_large_cells_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 8)
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(80)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [(x - 2**64 if x >> 63 else x,) for x in fps]
    star = simhash.components(simhash.links(simhash.pivots(spark.createDataFrame(signed, "fp long")))).collect()
    group = {a[0]: a[0] for a in signed} | {x["a"]: x["b"] for x in star}
    order, root = sorted(fps), {}
    for _ in range(4):
        for x in order:
            near = [y for y in order if (x ^ y).bit_count() <= 3]
            low = min(root.get(y, y) for y in near)
            for y in near:
                root[y] = low
    want = {}
    for x in order:
        want.setdefault(root[x], set()).add(x)
    have = {}
    for x, g in group.items():
        have.setdefault(g, set()).add(x % 2**64)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_one_of_each(docs, rows, empty):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((x["doc_id"], x["text"]) for x in kept.collect() if x["doc_id"] is not None)
    gone = {i for i, _ in rows if i is not None} - {i for i, _ in ids}
    assert gone >= {44, 45, 52, 48} and len([i for i, _ in ids if i == 43]) == 1
    assert gone <= {44, 45, 52, 47, 48}
    assert simhash.one_of_each(empty).count() == 0


def test_substring(docs, rows, empty):
    words = [SPACE.findall(t or "") for _, t in rows]
    seen = {}
    for w in words:
        for i in range(len(w) - 34):
            seen[tuple(w[i : i + 35])] = seen.get(tuple(w[i : i + 35]), 0) + 1
    want = []
    for (i, _), w in zip(rows, words):
        out = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                out |= set(range(k, k + 35))
        want.append((str(i), len(w), len(out), " ".join(x for k, x in enumerate(w) if k not in out)))
    found = substring.remove_repeats(docs)
    assert sorted((str(x["doc_id"]), x["n_words"], x["n_removed"], x["kept_text"]) for x in found.collect()) == sorted(want)
    assert substring.remove_repeats(empty).count() == 0
    out = substring.without_repeats(docs)
    assert out.columns == docs.columns and {x["n_words"] for x in out.collect()} == {"s"}
    kept = {x["doc_id"]: x["text"] for x in out.collect()}
    assert 42 not in kept and kept[53] == rows[-1][1] and len(SPACE.findall(kept[41])) == 30


@pytest.mark.parametrize("size", [1 << 20, 8])
def test_decontamination(spark, docs, rows, empty, monkeypatch, size):
    """With prefixes broadcast and a roomy filter, and with salted joins and a filter that lets nearly all through."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", size)
    monkeypatch.setattr(decontaminate, "BLOOM_BYTES", size)
    items = [(1, rows[40][1]), (2, rows[41][1][:80]), (3, "One, TWO!"), (4, None), (5, " . "), (3, "one two"), (10, rows[50][1][-90:])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in rows:
        w, hit, names = WORD.findall(lower(t)), set(), set()
        for item, s in items:
            v = WORD.findall(lower(s))
            for k in range(max(len(v) - 7, 1) if v else 0):
                window = v[k : k + 8]
                for a in range(len(w) - len(window) + 1):
                    if w[a : a + len(window)] == window:
                        hit |= set(range(a, a + len(window)))
                        names.add(item)
        want.append((str(i), len(w), len(hit), sorted(names)))
    got = decontaminate.contamination(docs, bench)
    assert sorted((str(x["doc_id"]), x["n_words"], x["n_hit"], x["item_ids"]) for x in got.collect()) == sorted(want)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    named = decontaminate.contamination(docs, bench.select(F.concat(F.lit("i"), F.col("item_id")).alias("item_id"), "text"))
    assert sorted((str(x["doc_id"]), x["item_ids"]) for x in named.collect()) == sorted((i, sorted(f"i{n}" for n in names)) for i, _, _, names in want)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {x["doc_id"]: x["n_words"] for x in kept.collect()}[0] == "s"
    kept = {x["doc_id"] for x in kept.collect()}
    assert kept & {40, 41, 42, 50} == set() and {0, 1, 49, 51} <= kept


def encoded(name, text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def test_packing(docs, rows, empty):
    got = packing.pack(docs, P.path("word_bpe_49k.json"), max_tokens=512).collect()
    want = []
    for i, t in rows:
        ids = encoded("word_bpe_49k.json", t, 1)
        want += [(str(i), k // 512, k, ids[k : k + 512]) for k in range(0, len(ids), 512)]
    assert sorted((str(x["doc_id"]), x["piece"], x["start"], np.frombuffer(x["ids"], "<u4").tolist()) for x in got) == sorted(want)
    bins = {}
    for x in got:
        bins.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack(empty, P.path("word_bpe_49k.json")).count() == 0


def test_packing_hardly_depends_on_layout(spark):
    rng = random.Random(4)
    rows = [(f"d{i}", " ".join(["a"] * rng.randint(1, 120))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    used = {n: packing.pack(scratch.stored(docs.repartition(n), "t"), P.path("word_bpe_49k.json"), max_tokens=256) for n in (1, 100)}
    used = {n: x.select("sequence_id").distinct().count() for n, x in used.items()}
    assert used[100] <= 1.02 * used[1], used


def test_best_fit_is_bounded_and_fills():
    rng, bins = random.Random(4), packing.OpenBins(100, 20)
    sizes = [rng.randint(1, 100) for _ in range(3000)]
    used = {}
    for s in sizes:
        n, at = bins.place(s)
        assert at == used.get(n, 0)
        used[n] = at + s
        assert bins.count <= 20 and used[n] <= 100
    assert len(used) <= 1.06 * sum(sizes) / 100


def test_token_store(spark, docs, rows, empty):
    folder = scratch.folder(spark, "test")
    manifest = token_store.write_tokens(docs, P.path("byte_bpe_50k.json"), folder)
    got = sorted(token_store.read_tokens(spark, folder, manifest).collect(), key=lambda x: x["start"])
    assert [x["doc_id"] for x in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    at, want = 0, {}
    for i, t in rows:
        want.setdefault(i, []).append(encoded("byte_bpe_50k.json", t, 0))
    for x in got:
        ids = np.frombuffer(x["ids"], "<u4").tolist()
        assert x["start"] == at and ids in want[x["doc_id"]]
        at += len(ids)
    store = token_store.TokenStore(folder)
    for i in (0, 7, 43, 50, 53):
        assert sorted(x.tolist() for x in store.get(i)) == sorted(want[i])
    assert store.get(1000) == [] and store.get(-5) == []
    assert token_store.write_tokens(empty, P.path("byte_bpe_50k.json"), scratch.folder(spark, "test")) == []


def test_mph_is_minimal_and_perfect():
    keys = np.array(random.Random(6).sample(range(-(2**60), 2**60), 5000))
    sizes, words, slots = token_store.build_mph(keys)
    assert sorted(slots.tolist()) == list(range(5000)) and sum(sizes) == len(words)


def test_urls(spark):
    given = ["http://A.Example.org/es/x?q", "https://example.org/en/12", "http://a.com/fr/", "http://b.a.com/de/#x", "http://org/", "http://org", None, "nohost/es/", "ftp://x.net/fr/", "http://www.bad.net/a//", "http://good.net/a", "http://sub.site.net/q", "http://org/", "://", "http://xcom/de/"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(given)], "page_id long, url string, host string, rule string")
    listed = spark.createDataFrame([("bad.net/a",), ("site.net/",), (None,), ("site.net/",)], "key string")
    got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in urls.judge(pages, urls.RULES, listed).collect()}
    for i, u in enumerate(given):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda x: len(x[0]), default=(None, "block" if i in (9, 11) else "allow"))
        assert got[i] == (host, path, *best), u
    assert urls.judge(pages.limit(0), urls.RULES, listed).count() == 0
    assert urls.judge(pages, [], listed.limit(0)).where("verdict = 'block'").count() == 0


@pytest.mark.parametrize("bound", [1 << 25, 64])
def test_urls_with_many_listed(spark, monkeypatch, bound):
    """Entries broadcast, and joined by key with a filter too small for them."""
    monkeypatch.setattr(urls, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(urls, "BLOOM_BYTES", bound)
    listed = spark.range(5000).select(F.concat(F.lit("h"), F.col("id"), F.lit(".net/p")).alias("key"))
    pages = spark.range(10000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id"), F.lit(".net/p/")).alias("url"))
    blocked = {x["page_id"] for x in urls.judge(pages, [], listed).where("verdict = 'block'").collect()}
    assert blocked == set(range(5000))


def test_warc(spark, tmp_path):
    big, other = "x" * 999 + "é", "y" * 1000
    given = [(1, "http://a/\r\nb", big), (5, None, big), (5, "u", big), (2, "u", other), (3, "u", "small"), (4, "u", "small"), (6, "u", None), (None, "u", big), (None, "u", "z" * 2000), (7, "u", "a\r\n\r\nb")]
    pages = spark.createDataFrame([(*x, "c") for x in given], "page_id long, url string, html string, digest string")
    folder = str(tmp_path / "out")
    (tmp_path / "out").mkdir()
    manifest = warc.write_warc(pages, folder)
    assert manifest.agg(F.sum("records")).first()[0] == len(given)
    got = warc.read_warc(spark, folder).collect()
    have = sorted((x["record_id"], x["record_type"], x["refers_to"] or "", x["payload_bytes"], x["payload_digest"]) for x in got)
    want = []
    for i, _, t in given:
        raw = (t or "").encode()
        revisit = len(raw) >= 1000 and t == big and i != 5
        want.append((f"urn:page:{'null' if i is None else i}", "revisit" if revisit else "response", "urn:page:5" if revisit else "", len(raw), "sha1:" + hashlib.sha1(raw).hexdigest()))
    assert have == sorted(want)
    assert {x["payload"] for x in got if x["record_type"] == "response"} == {(t or "").encode() for _, _, t in given}
    some = warc.read_warc(spark, folder, payload="false").where("record_type = 'revisit' and record_id = 'urn:page:1'").collect()
    assert warc.read_warc(spark, folder).where("refers_to = 'urn:page:5'").count() == sum(x["refers_to"] == "urn:page:5" for x in got) > 0
    assert warc.read_warc(spark, folder).where(F.col("payload_digest") == got[0]["payload_digest"]).count() >= 1
    (tmp_path / "rolled").mkdir()
    assert warc.write_warc(pages, str(tmp_path / "rolled"), file_bytes=1).count() == len(given)
    assert warc.read_warc(spark, str(tmp_path / "rolled")).count() == len(given)
    assert [x["payload"] for x in some] == [None] and some[0]["target_uri"] == "http://a/%0D%0Ab"
    assert warc.write_warc(pages.limit(0), str(tmp_path / "none")).count() == 0


def test_warc_of_other_writers(spark, tmp_path):
    import gzip

    one = [warc.record(i, f"http://x/{i}", b"p" * i * 3000, "d", None, "2000-01-01T00:00:00Z") for i in range(4)]
    (tmp_path / "a.warc").write_bytes(b"".join(one))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in one))
    got = warc.read_warc(spark, str(tmp_path)).where("target_uri like 'http://x/%'").collect()
    assert sorted(len(x["payload"]) for x in got) == sorted([0, 3000, 6000, 9000] * 2)


@pytest.mark.parametrize("kind", ["a.warc", "a.warc.gz", "b.warc.gz"])
def test_warc_cut_off(spark, tmp_path, kind):
    """Half an archive, at any place, is an error and not a shorter payload."""
    import gzip

    rng = random.Random(2)
    one = [warc.record(i, "u", rng.randbytes(20000 * i), "d", None, "2000-01-01T00:00:00Z") for i in (1, 10)]
    packed = {"a.warc": one, "a.warc.gz": [warc.member(x) for x in one], "b.warc.gz": [gzip.compress(x) for x in one]}[kind]
    whole = b"".join(packed)
    (tmp_path / kind).write_bytes(whole)
    assert sorted(len(x["payload"]) for x in warc.read_warc(spark, str(tmp_path)).collect()) == [20000, 200000]
    for stop in (len(packed[0]) + 12, len(whole) // 2, len(whole) - 40):
        (tmp_path / kind).write_bytes(whole[:stop])
        with pytest.raises(Exception, match="cut off"):
            warc.read_warc(spark, str(tmp_path)).collect()


def test_media(spark, docs, rows, empty):
    got = media.audio_features(media.text_media(docs))
    for x in got.collect():
        texts = [(t or "").encode() for i, t in rows if i == x["doc_id"]]
        padded = [t + b" " * (max(1, -(-len(t) // 192)) * 192 - len(t)) for t in texts]
        at = [hashlib.sha256(t).hexdigest() for t in padded].index(x["payload_sha256"])
        assert (x["n_bytes"], x["payload_bytes"], x["tail_crc32"]) == (len(texts[at]), len(padded[at]), zlib.crc32(padded[at][-16:]))
        assert len(x["tensors"]) == 4 * len(x["spans"]) * media.BINS * media.MELS
        assert all(a["end_ms"] > a["start_ms"] for a in x["spans"])
    assert media.audio_features(media.text_media(empty)).count() == 0
    files = media.write_tensors(got, scratch.folder(spark, "tensors")).collect()
    table = media.read_tensors(files[0]["path"])
    assert table.schema.field("tensor").type == pa.fixed_shape_tensor(pa.float32(), media.SHAPE)
    assert sum(x["rows"] for x in files) == sum(len(x["spans"]) for x in got.collect())


def test_resample_and_segments():
    t = np.arange(16000) / 16000
    out = media.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32))
    assert len(out) == 8000 and np.abs(out[100:-100] - np.sin(2 * np.pi * 440 * (np.arange(8000) * 2) / 16000)[100:-100]).max() < 0.2
    assert np.abs(media.resample(np.sin(2 * np.pi * 7000 * t).astype(np.float32))[100:-100]).max() < 0.1
    assert media.segment(np.array([0, 0, 5, 4, 2.4, 4, 0, 0, 5.0])) == [(2, 6), (8, 9)]


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    index = rng.integers(0, 6, (3, 5))
    index[0, 3:] = 6  # no word
    x = rng.normal(size=(6, toxicity.DIM))

    def loss():
        return float((net.forward(net.project(x).astype(np.float64), index) * np.array([1.0, -2.0, 0.5])).sum())

    gates = net.project(x).astype(np.float64)
    _, held = net.forward(gates, index, keep=True)
    grad, _ = net.backward(held, np.array([1.0, -2.0, 0.5]))
    for name in ("uh", "u", "v", "b"):
        flat = net.p[name].reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 6)):
            old = flat[i]
            flat[i] = old + 1e-2
            up = loss()
            flat[i] = old - 1e-2
            down = loss()
            flat[i] = old
            assert (up - down) / 2e-2 == pytest.approx(grad[name].reshape(-1)[i], rel=0.05, abs=2e-3)


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, docs, empty, module, label):
    d = "/root/testdata/sf0.01"
    labels, table = spark.read.parquet(f"{d}/labels.parquet"), spark.read.parquet(f"{d}/documents.parquet")
    model = module.train(table, labels)
    got = module.score(table, model).join(labels, "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in held["doc_id"]]).all()
    assert auc(held[label].to_numpy(), held["score"].to_numpy()) > 0.8
    odd = module.score(docs, model).toPandas()
    assert len(odd) == docs.count() and odd["score"].between(0, 1).all() and odd[odd["doc_id"].isna()]["held_out"].all()
    assert module.score(empty, model).count() == 0
    if module is quality:
        kept = quality.keep_good(docs.drop("lang"), labels.limit(0))  # no labels: all get 0.5
        assert kept.columns == docs.drop("lang").columns and {x["score"] for x in kept.collect()} == {0.5} and kept.count() == docs.count()
    none = module.train(table, labels.limit(0))
    assert module.score(docs, none).select("score").distinct().count() == 1


def test_rolling_and_words():
    data = np.frombuffer("ab  c\nde".encode() + "é f".encode(), np.uint8)
    starts, ends, first = vec.words(data, np.array([0, 8, 8, len(data)]), vec.NOT_SPACE)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == ["ab", "c", "de", "é", "f"] and first.tolist() == [0, 3, 3, 5]
    h = vec.hash_words(data, starts, ends)
    again = vec.Rolling(np.concatenate([h, h]))
    assert (again.windows(3)[:3] == again.windows(3)[5:]).all() and len(set(h.tolist())) == 5
    assert vec.sliding_min(np.array([5, 3, 4, 1, 9, 9, 9]), 3).tolist() == [3, 1, 1, 1, 9]


def test_substring_cycles(spark):
    """Runs of repeated phrases, as single rows with rounds, against brute force."""
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    texts = ["the " * 90, "the " * 35, "x " * 36, "x " * 35, text(34), None, ""]
    for i in range(30):
        phrase = text(rng.randint(1, 60))
        texts.append(" ".join([text(rng.randint(0, 30)), *[phrase] * rng.randint(1, 200 // len(phrase.split()) + 2), text(rng.randint(0, 20))]))
        texts.append("a b " * rng.randint(1, 60) + text(5) + " b a" * rng.randint(1, 60))
    words = [SPACE.findall(x or "") for x in texts]
    seen = {}
    for w in words:
        for i in range(len(w) - 34):
            seen[tuple(w[i : i + 35])] = seen.get(tuple(w[i : i + 35]), 0) + 1
    want = {}
    for k, w in enumerate(words):
        gone = {p for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for p in range(i, i + 35)}
        want[k] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    found = substring.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in found.collect()} == want


def test_hot_cell_links():
    """One cell of thousands of fingerprints gives the components of all its pairs."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fp = base[rng.integers(0, 4, 1500)]
    for _ in range(4):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, len(fp)).astype(np.uint64))
    fp = np.unique(np.concatenate([fp, rng.integers(0, 2**63, 40, dtype=np.uint64)]))
    for radius in (3, 7):
        i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius, 1))
        want = simhash.stars(fp[i], fp[j])
        got = simhash._cell_links(np.zeros(len(fp)), fp, simhash.pivot_tables(fp)[1], radius)
        assert all(np.array_equal(x, y) for x, y in zip(got, want))


def shingles(text, n=5):
    w = SPACE.findall(lower(text))
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, min(len(w), 1)))}


def similar(x, y):
    """Jaccard similarity of at least 0.8; empty sets are alike."""
    common = len(x & y)
    return min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and common >= 0.8 * (len(x) + len(y) - common) - 1e-9


def first_of_each(rows):
    """Ids of the (id, text) that stay, by all pairs: in order, each that isn't similar to one that stays."""
    stay = []
    for i, text in sorted(rows):
        x = shingles(text)
        if not any(similar(x, y) for _, y in stay):
            stay.append((i, x))
    return {i for i, _ in stay}


def edited_copies(rng, texts):
    """Of each text one longer, one shorter and one with other words, as far as similarity stays at 0.8 to 0.9."""
    word = lambda: f"w{rng.randrange(30000)}"
    out = {"appended": [], "cut": [], "replaced": []}
    for text in texts:
        w = text.split()
        n = len(w) - 4
        share = rng.uniform(0.8, 0.9)
        out["appended"].append(" ".join(w + [word() for _ in range(int(n / share) - n)]))
        out["cut"].append(" ".join(w[: len(w) - int(n * (1 - share))]))
        other = list(w)
        while similar(shingles(text), shingles(" ".join(other))):
            last = list(other)
            other[rng.randrange(len(other))] = word()
        out["replaced"].append(" ".join(last))
    return out


def test_one_of_each_finds_all_pairs(spark):
    """Appended, cut and replaced copies, of one source each, against all pairs."""
    rng = random.Random(8)
    bases = [" ".join(f"w{rng.randrange(30000)}" for _ in range(rng.choice([12, 30, 60, 200, 500]))) for _ in range(240)]
    copies = edited_copies(rng, bases)
    texts = [t for i, base in enumerate(bases) for t in (base, copies[["appended", "cut", "replaced"][i % 3]][i])]
    ids = rng.sample(range(10000), len(texts))
    rows = list(zip(ids, texts))
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = first_of_each(rows)
    assert len(want) == len(bases)
    assert {x["doc_id"] for x in kept.collect()} == want


@pytest.mark.parametrize("cell", [3, 16, 4096])
def test_one_of_each_by_cell(spark, monkeypatch, cell):
    """Groups of successive edits give the id-order result, whether judged at once or in rounds."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(9)
    rows = []
    for group in range(3):
        words = [f"g{group}w{i}" for i in range(400)]
        rows += [(None, " ".join(words[s : s + 100])) for s in range(0, 14 + 40 * group, 4)]
    ids = rng.sample(range(1000), len(rows))
    rows = [(i, t) for i, (_, t) in zip(ids, rows)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert {x["doc_id"] for x in kept.collect()} == first_of_each(rows)


def test_judged_row_repeated_across_batches(spark, monkeypatch):
    """A text whose rows fall into two Arrow batches isn't its own near copy."""
    monkeypatch.setattr(simhash, "CELL", 4096)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = [(1, "a", 5, [1, 2, 3]), (1, "b", 6, [7, 8, 9]), (1, "b", 6, [7, 8, 9]), (1, "c", 7, [1, 2, 3])]
        sets = spark.createDataFrame(rows, "top long, key string, least long, sets array<long>").coalesce(1)
        assert [x["_text_key"] for x in simhash.covered(sets, 0.8).collect()] == ["c"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("section", ["levels", "document", "prints"])
def test_token_rows_come_through_the_index(spark, docs, section):
    """Reading all rows finds a fault in any part of a shard's index."""
    folder = scratch.folder(spark, "test")
    manifest = token_store.write_tokens(docs, P.path("byte_bpe_50k.json"), folder)
    assert token_store.read_tokens(spark, folder, manifest).count() == docs.count()
    shard = token_store.Shard(f"{folder}/{manifest[-1]['name']}")
    assert shard.first(np.array([1000, -5])).tolist() == [-1, -1]
    path = scratch.open_fs(f"{folder}/{manifest[-1]['name']}")[1]
    data = bytearray(open(path, "rb").read())
    at = shard.meta[section][0]
    at += next(i for i, x in enumerate(data[at : at + shard.meta[section][1]]) if x) if section == "levels" else 0
    data[at] ^= data[at] if section == "levels" else 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="index doesn't lead"):
        token_store.read_tokens(spark, folder, manifest).collect()


def test_media_features_come_from_files(spark, docs, monkeypatch):
    """The query's media and tensors are written and read again, with the same features."""
    folders, folder = [], scratch.folder
    monkeypatch.setattr(scratch, "folder", lambda spark, name: folders.append(folder(spark, name)) or folders[-1])
    direct = media.audio_features(media.text_media(docs))
    again = media.stored_features(direct, scratch.folder(spark, "tensors")).select(*direct.columns)
    assert media.digest(np.array([1.01, 2], "<f4").tobytes()) == media.digest(np.array([1.010001, 2], "<f4").tobytes()) != media.digest(np.array([1.5, 2], "<f4").tobytes())
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(again) == rows(direct)
    assert media.stored_features(direct.limit(0), scratch.folder(spark, "tensors")).count() == 0
    folders.clear()
    d = "/root/testdata/sf0.001"
    got = media.op6_media_columns(spark, d)
    want = media.audio_features(media.text_media(spark.read.parquet(f"{d}/documents.parquet"))).collect()
    assert {x["doc_id"]: x["feature"].rpartition(":")[2] for x in got.collect()} == {x["doc_id"]: media.digest(bytes(x["tensors"])) for x in want}
    tensors = next(x for x in folders if "/tensors-" in x)
    stored = [media.read_tensors(x) for x in scratch.files(spark, tensors, ".arrow")]
    assert sum(x.num_rows for x in stored) == sum(len(x["spans"]) for x in want)
    assert spark.read.parquet(next(x for x in folders if "/media-" in x) + "/table").count() == len(want)


def without_passages(texts, size=35):
    """{id: text} without the windows of size words that occur elsewhere; a text of which nothing is left goes."""
    words, seen, out = {i: SPACE.findall(t) for i, t in texts.items()}, {}, {}
    for w in words.values():
        for a in range(len(w) - size + 1):
            seen[tuple(w[a : a + size])] = seen.get(tuple(w[a : a + size]), 0) + 1
    for i, w in words.items():
        gone = {p for a in range(len(w) - size + 1) if seen[tuple(w[a : a + size])] > 1 for p in range(a, a + size)}
        if not gone or len(gone) < len(w):
            out[i] = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else texts[i]
    return out


def holds_passage(text, items):
    """A run of 8 words or more that windows of 8 words of items cover, or windows of two items."""
    w, hit, names = WORD.findall(lower(text)), set(), set()
    at = {}
    for n in {min(len(WORD.findall(lower(t))), 8) for _, t in items}:
        for a in range(len(w) - n + 1):
            at.setdefault(tuple(w[a : a + n]), []).append(a)
    for item, t in items:
        v = WORD.findall(lower(t))
        for k in range(max(len(v) - 7, 1) if v else 0):
            for a in at.get(tuple(v[k : k + 8]), []):
                hit |= set(range(a, a + len(v[k : k + 8])))
                names.add(item)
    return len(names) > 1 or any(set(range(a, a + 8)) <= hit for a in hit)


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() on documents with appended, cut and replaced copies, each stage by plain loops but the classifier's scores."""
    import corpus_pipeline

    source, d = "/root/testdata/sf0.001", str(tmp_path)
    table = spark.read.parquet(f"{source}/documents.parquet")
    rng = random.Random(12)
    long = [x for x in table.orderBy("doc_id").collect() if 40 <= len((x["text"] or "").split()) <= 600]
    copies = edited_copies(rng, [" ".join(x["text"].split()) for x in long])
    added = [(10_000_000 + 3 * n + k, c[n], x["lang"], x["source"], len(c[n])) for n, x in enumerate(long) for k, c in enumerate(copies.values())]
    table.union(spark.createDataFrame(added, table.schema)).write.parquet(f"{d}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(f"{d}/{name}.parquet")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = quality.score(docs, quality.train(docs, labels)).collect()
    good = {x["doc_id"]: x["text"] or "" for x in scored if x["score"] >= 0.3}
    assert {x["doc_id"] for x in quality.keep_good(docs, labels).collect()} == set(good)
    first = first_of_each(good.items())
    cut = without_passages({i: good[i] for i in first})
    items = [(x["item_id"], x["text"]) for x in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    clean = {i: t for i, t in cut.items() if not holds_passage(t, items)}
    assert len(scored) > len(good) > len(first) >= len(cut) > len(clean) > 0 and any(cut[i] != good[i] for i in cut)
    want = []
    for i, t in clean.items():
        ids = encoded("word_bpe_49k.json", t, 1)
        want += [(i, k, ids[k : k + 4096]) for k in range(0, len(ids), 4096)]
    got = corpus_pipeline.run(spark, d).collect()
    assert sorted((x["doc_id"], x["start"], np.frombuffer(x["ids"], "<u4").tolist()) for x in got) == sorted(want)
    used = {}
    for x in got:
        used[x["sequence_id"]] = used.get(x["sequence_id"], 0) + x["length"]
    assert max(used.values()) <= 4096


def test_sample_is_bounded_in_rows_alone(spark):
    """Texts of any length are learned from; class totals count all labelled rows that aren't held out."""
    rows = [(i, "x" * (200_000 if i % 2 else 10)) for i in range(400)] + [(401, "y"), (401, "short"), (403, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 1)) for i in range(400)] + [(401, 1), (403, 1), (9999, 1), (None, 0)], "doc_id long, toxic int")
    here = [i for i in range(400) if not held_out([i])[0]]
    want = {y: sum(int(i % 4 > 1) == y for i in here) for y in (0, 1)}
    want[1] += sum(not held_out([i])[0] for i in (401, 403))
    table, totals = sample(docs, labels, "toxic", {0: 50, 1: 1000})
    frame = table.toPandas()
    assert totals == want
    assert (frame["y"] == 0).sum() == 50 and (frame["y"] == 1).sum() == want[1]
    assert frame["text"].str.len().max() == 200_000 and frame["_id"].is_unique


def thue_morse(n):
    """Two different words of n letters that hashes by powers of an odd number modulo 2**64 take for equal."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [64, 256, 1024, 2048])
def test_words_with_equal_power_sums(spark, size):
    """Different words that a polynomial hash confuses stay different in all operators."""
    one, other = thue_morse(size)
    data = np.frombuffer((one + other + one).encode(), np.uint8)
    at = np.arange(3) * size
    h = vec.hash_words(data, at, at + size)
    assert h[0] == h[2] != h[1]
    assert vec.same_bytes(data, at[[0, 0]], data, at[[1, 2]], np.array([size, size])).tolist() == [False, True]
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join([*words, one]), " ".join([*words[:5], other, *words[5:]]), f"{one} {other} x", f"{other} {one} x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    bench = spark.createDataFrame([(1, f"{one} {other} x"), (2, f"{other} x")], "item_id long, text string")
    found = {x["doc_id"]: x["item_ids"] for x in decontaminate.contamination(docs, bench).collect()}
    assert found == {0: [], 1: [], 2: [1, 2], 3: []}
    left = {x["doc_id"]: x["n_removed"] for x in substring.remove_repeats(docs, window=3, piece=2).collect()}
    assert left == {0: 40, 1: 40, 2: 0, 3: 0}
    for name, run in (("word_bpe_49k.json", lambda p: packing.pack(docs, p, end_id=0)), ("byte_bpe_50k.json", lambda p: token_store.read_tokens(spark, (f := scratch.folder(spark, "t")), token_store.write_tokens(docs, p, f)))):
        got = {x["doc_id"]: np.frombuffer(x["ids"], "<u4").tolist() for x in run(P.path(name)).collect()}
        assert got == {i: encoded(name, t, 0) for i, t in enumerate(texts)}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_special_tokens_as_the_library_gives_them(name):
    from corpusmill.llm import tokens

    texts = ["hello <|endoftext|> world<|endoftext|>", "<|startoftext|>a", "<|endof", "text|> b", "<|ENDOFTEXT|>", "a\u00a0b <|endoftext|>", "", " plain  text\n\tit's ", "plain text"]
    raw = [t.encode() for t in texts]
    ids, first = tokens.encoder(P.path(name)).encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [encoded(name, t, 0)[:-1] for t in texts]


def test_pieces_with_equal_hashes_are_told_apart(monkeypatch):
    from corpusmill.llm import tokens

    monkeypatch.setattr(vec, "hash_words", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    encoder = tokens.Encoder(P.path("word_bpe_49k.json"))
    for text in ("one", "two", "one two six", "seven"):
        raw = text.encode()
        assert encoder.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist() == encoded("word_bpe_49k.json", text, 0)[:-1]
