"""Each operator against a brute-force version, on the smallest tables and on a table of odd cases."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from factloom.llm import decontam, hashing, licenses, minhash, mixing, planes, pq, queries, ring, substring, toxicity, warc
from factloom.llm.common import BATCH_BYTES, arrow_batches, new_path, released, stage, table
from factloom.llm.components import connected_components

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint, uid bigint, gram string, band int"

_WORDS = [f"w{i}" for i in range(400)]
_LONG = " ".join(_WORDS[i % 397] + str(i % 11) for i in range(6000))
#: Nulls, empty and white texts, few words, copies, near copies, repeated rows, a very long text, columns with clashing names.
ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega", "en", "a", 1, 7, "g", 1),
    (2, "ALPHA beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega", "en", "a", 1, 7, "g", 1),
    (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega", "en", "b", 1, 7, "g", 1),
    (4, "", "en", None, 0, 7, "g", 1),
    (5, None, None, None, None, None, None, None),
    (6, " \t\n ", "en", "b", 4, 7, "g", 1),
    (7, "one two", "en", "b", 4, 7, "g", 1),
    (8, "One two", "en", "c", 4, 7, "g", 1),
    (9, _LONG, "en", "c", 1, 7, "g", 1),
    (10, _LONG + " end of it", "en", "c", 1, 7, "g", 1),
    (10, _LONG + " end of it", "en", "c", 1, 7, "g", 1),
    (11, "x  y z\r\nÉclair über\tñandú don't <|endoftext|> 12", "fr", "d", 1, 7, "g", 1),
    (12, " ".join(_WORDS[:20]) + " middle " + " ".join(_WORDS[:20]), "en", "d", 1, 7, "g", 1),
    (13, " ".join(["same"] * 30), "en", "e", 1, 7, "g", 1),
    (-3, "negative ids come first " + " ".join(_WORDS[:20]), "en", "e", 1, 7, "g", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SHAPE).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def rows_of(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).collect()]


def texts(frame):
    return rows_of(frame, "doc_id", "text")


def words(text, lower=False):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER) if lower else text or "")


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_planes(request, which):
    from tokenizers import Tokenizer

    frame = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want, start = Counter(), 0
    for doc, text in sorted(texts(frame), key=lambda r: (r[0], r[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[doc, start, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
    assert Counter(rows_of(planes.token_table(frame, queries.tokenizer_path(), 2), "doc_id", "start", "n_tokens", "ids_crc32")) == want


def test_encoder_equals_whole_texts(monkeypatch):
    """Also with stems of earlier batches kept, and with room for a few of them."""
    rng = np.random.default_rng(4)
    parts = [" ", " ", " ", "\n", "  ", "\t", "\0", "\u3000", "'", "'s", "don't", "it's.'s", ",", ".", "...", "(", "x", "word", "Ñandú", "ÿ", "ž9", "日本", "e\u0301", "\u02b0", "7", "1,000.5", "a,b;c", "<|endoftext|>", "_", "×", "÷"]
    batches = [pa.array(["".join(rng.choice(parts, int(rng.integers(0, 30)))) for _ in range(400)] + [None, ""]) for _ in range(4)]
    for room in (planes.CACHE_PIECES, 7):
        monkeypatch.setattr(planes, "CACHE_PIECES", room)
        encoder = planes.Encoder(queries.tokenizer_path())
        for texts in batches:
            want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
            assert [x.tolist() for x in encoder.encode(texts)] == want
        assert 0 < len(encoder.kept) <= room and len(encoder.begin) == len(encoder.kept) + 1


def test_a_word_is_encoded_once_whatever_stands_after_it():
    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer, self.chars = tokenizer, 0

        def encode_batch_fast(self, texts, **how):
            self.chars += sum(map(len, texts))
            return self.tokenizer.encode_batch_fast(texts, **how)

    encoder = planes.Encoder(queries.tokenizer_path())
    encoder.tokenizer = counting = Counting(encoder.tokenizer)
    words = [f"stem{chr(97 + i % 26)}{i}" for i in range(200)]
    for end in ("", ",", ".", ";", ")", "?!"):
        encoder.encode(pa.array(["x " + " ".join(w + end for w in words) + " x"]))
    assert counting.chars < 1.2 * sum(len(w) + 1 for w in words)


def test_words_and_numbers_are_not_pre_tokenised():
    """What the pre-tokeniser takes whole goes to the model; a stem with an added token doesn't."""

    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer, self.texts = tokenizer, []

        def encode_batch_fast(self, texts, **how):
            self.texts += texts
            return self.tokenizer.encode_batch_fast(texts, **how)

    encoder = planes.Encoder(queries.tokenizer_path())
    encoder.tokenizer = counting = Counting(encoder.tokenizer)
    letters = "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x250)]))
    texts = ["Plain words of stanthing onhe", f"été {letters} Ñandú ÿ {letters[::-1]}", "In 2024 1234567890 of 7"]
    want = [counting.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == want and "".join(counting.texts) == ""
    encoder.added = "words"
    assert [x.tolist() for x in encoder.encode(pa.array(["Plain words again"]))] == [counting.tokenizer.encode("Plain words again", add_special_tokens=False).ids]
    encoder.kept = pa.array([], pa.string())
    encoder.flat, encoder.begin = np.empty(0, np.uint32), np.zeros(1, np.int64)
    encoder.encode(pa.array(["Plain words again"]))
    assert "".join(counting.texts).strip() == "words"


def test_a_worker_keeps_its_encoder():
    assert planes.encoder_of(queries.tokenizer_path()) is planes.encoder_of(queries.tokenizer_path())


def test_python_gets_bounded_batches(spark, odd, monkeypatch):
    """Batches are bounded while plane files are written and read and near-duplicates are sought, not after."""
    key, found = "spark.sql.execution.arrow.maxBytesPerBatch", []
    for module in (planes, minhash):
        monkeypatch.setattr(module, "stage", lambda df, label: found.append(spark.conf.get(key, None)) or stage(df, label))
    text = DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, path: found.append(spark.conf.get(key, None)) or text(self, path))
    planes.token_table(odd, queries.tokenizer_path(), 2)
    assert found == [f"{BATCH_BYTES}b"] * 2
    minhash.near_duplicates(odd)
    assert set(found) == {f"{BATCH_BYTES}b"} and len(found) > 2
    assert spark.conf.get(key, None) is None

    sizes = spark.range(2000).selectExpr("repeat('x', 1000) AS text").coalesce(1)
    with arrow_batches(spark, 100_000):
        rows = sizes.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n bigint").collect()
    assert sum(r["n"] for r in rows) == 2000 and max(r["n"] for r in rows) <= 101


def test_workers_give_memory_back(monkeypatch):
    freed = []
    monkeypatch.setattr(pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: freed.append(1)})())
    assert list(released(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3] and freed == [1]


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_plane_files_hold_the_ids(spark, odd, kind):
    path = new_path(spark, "test")
    planes.write_planes(odd, path, queries.tokenizer_path(), 2, kind)
    back = planes.read_planes(spark, path, with_ids=True).collect()
    assert len(back) == len(ODD)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in back)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_stripes_round_trip_and_notice_damage(kind):
    parts = [np.arange(100_000, dtype=np.uint32) * 41_000, np.array([2], np.uint32), np.zeros(0, np.uint32)]
    stripe = planes.pack_stripe([5, None, -7], parts, kind)
    docs, lengths, ids = planes.unpack_stripe(memoryview(stripe))
    assert docs == [5, None, -7] and lengths.tolist() == [100_000, 1, 0] and (ids == np.concatenate(parts)).all()
    assert len(planes.stripes_of(memoryview(stripe + planes.MAGIC + stripe + planes.MAGIC))) == 2
    broken = bytearray(stripe)
    broken[40] ^= 255
    with pytest.raises(Exception):
        planes.unpack_stripe(memoryview(bytes(broken)))


@pytest.mark.parametrize("which", ["docs", "odd"])
@pytest.mark.parametrize("slack", [0.0, 0.1])
def test_ring(request, which, slack):
    frame = request.getfixturevalue(which)
    out = ring.assign(frame, 16, slack).collect()
    sizes = defaultdict(list)
    for r in out:
        sizes[r["shard"]].append(r["slot"])
    n = len(out)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts(frame))
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    if slack:
        assert max(map(len, sizes.values())) <= n * 1.1 / 16 + 2
    else:
        counts = [len(sizes[s]) for s in range(16)]
        assert max(counts) - min(counts) <= 1
    if which == "docs":
        assert np.mean([r["shard"] == r["home_shard"] for r in out]) > 0.6


def test_ring_moves_little_when_it_grows(docs):
    before = dict(rows_of(ring.assign(docs, 16, 0.25), "doc_id", "shard"))
    after = dict(rows_of(ring.assign(docs, 17, 0.25), "doc_id", "shard"))
    assert np.mean([after[d] != s for d, s in before.items()]) < 0.45


def test_ring_moves_little_without_slack(spark):
    """Capacities that leave no room: what a new shard doesn't take stays, but for a few keys that overflow elsewhere."""
    rows = table(spark, "/root/testdata/sf0.1", "documents")
    before, after = (dict(rows_of(ring.assign(rows, n), "doc_id", "shard")) for n in (16, 17))
    moved = [after[d] for d, s in before.items() if after[d] != s]
    assert len(moved) < 0.09 * len(before) and sum(s != 16 for s in moved) < 0.03 * len(before)


def shingles(text):
    w = words(text, lower=True)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_near_duplicates(request, which):
    frame = request.getfixturevalue(which)
    sets = {d: shingles(t) for d, t in texts(frame)}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = roots(ids, links)
    want = Counter((d, len(sets[d]), root[d], root[d] == d) for d, _ in texts(frame))
    assert links and Counter(rows_of(minhash.near_duplicates(frame), "doc_id", "n_shingles", "component_id", "kept")) == want


def test_near_duplicates_beyond_the_star(spark):
    """A family around the threshold: members link with some of the others only."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for d in range(150):
        w = list(base)
        for k in rng.choice(300, int(rng.integers(4, 16)), replace=False):
            w[k] = f"x{d}_{k}"
        rows.append((d, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = {d: shingles(t) for d, t in rows}
    links = [(a, b) for a in sets for b in sets if b < a and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert {r[0]: r[1] for r in rows_of(minhash.near_duplicates(frame), "doc_id", "component_id")} == roots(sets, links)


@pytest.mark.parametrize("shared", [0.3, 0.55, 0.7])
def test_near_duplicates_that_meet_only_where_the_pivot_is_unlike(spark, shared, monkeypatch):
    """Many texts share a passage and so a bucket; some of them are linked in pairs, mostly not with the pivot."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 20_000)
    rng = np.random.default_rng(4)
    n = int(400 * shared)
    passage = [f"p{i}" for i in range(n)]
    rows = []
    for d in range(0, 240, 2):
        own = [f"o{d}_{i}" for i in range(400 - n)]
        changed = list(own)
        for k in rng.choice(len(own), min(len(own), 6), replace=False):
            changed[k] = f"x{d}_{k}"
        rows += [(d, " ".join(passage + own)), (d + 1, " ".join(passage + changed))]
    sets = {d: shingles(t) for d, t in rows}
    links = [(a, b) for a in sets for b in sets if b < a and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(links) >= 120
    got = {r[0]: r[1] for r in rows_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")), "doc_id", "component_id")}
    assert got == roots(sets, links)


def test_near_duplicates_without_id(spark):
    same = " ".join(_WORDS[:30])
    rows = [(None, same), (1, same), (2, same), (None, same), (None, None)]
    got = Counter(rows_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")), "doc_id", "n_shingles", "component_id", "kept"))
    assert got == {(None, 26, None, True): 2, (1, 26, 1, True): 1, (2, 26, 1, False): 1, (None, 0, None, True): 1}


@pytest.mark.parametrize("n", [1, 2, 7, 200])
def test_signature_estimates_similarity(n):
    rng = np.random.default_rng(n)
    own = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    assert len(minhash.signature(own)) == minhash.BINS and (minhash.signature(own) == minhash.signature(own.copy())).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (300, 200), (7, 7), (200, 100)]
    got = dict(rows_of(connected_components(spark.createDataFrame(chain, "src bigint, dst bigint")), "id", "component"))
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def fair_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mixing(request, which):
    frame = request.getfixturevalue(which)
    size = Counter()
    for source, text in rows_of(frame, "source", "text"):
        size[source] += len(words(text))
    target = fair_targets(size)
    out = mixing.copies(frame).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in out) == Counter((d, s, len(words(t))) for d, s, t in rows_of(frame, "doc_id", "source", "text"))
    taken, largest = Counter(), Counter()
    for r in out:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - t) <= largest[s] + 1 for s, t in target.items())
    again = mixing.copies(frame.repartition(5)).collect()
    key = lambda r: (r["doc_id"], r["copies"])
    assert Counter(map(key, out)) == Counter(map(key, again))
    plain = Counter()
    for r in out:
        plain[r["doc_id"], r["source"]] += r["copies"]
    assert Counter(rows_of(mixing.mix(frame), "doc_id", "source")) == +plain and mixing.mix(frame).columns == frame.columns


def test_mixing_repeated_rows(spark):
    rows = [(i // 2, "w " * (1 + i // 6), "a" if i % 3 else None) for i in range(60)] + [(None, "x y", "a")] * 30
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    n = sum(r["copies"] for r in mixing.copies(frame).collect())
    assert mixing.mix(frame).count() == mixing.mix(frame.repartition(7)).count() == n


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 30_000 + "</p>"
    same = "s" * 1500
    rows = [(1, "http://a/1", same), (2, None, same), (3, "http://a/3\r\nX: y", "short"), (4, "http://a/4", "short"), (5, "u", None), (6, "u", ""), (7, "u", big), (8, "u", same), (9, "u", "a\r\n\r\nb"), (9, "u", "a\r\n\r\nb"), (None, "u", "z" * 2000)]
    out = warc.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2))
    want = Counter()
    for page, _, html in rows:
        b = (html or "").encode()
        revisit = html == same and page != 8
        want[page, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 8 if revisit else None] += 1
    got = out.collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert all(r["problem"] is None for r in got) and max(r["segments"] for r in got) == 4


def test_warc_parts():
    payload = bytes(range(256)) * 100
    assert warc.unchunked(warc.chunked(payload, 999)) == payload and warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"4\r\nabc\r\n0\r\n\r\n")


def write_archive(spark, path, records, per_record=False):
    """records as one gzipped archive, with one gzip member for all or for each."""
    import gzip
    import os

    os.makedirs(path)
    members = [r + b"\r\n\r\n" for r in records]
    with open(f"{path}/part-0.warc.gz", "wb") as f:
        f.write(b"".join(map(gzip.compress, members)) if per_record else gzip.compress(b"".join(members)))


def test_warc_notices_missing_segments(spark):
    path = new_path(spark, "test")
    records = warc.page_records(1, 0, "u", b"x" * 40_000, None)
    write_archive(spark, path, [records[0], records[2]])
    assert [r["problem"] for r in warc.read_archives(spark, path).collect()] == ["a segment is missing"]


def foreign(kind, name, block, *headers):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *headers, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


@pytest.mark.parametrize("per_record", [False, True])
def test_warc_of_others(spark, per_record):
    """Any record ids, one gzip member for each record, records that are no pages, broken framing, revisits that lead nowhere."""
    http, page = "Content-Type: application/http; msgtype=response", b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nhello"
    sha = hashlib.sha1(b"hello").hexdigest()
    records = [
        foreign("warcinfo", "urn:uuid:1", b"software: x\r\n", "Content-Type: application/warc-fields"),
        foreign("request", "urn:uuid:2", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        foreign("response", "urn:uuid:3", page, http, f"WARC-Payload-Digest: sha1:{sha}"),
        foreign("response", "urn:uuid:4", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhelloXX", http),
        foreign("resource", "http://any/id?x=1", b"raw\r\n\r\nbytes", "Content-Type: text/plain", "WARC-Payload-Digest: md5:123"),
        foreign("revisit", "urn:uuid:6", b"HTTP/1.1 200 OK\r\n\r\n", http, "WARC-Refers-To: <urn:uuid:3>", f"WARC-Payload-Digest: sha1:{sha}"),
        foreign("revisit", "urn:uuid:7", b"HTTP/1.1 200 OK\r\n\r\n", http, "WARC-Refers-To: <urn:uuid:99>", f"WARC-Payload-Digest: sha1:{sha}"),
        foreign("revisit", "urn:uuid:8", b"HTTP/1.1 200 OK\r\n\r\n", http, "WARC-Refers-To: <http://any/id?x=1>", f"WARC-Payload-Digest: sha1:{sha}"),
        foreign("response", "urn:uuid:9", page, http, f"WARC-Payload-Digest: sha1:{'0' * 40}"),
    ]
    path = new_path(spark, "test")
    write_archive(spark, path, records, per_record)
    got = {r["record_id"]: (r["record_type"], r["payload_bytes"], r["problem"]) for r in warc.read_archives(spark, path).collect()}
    assert got == {
        "<urn:uuid:3>": ("response", 5, None),
        "<urn:uuid:4>": ("response", None, "a chunk does not end where it should"),
        "<http://any/id?x=1>": ("resource", 12, None),
        "<urn:uuid:6>": ("revisit", 5, None),
        "<urn:uuid:7>": ("revisit", None, "the record that it refers to is missing"),
        "<urn:uuid:8>": ("revisit", 12, "the digest is not that of the record that it refers to"),
        "<urn:uuid:9>": ("response", 5, "the digest does not match"),
    }


def test_warc_that_is_cut_off(spark):
    path = new_path(spark, "test")
    records = warc.page_records(1, 0, "u", b"x" * 400, None)
    write_archive(spark, path, [*records, records[0][:-7]])
    got = warc.read_archives(spark, path).collect()
    assert Counter((r["page_id"], r["problem"]) for r in got) == {(1, None): 1, (None, "the archive is cut off"): 1}


def test_unzipping_in_pieces(monkeypatch):
    import gzip

    monkeypatch.setattr(warc, "PIECE", 64)
    data = np.random.default_rng(0).integers(0, 4, 5000, np.uint8).tobytes()
    zipped = b"".join(gzip.compress(data[i : i + 700]) for i in range(0, 5000, 700)) + b"\0" * 5
    assert b"".join(warc.unzipped(memoryview(zipped))) == data
    records = [foreign("resource", f"urn:{i}", data[: 37 * i]) for i in range(9)]
    assert [b for _, b in warc.records_of(warc.unzipped(memoryview(b"".join(gzip.compress(r + b"\r\n\r\n") for r in records))))] == [data[: 37 * i] for i in range(9)]


def brute_contamination(frame, items):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, text in items:
        w = norm(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(item)
    out = Counter()
    for doc, text in texts(frame):
        w, hit, found = norm(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        found = sorted(str(x) for x in found if x is not None)
        out[doc, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.mark.parametrize("which", ["docs", "odd"])
@pytest.mark.parametrize("bits", [decontam.MOST_BITS, 64, 0])
def test_contamination(spark, request, which, bits, monkeypatch):
    """Also with a map so small that nearly all positions pass, and with a shuffle in place of the broadcast."""
    frame = request.getfixturevalue(which)
    items = [(1, "One, TWO!"), (2, " ".join(_WORDS[3:18])), (3, ""), (4, None), (5, "one two"), (None, "middle"), (77, "same " * 12), (8, "absent words")]
    bench = spark.createDataFrame(items, "item_id bigint, text string") if which == "odd" else table(spark, SF, "benchmark")
    monkeypatch.setattr(decontam, "MOST_BITS", bits)
    monkeypatch.setattr(decontam, "JOINED", 0 if bits == 0 else decontam.JOINED)
    got = Counter(rows_of(decontam.contamination(frame, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
    assert got == brute_contamination(frame, rows_of(bench, "item_id", "text"))


def test_contamination_removal(odd, spark, empty):
    bench = spark.createDataFrame([(1, "one two")], "item_id bigint, text string")
    kept = {r[0] for r in rows_of(decontam.remove_documents(odd, bench), "doc_id")}
    assert kept == {r[0] for r in ODD} - {7, 8}
    assert dict(rows_of(decontam.remove_spans(odd, bench), "doc_id", "text"))[7] == ""
    assert decontam.remove_documents(odd, bench.where("false")).count() == len(ODD)


@pytest.mark.parametrize("lists", [None, 5])
def test_vectors(spark, lists):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(40, 24))
    rows = [(i, (centers[i % 40] + rng.normal(size=24) * 0.13 * (i % 4)).tolist(), i % 3) for i in range(600)]
    nan, inf = float("nan"), float("inf")
    odd_rows = [(900, None, 1), (901, [0.0] * 24, 1), (902, [nan] + [1.0] * 23, 1), (903, [inf] + [1.0] * 23, 1), (904, rows[0][1], None), (905, [], 1), (906, [None] + [1.0] * 23, 1), (907, [3 * v for v in rows[0][1]], 0), (908, [-v for v in rows[0][1]], 0)]
    frame = spark.createDataFrame(rows + odd_rows, "vec_id bigint, embedding array<double>, label int").withColumn("uid", F.lit(1)).repartition(3)
    good = [r for r in rows + odd_rows if r[0] < 900 or r[0] in (907, 908)]
    x = np.array([r[1] for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in good])
    near = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    ids = [r[0] for r in good]
    root = roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    want = {i: (int(n), root[i], root[i] == i) for i, n in zip(ids, near.sum(1), strict=True)} | {r[0]: (0, r[0], True) for r in odd_rows if r[0] not in root}
    got = {r[0]: r[1:] for r in rows_of(pq.near_vectors(frame, lists=lists), "vec_id", "n_links", "component_id", "kept")}
    assert near.sum() > 100 and got == want  # recall 1 against brute force


@pytest.mark.parametrize("rank", [1, 2, 8])
def test_vectors_that_differ_in_few_dimensions(spark, rank, monkeypatch):
    """Several lists share a group of near copies, so that links cross borders along just the dimensions in which copies differ."""
    monkeypatch.setattr(pq, "COMPONENTS", 1, raising=False)  # blocks of 256
    rng = np.random.default_rng(rank)
    groups = []
    for _ in range(2):
        center = rng.normal(size=64)
        noise = rng.uniform(-1, 1, (900, rank)) @ np.linalg.qr(rng.normal(size=(64, rank)))[0].T
        groups.append(center / np.linalg.norm(center) + noise * 0.35 / np.sqrt(rank))
    x = np.concatenate([*groups, rng.normal(size=(400, 64))])
    x = x[rng.permutation(len(x))]
    frame = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>, label int")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    root = roots(range(len(x)), zip(*(a.tolist() for a in np.nonzero(near)), strict=True))
    got = {r[0]: r[1:] for r in rows_of(pq.near_vectors(frame, lists=24), "vec_id", "n_links", "component_id", "kept")}
    assert near.sum() > 10_000
    assert sum(r[0] for r in got.values()) == near.sum()
    assert got == {i: (int(n), root[i], root[i] == i) for i, n in enumerate(near.sum(1))}


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=24).tolist(), 1) for i in range(20)]
    rows += [(30, [1.0, 2.0, 3.0], 1), (31, [2.0, 4.0, 6.0], 1), (32, [1.0, 2.0, 3.0], 2), (33, [-1.0, 0.5, 3.0], 1), (40, [1.0], 1), (41, [5.0], 1), (50, [1.0] * 7, 1)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r[0]: r[1:] for r in rows_of(pq.near_vectors(frame), "vec_id", "n_links", "component_id", "kept")}
    pairs = {30: 30, 31: 30, 40: 40, 41: 40}
    assert got == {r[0]: (int(r[0] in pairs), pairs.get(r[0], r[0]), pairs.get(r[0], r[0]) == r[0]) for r in rows}


def test_licenses():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    mit = licenses.TEMPLATES["MIT"].text
    changed = mit.replace("merge", "join").replace("OTHER LIABILITY", "other")
    for text, want in ((mit, "MIT"), ("Some words before. " + changed + " And after.", "MIT"), ("Intro.\nReleased under the MIT License.\nOutro", "MIT notice")):
        assert want in [f[0] for f in scanner.scan(text)[1]]
    assert scanner.scan("free of charge words without any licence") [1] == [] and scanner.scan(None) == (0, [])
    assert scanner.scan("the License " * 500 + "Released under the MIT License. " + "the under " * 500)[1][0][0] == "MIT notice"


def test_licenses_that_stand_several_times_with_changes():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    found = lambda text: [f[0] for f in scanner.scan(text)[1]]
    mit = licenses.TEMPLATES["MIT"].text.replace("sublicense", "relicense")
    assert "MIT" in found(mit) and "MIT" in found(f"Start. {mit} Between. {mit} End.")
    assert "MIT notice" in found("Start. Distributed under the MIT License. Between. Distributed under the MIT License. End.")
    assert "MIT" in found(f"Start. {mit} {'word ' * 5000} {mit} {'other ' * 5000} you may sublicense it.")
    twice = scanner.scan(f"Start. {mit} Between. {mit} End.")[1]
    n = len(licenses.words_of(mit))
    assert next(f[2:] for f in twice if f[0] == "MIT") in ((n - 1, 1, n), (n - 1, n + 2, 2 * n + 1))


def test_license_stretches_against_all_windows():
    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *itertools.accumulate(range(len(b)), lambda left, j: max(left, row[j + 1], (row[j] + 1) if x == b[j] else 0), initial=0)][1:]
        return row[-1]

    rng = np.random.default_rng(5)
    n_found = 0
    for case in range(150):
        template = [f"w{x}" for x in rng.integers(0, 9, rng.integers(3, 9))]
        text: list[str] = []
        for _ in range(rng.integers(1, 4)):
            copy = [w if rng.random() < 0.85 else "changed" for w in template]
            text += [f"w{x}" for x in rng.integers(0, 12, rng.integers(0, 12))] + (copy if case % 3 else [])
        reach = licenses.reach_of(template)
        windows = [text[i : i + reach] for i in range(len(text))]
        pairs = licenses.align(text, template)
        whole = len(pairs) if pairs and pairs[-1][0] - pairs[0][0] < reach else 0
        patience = max((len(licenses.align(w[:k], template)) for w in windows for k in range(1, len(w) + 1)), default=0)
        want = max(whole, *(longest(w, template) for w in windows), 0)
        out = licenses.Scanner({"t": licenses.Template(" ".join(template))}, 0.8).scan(" ".join(text))[1]
        assert want >= patience and bool(out) == (want >= 0.8 * len(template))
        if out:
            n_found += 1
            assert out[0][2] == want and text[out[0][3]] in template and text[out[0][4]] in template
        pairs = licenses.densest(text, template, 1)
        assert all(text[i] == template[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs[:-1], pairs[1:], strict=True))
        assert not pairs or pairs[-1][0] - pairs[0][0] < reach
    assert 30 < n_found < 150


@pytest.mark.parametrize(
    "text, want",
    [
        ("Released under the Apache License.", None),
        ("Licensed under CC BY 4.0.", "CC-BY-4.0 notice"),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0 notice"),
        ("Licensed under CC BY NC 4.0.", None),
        ("Licensed under the Mozilla Public License, Version 2.0.", "MPL-2.0 notice"),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0 notice"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0 notice"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0 notice"),
        ("The film was released in May. Under the new rules, the driver lost his license.", None),
        ("Released in May under the new rules the MIT people lost their License.", None),
        ("Released under the Apache License. Distributed under the MIT License.", "MIT notice"),
        (licenses.TEMPLATES["BSD-3-Clause"].text, "BSD-3-Clause"),
        (licenses.TEMPLATES["BSD-2-Clause"].text, "BSD-2-Clause"),
        (licenses.TEMPLATES["LGPL-2.1 header"].text, "LGPL-2.1 header"),
    ],
)
def test_licenses_that_share_phrases(text, want):
    for t in (text, f"Intro words. {text} And an end."):
        found = [f[0] for f in licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE).scan(t)[1]]
        assert found == ([want] if want else [])


def test_license_scan_of_documents(spark):
    """The lines of the documents that name a licence, found by their plain words."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    lines = {
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0 notice",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0 notice",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0 notice",
        "Released under the MIT License.": "MIT notice",
    }
    want = {d: sorted(name for line, name in lines.items() if line in (t or "")) for d, t in texts(docs)}
    got = {d: sorted(found) for d, found in rows_of(licenses.scan_licenses(docs), "doc_id", "found")}
    assert got == want and sum(map(bool, want.values())) > 20


def test_patience_alignment_is_an_increasing_match():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = ([f"w{x}" for x in rng.integers(0, 12, rng.integers(0, 30))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs[:-1], pairs[1:], strict=True))
    assert len(licenses.align(list("abcde"), list("abcde"))) == 5


def test_license_scan(odd, empty):
    out = licenses.scan_licenses(odd.withColumn("text", F.when(F.col("doc_id") == 7, "Licensed under CC BY-NC 4.0.").otherwise(F.col("text"))))
    assert {r["doc_id"]: r["license"] for r in out.collect() if r["license"]} == {7: "CC-BY-NC-4.0 notice"} and out.count() == len(ODD)


def test_toxicity_held_out():
    rng = np.random.default_rng(2)
    clean = ["".join(rng.choice(list("abdefghilmnoprstu"), 6)) for _ in range(500)]
    bad = ["worthless", "stupid", "disgusting"]

    def text(toxic, misspelt):
        w = list(rng.choice(clean, int(rng.integers(5, 120))))
        if toxic:
            b = str(rng.choice(bad))
            w[int(rng.integers(len(w)))] = b[:4] + b[3:] if misspelt else b
        return " ".join(w)

    y = rng.integers(0, 2, 800)
    model = toxicity.train(pa.array([text(t, False) for t in y]), y)
    test = rng.integers(0, 2, 300)
    for misspelt, least in ((False, 0.95), (True, 0.8)):
        scores = model.scores(pa.array([text(t, misspelt) for t in test]))
        assert ((scores >= toxicity.THRESHOLD) == test).mean() > least
    assert ((0 <= scores) & (scores <= 1)).all() and len(model.scores(pa.array(["", None, " . "]))) == 3


def test_toxicity_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 12)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(odd, labels)
    out = toxicity.score(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert 0 < toxicity.fit(odd, labels.where("false")).scores(pa.array(["x"]))[0] < 1


def test_one_long_text_does_not_empty_a_class(spark, monkeypatch):
    """Every text comes first in some order, so the long ones are made longer than the bound in turn."""
    docs, labels = table(spark, SF, "documents").where("text IS NOT NULL"), table(spark, SF, "labels")
    toxic = [r["doc_id"] for r in labels.where("toxic = 1").orderBy(F.xxhash64("doc_id")).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 400_000)
    monkeypatch.setattr(toxicity, "LONG_BYTES", 100_000)
    longer = docs.withColumn("text", F.when(F.col("doc_id") == toxic[0], F.repeat("text", F.lit(500_000))).otherwise(F.col("text")).substr(1, 500_000))
    scores = toxicity.fit(longer, labels).scores(pa.array(["you are a worthless idiot", "hello there"]))
    assert scores[0] > scores[1] + 0.3
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 3)
    with pytest.raises(ValueError, match="no text of some class"):
        toxicity.fit(docs.where(F.length("text") > 3), labels)


def test_toxic_rows_go_alone(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.fit(docs, labels)
    by_score = sorted(((r["score"], r["doc_id"]) for r in toxicity.score(docs, model).collect()))
    text = dict(texts(docs))
    bad, good = text[by_score[-1][1]], text[by_score[0][1]]
    rows = [(None, good, "en", "a", 1), (None, bad, "en", "a", 1), (None, None, "en", "a", 1), (7, good, "en", "b", 1), (7, bad, "en", "b", 1), (8, bad, "en", "b", 1)]
    left = toxicity.remove_toxic(docs.unionByName(spark.createDataFrame(rows, docs.schema)), labels)
    odd_rows = left.where("doc_id IS NULL OR (doc_id IN (7, 8) AND source = 'b' AND n_chars = 1)")
    assert Counter((r["doc_id"], r["text"]) for r in odd_rows.collect()) == Counter([(None, good), (None, None), (7, good)])


def test_contaminated_rows_go_alone(spark):
    rows = [(None, "fine words"), (None, "one two here"), (None, None), (3, "one two"), (3, "clean")]
    bench = spark.createDataFrame([(1, "one two")], "item_id bigint, text string")
    left = decontam.remove_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), bench)
    assert Counter(map(tuple, left.collect())) == Counter([(None, "fine words"), (None, None), (3, "clean")])


def brute_repeats(frame):
    byid = {d: words(t) for d, t in texts(frame)}
    seen, out = set(), {}
    for d in sorted(byid):
        w, gone = byid[d], set()
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone |= set(range(i, i + 20))
            seen.add(key)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return Counter(out[d] for d, _ in texts(frame))


@pytest.mark.parametrize("which", ["docs", "odd"])
@pytest.mark.parametrize("chunk, fanout", [(substring.CHUNK, substring.FANOUT), (3000, substring.FANOUT), (3000, 3)])
def test_repeats(request, which, chunk, fanout, monkeypatch):
    """Also with small chunks, and with so few blocks for each that groups of buckets are divided twice."""
    frame = request.getfixturevalue(which)
    monkeypatch.setattr(substring, "CHUNK", chunk)
    monkeypatch.setattr(substring, "FANOUT", fanout)
    assert Counter(rows_of(substring.remove_repeats(frame), "doc_id", "n_words", "n_removed", "kept_sha256")) == brute_repeats(frame)


def test_texts_travel_compressed(docs, monkeypatch):
    """What is joined with positions holds every text of its documents, in half its bytes."""
    text = dict(texts(docs))
    _, candidates = substring.repeated_windows(docs)
    batch = candidates.select("doc_id", "text").toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(substring, "CHUNK", 10_000)
    parts = list(substring._expanded([batch]))
    got = [(d, t) for part in parts for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
    assert len(parts) > 5 and [d for d, _ in got] == batch.column(0).to_pylist() and all(text[d] == t for d, t in got)
    assert sum(map(len, batch.column(1).to_pylist())) < 0.55 * sum(len(t.encode()) for _, t in got)


def test_compressed_texts_are_read_a_part_at_a_time(monkeypatch):
    monkeypatch.setattr(substring, "CHUNK", 1000)
    data = ["a" * 300, None, "", "é" * 200, "b" * 5000, "", None, "c"]
    sent = list(substring._squeezed([pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(data)], ["doc_id", "text"])]))
    back = list(substring._expanded(sent))
    assert [t for part in back for t in part.column(1).to_pylist()] == data and [part.num_rows for part in back] == [4, 1, 3]
    assert sum(len(x or b"") for x in sent[0].column(1).to_pylist()) < 200


def test_difference_cover():
    assert all(any((i + s) % substring.PERIOD in substring.COVER and (j + s) % substring.PERIOD in substring.COVER for s in range(substring.PERIOD)) for i in range(13) for j in range(13))


def test_window_hashes():
    data = pa.array(["a b c d e", None, "", "b c d", " a  b c d e "])
    (_, _, w), = list(hashing.chunks(data))
    at, h = w.windows(3)
    assert w.counts().tolist() == [5, 0, 0, 3, 5] and len(h) == 7
    assert h[1] == h[3] and h[0] == h[4] and len(set(h.tolist())) == 3


def test_word_hashes_have_no_twins():
    """Words that are equal under polynomial hashes modulo 2 ** 64 whatever the base, and all short words of a kind."""
    thue = "a"
    while len(thue) < 1024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))
    texts = [thue, other, thue[:200], other[:200], "a\0"[:1], "aa", "a" * 300, "a" * 301, "a" * 8, "a" * 9, "a" * 16, *(f"{i}" for i in range(5000))]
    ((_, _, w),) = hashing.chunks(pa.array(texts))
    assert len(w.hashes) == len(texts) == len(set(w.hashes.tolist()))
    again = hashing.hash_spans(w.data, w.starts, w.ends, seed=1)
    assert len(set(again.tolist())) == len(texts) and not (again == w.hashes).any()
    values = np.arange(40, dtype=np.uint64) % np.uint64(7)
    for k in (1, 2, 3, 5, 8, 20, 21):
        h = hashing.runs(values, k)
        same = {tuple(values[i : i + k].tolist()): h[i].item() for i in range(41 - k)}
        assert len(h) == 41 - k and all(same[tuple(values[i : i + k].tolist())] == h[i] for i in range(41 - k)) and len(set(same.values())) == len(same)


def test_empty_tables(spark, empty):
    assert planes.token_table(empty, queries.tokenizer_path(), 2).count() == 0
    assert ring.assign(empty, 16).count() == 0
    assert minhash.near_duplicates(empty).count() == 0
    assert mixing.copies(empty).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    assert decontam.contamination(empty, spark.createDataFrame([], "item_id bigint, text string")).count() == 0
    assert pq.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0
    assert licenses.scan_licenses(empty).count() == 0
    assert toxicity.score(empty, toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), 0.0)).count() == 0
    assert substring.remove_repeats(empty).count() == 0
