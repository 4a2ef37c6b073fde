"""Vocabularies, snapshot stores, stored reports, the inverted index and the cascade against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.functions.text import window_spans
from factloom.operators import index, reports, vocabulary
from factloom.operators.retrieval import bm25
from factloom.plans import cascade
from factloom.plans.ask import CHUNKS, EXACT, NONE, RELAXED, search_facts
from factloom.sources import snapshots
from factloom.sources.tables import fact_rows, load

SF = "/root/testdata/sf0.001"

# ---- vocabularies


def plain_tokens(text):
    return re.findall(r"[^\W_]+", re.sub(r"\s+", " ", (text or "").strip(" ").lower().replace("ё", "е")))


def plain_match(text, words):
    """Every run of tokens looked at, and every spelling tried on it; words: (domain, key, n_tokens)."""
    t = plain_tokens(text)
    lengths = {n for _, _, n in words} | set(vocabulary.APART)
    met = {(d, i, i + n, key) for d, key, _ in words for n in lengths for i in range(len(t) - n + 1) if "".join(t[i : i + n]) == key}
    return {m for m in met if not any(o[0] == m[0] and o[1] <= m[1] and m[2] <= o[2] and o[1:3] != m[1:3] for o in met)}


REGISTRY = [
    ("m", "Ti-6Al-4V", "titanium"), ("m", "ti 6al 4v alloy", "alloy"), ("m", "nickel", "Ni"), ("m", "Nickel sulfate", "NiSO4"), ("m", "ni", "Ni"), ("p", "nickel sulfate solution at rest", "solution"),
    ("p", "ёмкость", "capacity"), ("p", "---", "nothing"), ("p", None, "nothing"), (None, "x", "x"), ("m", "heat-treated", "heat"), ("m", "heat treated", "late"), ("p", "a a", "twice"),
]
TEXTS = ["ti6al4v and TI-6AL 4V alloy", "Nickel  sulfate solution at rest; nickel, ni", "Емкость ёмкость ЁМКОСТЬ", "", None, "--- !!", "heat_treated nickelsulfate", "a a a a", "nick el ni ck el " + "z " * 300 + "nickel"]


def test_vocabulary_against_trial(spark):
    words = vocabulary.vocabulary(spark.createDataFrame(REGISTRY, "domain string, alias string, canonical string"))
    rows = [tuple(r) for r in words.select("domain", "key", "n_tokens").collect()]
    assert ("m", "heattreated", 2) in rows and {r[0] for r in rows} == {"m", "p"} and "" not in {r[1] for r in rows}
    assert {r["key"]: r["canonical"] for r in words.collect()}["heattreated"] == "late"  # a blank comes before a hyphen
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").repartition(3)
    keyed = vocabulary.match(texts, ["id"], words).join(words.select("domain", "alias_norm", "key"), ["domain", "alias_norm"])
    have = {(r["id"], r["domain"], r["start"], r["end"], r["key"]) for r in keyed.collect()}
    assert have == {(i, *m) for i, text in enumerate(TEXTS) for m in plain_match(text, rows)}


def test_fixed_spellings_win(spark):
    registry = spark.createDataFrame([("material", "Nickel", "from the registry"), ("material", "brine", "brine")], "domain string, alias string, canonical string")
    found = {r["key"]: r["canonical"] for r in vocabulary.vocabulary(registry, vocabulary.fixed_vocabulary(spark)).where("domain = 'material'").collect()}
    assert found["nickel"] == "никель" and found["brine"] == "brine"


def test_a_hundred_thousand_spellings(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 5)))
    spellings = {" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(160_000)}
    assert len(spellings) > 100_000
    texts = [" ".join(word() for _ in range(80)) for _ in range(60)]
    words = vocabulary.vocabulary(spark.createDataFrame([("x", s, s) for s in sorted(spellings)], "domain string, alias string, canonical string"))
    have = {(r["id"], r["start"], r["end"]) for r in vocabulary.match(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), ["id"], words).collect()}
    keys = {s.replace(" ", "") for s in spellings}
    want = set()
    for i, text in enumerate(texts):
        t = text.split()
        met = [(a, a + n) for n in (1, 2, 3) for a in range(len(t) - n + 1) if "".join(t[a : a + n]) in keys]
        want |= {(i, a, b) for a, b in met if not any(c <= a and b <= d and (c, d) != (a, b) for c, d in met)}
    assert have == want and len(want) > 500


# ---- spans


def test_windows_stand_in_the_text(spark):
    rng = random.Random(3)
    texts = ["", None, "   ", "one", "  one two  ", " \t".join(f"w{i}é" for i in range(1200)), "𝄞 " * 401, "\n".join("x" * rng.randint(1, 9) for _ in range(760)) + "  "]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", F.posexplode(window_spans(F.col("text"))).alias("k", "w")).select("id", "k", "w.*").collect()
    have = {(r["id"], r["k"]): (r["start"], r["n_words"], r["char_start"], r["char_end"]) for r in rows}
    want = {}
    for i, text in enumerate(texts):
        places = [m.span() for m in re.finditer(r"[^ \t\n\r\f\x0B]+", text or "")]
        n = len(places)
        for k, s in enumerate([] if not n else [0] if n <= 400 else range(0, n, 350)):
            last = min(n, s + 400)
            want[i, k] = (s, last - s, places[s][0], places[last - 1][1])
    assert have == want


# ---- stores


def files(spark, **named):
    return spark.createDataFrame([(n.replace("_", "."), t) for n, t in named.items()], "name string, text string")


@pytest.fixture
def store(spark):
    store = snapshots.new_store(spark)
    snapshots.create(store)
    return store


def statuses(store):
    last = store.latest()
    return {r["name"]: (r["status"], r["version"], r["chunks_added"], r["chunks_removed"]) for r in store.read("deltas").where(F.col("commit") == last).collect()}


LONG = " ".join(f"w{i}" for i in range(1000))


def test_ingest_versions(spark, store):
    snapshots.ingest(store, files(spark, a_txt="one two", b_txt=LONG, c_txt=""))
    assert statuses(store) == {"a.txt": ("new", 1, 1, 0), "b.txt": ("new", 1, 3, 0), "c.txt": ("skipped_empty", None, 0, 0)}
    snapshots.ingest(store, files(spark, a_txt="one two", b_txt="short now", d_txt="new"))
    assert statuses(store) == {"a.txt": ("unchanged", 1, 0, 0), "b.txt": ("changed", 2, 1, 3), "d.txt": ("new", 1, 1, 0)}
    snapshots.ingest(store, files(spark, b_txt=LONG, a_txt=None), complete=True)
    assert statuses(store) == {"a.txt": ("skipped_empty", 1, 0, 0), "b.txt": ("changed", 1, 3, 1), "d.txt": ("removed", 1, 0, 1)}
    assert {(r["name"], r["version"]) for r in store.live("documents").collect()} == {("a.txt", 1), ("b.txt", 1)}
    chunks = store.live("chunks").where("name = 'b.txt'").orderBy("ordinal").collect()
    assert [r["text"] for r in chunks] == [LONG[r["char_start"] : r["char_end"]] for r in chunks] and len(chunks) == 3
    # Earlier versions can still be read.
    assert {r["name"] for r in store.live("documents", 2).collect()} == {"a.txt", "b.txt"} and store.live("chunks", 3).where("name = 'b.txt'").count() == 1
    # A name that was removed comes back as what it was, and other content of it is the next version.
    snapshots.ingest(store, files(spark, d_txt="new"))
    assert statuses(store) == {"d.txt": ("new", 1, 1, 0)}
    snapshots.ingest(store, files(spark, d_txt="newer"))
    assert statuses(store) == {"d.txt": ("changed", 2, 1, 1)}


def test_crash_before_the_manifest(spark, store, monkeypatch):
    snapshots.ingest(store, files(spark, a_txt="one"))
    before = sorted(map(tuple, store.live("chunks").collect()))

    def crash(*_args, **_kw):
        raise RuntimeError("gone")

    with monkeypatch.context() as m:
        m.setattr(snapshots.Store, "commit", crash)
        with pytest.raises(RuntimeError, match="gone"):
            snapshots.ingest(store, files(spark, a_txt="two", b_txt="three"))
    assert store.latest() == 2 and sorted(map(tuple, store.live("chunks").collect())) == before
    snapshots.ingest(store, files(spark, a_txt="two", b_txt="three"))
    assert statuses(store) == {"a.txt": ("changed", 2, 1, 1), "b.txt": ("new", 1, 1, 0)}
    assert store.vacuum(keep=1) > 0 and store.vacuum(keep=1) == 0
    assert {r["text"] for r in store.live("chunks").collect()} == {"two", "three"}


def test_only_one_of_two_commits_succeeds(spark, store):
    base = store.latest()
    snapshots.ingest(store, files(spark, a_txt="one"))
    with pytest.raises(snapshots.Conflict):
        store.commit(base, {"removed": store.write(spark.createDataFrame([("a.txt", 9)], snapshots.REMOVED))})
    assert store.live("documents").count() == 1


def test_compaction_keeps_what_is_live(spark, store):
    for text in ("one", "two", "three"):
        snapshots.ingest(store, files(spark, a_txt=text, b_txt="same"))
    before = sorted(map(tuple, store.live("chunks").collect()))
    store.compact(["documents", "chunks"])
    assert len(store.manifest()["chunks"]["folders"]) == 1 and sorted(map(tuple, store.live("chunks").collect())) == before
    snapshots.ingest(store, files(spark, a_txt="four"))
    assert {r["text"] for r in store.live("chunks").collect()} == {"four", "same"}


def test_odd_files(spark, store):
    rows = [(None, "no name"), ("a", "x"), ("a", "y"), ("a", "x"), ("", "empty name"), ("b", " \n ")]
    frame = spark.createDataFrame(rows, "name string, text string").withColumn("commit", F.lit("clash")).withColumn("h", F.lit(1))
    snapshots.ingest(store, frame)
    assert {n: s[0] for n, s in statuses(store).items()} == {"a": "new", "": "new", "b": "new"} and statuses(store)["b"][2] == 0
    snapshots.ingest(store, spark.createDataFrame([], "name string, text string"))
    assert statuses(store) == {} and store.live("documents").count() == 3
    snapshots.ingest(store, spark.createDataFrame([], "name string, text string"), complete=True)
    assert store.live("documents").count() == 0


def test_recompute_only_what_is_new(spark, store):
    seen = []

    def work(rows):
        seen.append(rows.count())
        return rows.select("id", "h", F.length("text").alias("n"))

    rows = lambda *texts: spark.createDataFrame([(i, str(hash(t)), t) for i, t in enumerate(texts)], "id int, h string, text string")
    for rule, texts in (("r1", ("a", "bb")), ("r1", ("a", "ccc")), ("r1", ("a", "ccc")), ("r2", ("a", "ccc"))):
        snapshots.recompute(store, "lengths", rows(*texts), ["id", "h"], rule, work)
    assert seen == [2, 1, 0, 2]
    assert Counter((r["rule"], r["n"]) for r in store.read("lengths").collect()) == Counter([("r1", 1), ("r1", 2), ("r1", 3), ("r2", 1), ("r2", 3)])


# ---- reports


def test_delta_of_reports(spark):
    schema = "document_id bigint, chunk_id bigint, seq string, material string, regime string, property string, value double, unit string, effect string"
    row = lambda d, m, v, effect="unknown", c=1: (d, c, f"{d}-{c}", m, "R", "strength", v, "MPa", effect)
    store = snapshots.new_store(spark)
    old = reports.store_report(store, spark.createDataFrame([row(1, "A", 10.0), row(1, "B", 60.0), row(2, "C", 70.0), row(3, "D", 80.0), row(4, "D", 80.0)], schema))
    new = reports.store_report(store, spark.createDataFrame([row(1, "A", 10.0), row(5, "A", 20.0), row(1, "B", 60.0), row(6, "B", 60.0), row(3, "D", 80.0), row(7, "E", 5.0)], schema))
    states = {r["key"].split("|")[0] + r["key"].split("|")[3]: r["state"] for r in reports.fact_delta(store, old, new).collect()}
    assert states == {"a10": "unchanged", "a20": "new", "b60": "corroborated", "c70": "removed", "d80": "weakened", "e5": "new"}
    counts = reports.delta_counts(store, old, new).first()
    assert counts["new_conflicts"] == 1 and counts["new_gaps"] == 1 and counts["new_materials"] == 1 and counts["new_triples"] == 1
    assert counts["new_nodes"] == 2 + 1 + 1 and counts["new_edges"] == 2 * 4 + 3 + counts["new_opportunities"]


# ---- the index


def test_index_equals_the_scan(spark):
    docs = load(spark, SF, "documents")
    store = snapshots.new_store(spark)
    index.build(store, docs.unionByName(spark.createDataFrame([(10**6, None, "en", "a", 0), (10**6 + 1, "", None, None, None)], docs.schema)), per_range=8)
    asked = ["the of license", "The THE the", "qqqq zzzz", "", None, "and " * 3 + "the-of über"]
    results, work = index.search(store, spark.createDataFrame(list(enumerate(asked)), "q int, text string"), ["q"], 7)
    have = {}
    for r in results.collect():
        have.setdefault(r["q"], []).append((r["rank"], r["id"], r["score"]))
    whole = docs.unionByName(spark.createDataFrame([(10**6, None, "en", "a", 0), (10**6 + 1, "", None, None, None)], docs.schema))
    for q, text in enumerate(asked):
        scored = sorted(((-round(r["score"], 6), r["id"]) for r in bm25(whole, text).collect()), key=lambda x: x) if text else []
        want = [(i + 1, d, -s) for i, (s, d) in enumerate(scored[:7])]
        assert [(a, b) for a, b, _ in sorted(have.get(q, []))] == [(a, b) for a, b, _ in want], text
        assert all(math.isclose(x[2], y[2], abs_tol=2e-6) for x, y in zip(sorted(have.get(q, [])), want, strict=True))
    assert all(r["n_read"] <= r["n_all"] for r in work.collect())


def test_index_skips_ranges(spark):
    """One document in forty is about the rare word; most ranges can't reach it."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["common", "usual", "plain"]) for _ in range(20)) + (" rare rare" if i % 40 == 0 else "")) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    store = snapshots.new_store(spark)
    index.build(store, docs, per_range=10)
    results, work = index.search(store, spark.createDataFrame([(1, "rare common")], "q int, text string"), ["q"], 10)
    want = sorted((-round(r["score"], 6), r["id"]) for r in bm25(docs, "rare common").collect())[:10]
    assert [r["id"] for r in results.orderBy("rank").collect()] == [i for _, i in want]
    done = work.first()
    assert done["n_read"] < 0.5 * done["n_all"]


# ---- the cascade


def test_cascade_equals_one_by_one(spark):
    facts, docs = fact_rows(spark, SF).cache(), load(spark, SF, "documents")
    key = ["conv_id", "turn"]
    store = snapshots.new_store(spark)
    index.build(store, docs)
    asked = cascade.constraints(cascade.question_rows(spark, SF), key, cascade.part_words(spark, SF)).cache()
    found = {(r["conv_id"], r["turn"]): r for r in cascade.cascade(asked, key, facts, store).collect()}
    questions = asked.collect()
    assert len(found) == len(questions) == load(spark, SF, "conversations").count()
    assert {r["status"] for r in found.values()} == {EXACT, RELAXED, CHUNKS, NONE}
    by_status = {}
    for q in questions:
        by_status.setdefault(found[q["conv_id"], q["turn"]]["status"], []).append(q)
    for same in by_status.values():
        for q in same[:6]:
            one = [q[c] for c in cascade.AXES]
            rows = facts if any(one) else facts.where(F.lit(False))
            status, result = search_facts(rows, *one, docs, q["text"])
            have = found[q["conv_id"], q["turn"]]
            assert (have["status"], have["n_rows"]) == (status, result.count()), q
    facts.unpersist()
    asked.unpersist()


def test_answers(spark):
    rows = [(1, 1, "material+regime", 3, 1.0, 2.25, "MPa"), (2, 2, "regime", 2, 1.0, 1.0, "MPa"), (3, 3, "", 5, None, None, None), (4, 4, "", 0, None, None, None)]
    found = cascade.answers(spark.createDataFrame(rows, "q int, level int, kept string, n_rows bigint, low double, high double, unit string"))
    assert [r["answer"] for r in found.orderBy("q").collect()] == [
        "3 facts meet all that was asked (material, regime): 1.0 to 2.3 MPa.",
        "No fact meets all that was asked; 2 facts meet a part of it (regime): 1.0 to 1.0 MPa.",
        "No structured fact was found; 5 chunks of text are relevant.",
        "Nothing relevant was found.",
    ]
