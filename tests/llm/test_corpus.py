"""SimHash, substring dedup and winnowing, and the pipeline, against brute force."""

import hashlib
import random
import re
from functools import lru_cache

import pytest
import xxhash

import corpus_pipeline
from strandex.llm import packing, quality, simhash, substring_dedup, winnowing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fingerprints, distance=2):
    """{doc: least doc reachable}"""
    root = {d: d for d in fingerprints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    items = sorted(fingerprints.items())
    for k, (a, x) in enumerate(items):
        for b, y in items[k + 1 :]:
            if (x ^ y).bit_count() <= distance and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in root}


def test_simhash(docs, rows, nothing):
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    want = {d: plain_fingerprint(t) for d, t, *_ in rows}
    assert {d: int(r["fingerprint"], 16) for d, r in found.items()} == want
    assert {d: r["component_id"] for d, r in found.items()} == plain_components(want)
    assert simhash.near_duplicates(nothing).count() == 0


def test_simhash_odd(odd):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == 6 and {r["component_id"] for r in found} == {1, 4}


def test_links_are_all_found(spark):
    r = random.Random(4)
    points = {r.getrandbits(64) for _ in range(40)}
    for p in list(points):
        for _ in range(6):
            q = p
            for _ in range(r.randint(1, 4)):
                q ^= 1 << r.randrange(64)
            points.add(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    for distance in (1, 2, 3):
        want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= distance}
        found = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), distance).collect()
        assert len(found) == len({tuple(x) for x in found}) and {tuple(x) for x in found} == want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 100), (300, 100)]
    found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}


def plain_dedup(rows, window=13):
    """{doc: (words, removed flags)}"""
    first, cut = {}, {}
    named = sorted((d, WORD.findall(t or "")) for d, t in rows if d is not None)
    for d, w in named:
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), d)
    for d, w in named:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < d:
                gone[k : k + window] = [True] * window
        cut[d] = w, gone
    return cut


@pytest.mark.parametrize("partitions", ["1", "4", "9"])
def test_substring_dedup(spark, docs, rows, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    found = {r["doc_id"]: r for r in substring_dedup.digests(docs).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = plain_dedup([(d, t) for d, t, *_ in rows])
    assert found.keys() == want.keys() and sum(r["n_removed"] for r in found.values()) > 100
    for d, (w, gone) in want.items():
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (found[d]["n_words"], found[d]["n_removed"], found[d]["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_substring_dedup_texts_and_paths(docs, rows):
    want = plain_dedup([(d, t) for d, t, *_ in rows])
    done = substring_dedup.remove_repeats(docs)
    assert done.columns == docs.columns
    for r in done.collect():
        w, gone = want[r["doc_id"]]
        assert WORD.findall(r["text"] or "") == [x for x, g in zip(w, gone, strict=True) if not g]
    words = {d: w for d, (w, _) in want.items()}
    covered = {d: set() for d in want}
    for p in substring_dedup.paths(docs).collect():
        here = words[p["doc_id"]][p["start"] : p["start"] + p["words"]]
        assert p["source_doc_id"] < p["doc_id"] and here == words[p["source_doc_id"]][p["source_start"] : p["source_start"] + p["words"]] and len(here) >= 13
        covered[p["doc_id"]].update(range(p["start"], p["start"] + p["words"]))
    assert covered == {d: {k for k, g in enumerate(gone) if g} for d, (_, gone) in want.items()}


def steps_here(parts, buckets=2, window=4, minimizer=2):
    """The steps of the operator one after the other in this process, over parts of rows (id, text): (found, told)."""
    import pyarrow as pa

    sub = substring_dedup
    docs = [pa.table({"__part": pa.array([p] * len(rows), pa.int32()), "__id": pa.array([i for i, _ in rows], pa.int64()), "__text": pa.array([t for _, t in rows], pa.string())}) for p, rows in enumerate(parts)]
    gather = lambda tables, key: {k: (t := pa.concat_tables(tables)).filter(pa.array([v == k for v in t.column(key).to_pylist()])) for k in {v for t in tables for v in t.column(key).to_pylist()}}
    seen = gather([sub._answer_minimizers(t) for t in gather([sub._send_minimizers(d, buckets, window, minimizer) for d in docs], "bucket").values()], "part")
    none = sub._rows([], sub.ANSWER)
    edges = gather([sub._answer_edges(t) for t in gather([sub._send_edges(d, seen.get(p, none), buckets, window, minimizer) for p, d in enumerate(docs)], "bucket").values()], "part")
    compacted = [sub._compact(d, edges[p], buckets, window, minimizer) for p, d in enumerate(docs)]
    asked = gather(compacted, "to")
    told = gather([sub._verify(d, asked[p]) for p, d in enumerate(docs)], "to")
    return compacted, told, [sub._finish(d, told[p], "paths", []).to_pylist() for p, d in enumerate(docs)]


def test_paths_are_compacted_and_verified():
    text = "a b c d e f g h"
    _, _, found = steps_here([[(1, "x y z " + text)], [(5, text + " tail"), (7, "q " + text + " r")]])
    want = [{"doc_id": 5, "start": 0, "words": 8, "source_doc_id": 1, "source_start": 3}, {"doc_id": 7, "start": 1, "words": 8, "source_doc_id": 1, "source_start": 3}]
    assert found == [[], want]


def test_a_part_asks_for_a_path_once_however_many_copies_it_has():
    text = "a b c d e f g h"
    compacted, _, found = steps_here([[(0, text)], [(k, text) for k in range(1, 50)]])
    asked = [r for t in compacted for r in t.to_pylist() if r["kind"] == 3]
    assert len(asked) == 1 and len(asked[0]["more"]) == substring_dedup.DIGEST
    assert len(found[1]) == 49


def test_colliding_hashes_remove_nothing(monkeypatch):
    import numpy as np

    monkeypatch.setattr(substring_dedup, "_polynomial", lambda h, n, length, base: np.zeros(n, np.uint64))
    compacted, _, found = steps_here([[(1, "a b c d e"), (2, "f g h i j")], [(3, "k l m n o")]])
    assert sum(r["kind"] == 3 for t in compacted for r in t.to_pylist()) > 0  # all windows look alike
    assert found == [[], []]


def test_rows_come_in_any_order():
    rows = [(3, "u v w x y z"), (1, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (2, None)]
    want = steps_here([rows, [(9, "z a b c d e f u v w x")]])[2]
    assert steps_here([rows[::-1], [(9, "z a b c d e f u v w x")]])[2] == want
    assert [p["source_doc_id"] for p in want[1]] == [1, 3]


def test_parts_follow_the_bytes_of_text():
    assert substring_dedup.sizes(0, 8) == (16, 8)
    parts, buckets = substring_dedup.sizes(10**12, 8)
    assert 10**12 / parts <= substring_dedup.PART_BYTES and 10**12 / buckets <= substring_dedup.BUCKET_BYTES


def test_dotted_columns(spark):
    frame = spark.createDataFrame([(1, "one two three", 5)], ["doc_id", "text", "a.b"])
    assert substring_dedup.remove_repeats(frame).collect() == frame.collect()
    assert quality.keep(frame).columns == frame.columns


def test_substring_dedup_odd(odd, nothing):
    found = sorted(((r["doc_id"], r["n_removed"]) for r in substring_dedup.digests(odd).collect()), key=str)
    assert found == sorted([(1, 0), (1, 0), (None, 0), (None, 0), (4, 0), (2, 14)], key=str)
    assert substring_dedup.digests(nothing).count() == 0 and substring_dedup.remove_repeats(nothing).columns == nothing.columns
    assert substring_dedup.remove_repeats(odd).columns == odd.columns and substring_dedup.paths(nothing).count() == 0


def plain_winnow(hashes, w):
    chosen = set()
    for s in range(max(1, len(hashes) - w + 1) if hashes else 0):
        part = hashes[s : s + w]
        least = min(part)
        chosen.add(max(s + k for k, h in enumerate(part) if h == least))
    return sorted(chosen)


@lru_cache(maxsize=None)
def plain_pairs(text, k, w):
    """(position, hash) pairs by the definition: every window of every sum of codes."""
    prime = winnowing.PRIME
    codes = [(xxhash.xxh64_intdigest(c, seed=42) & prime) % prime for c in text]
    powers = [pow(winnowing.BASE, k - 1 - j, prime) for j in range(k)]
    grams = [sum(c * p for c, p in zip(codes[i : i + k], powers, strict=True)) % prime for i in range(len(text) - k + 1)]
    if not grams and text:
        grams = [xxhash.xxh64_intdigest(text, seed=42) & prime]
    return [(i, grams[i]) for i in plain_winnow(grams, w)]


def plain_comparison(pairs_of, ordered, k, w):
    for n, (doc, text) in enumerate(ordered):
        text, after = text or "", ordered[(n + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, following = (pairs_of(t, k, w) for t in (text, edited, after))
        spell = lambda x: " ".join(f"{i}:{h:x}" for i, h in x)
        like = lambda x, y: (lambda p, q: len(p & q) / len(p | q) if p | q else 1.0)({h for _, h in x}, {h for _, h in y})
        yield doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), spell(own), spell(other), like(own, other), like(own, following)


FIELDS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@pytest.mark.parametrize(("k", "w"), [(winnowing.K, winnowing.WINDOW), (3, 4), (1, 1), (5, 7)])
def test_winnowing(docs, rows, k, w):
    short = docs.where("doc_id % 2 = 0 or n_chars < 900 or n_chars is null") if k == 5 else docs
    ids = {r["doc_id"] for r in short.select("doc_id").collect()}
    found = {tuple(r[c] for c in FIELDS) for r in winnowing.compare_with_edited(short, k, w).collect()}
    assert found == set(plain_comparison(plain_pairs, sorted((r[0], r[1]) for r in rows if r[0] in ids), k, w))


def test_winnowing_of_short_texts(spark):
    r = random.Random(5)
    rows = [(i, "".join(r.choice("ab é日\n") for _ in range(r.randint(0, 60)))) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for k, w in ((8, 16), (4, 4), (2, 3)):
        found = {tuple(r[c] for c in FIELDS) for r in winnowing.compare_with_edited(frame, k, w).collect()}
        assert found == set(plain_comparison(plain_pairs, rows, k, w))


def test_a_shared_passage_shares_a_hash_at_any_offset(spark):
    r = random.Random(6)
    passage = "".join(r.choice("日本語文字列検索一致") for _ in range(winnowing.K + winnowing.WINDOW - 1))
    rows = [(i, "".join(r.choice("甲乙丙丁") for _ in range(i)) + passage + "".join(r.choice("戊己庚") for _ in range(9))) for i in range(12)]
    found = winnowing.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hashes = [{p["h"] for p in row["fingerprint"]} for row in found]
    assert set.intersection(*hashes)


def test_long_texts_are_like_their_edited_texts(spark):
    """From 2 * (k + window - 1) characters on, the front that is kept holds a whole window."""
    least = 2 * (winnowing.K + winnowing.WINDOW - 1)
    r = random.Random(8)
    rows = [(i, "".join(chr(r.randint(97, 122)) for _ in range(least + i % 40))) for i in range(200)]
    assert winnowing.compare_with_edited(spark.createDataFrame(rows, "doc_id long, text string")).agg({"near_edited": "min"}).first()[0] > 0


def test_winnowing_odd(odd, nothing):
    assert winnowing.compare_with_edited(odd).count() == 6 and winnowing.compare_with_edited(nothing).count() == 0
    assert winnowing.compare_with_edited(odd.where("doc_id = 2")).first()["near_next"] == 1


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf).cache()
        assert after.columns == columns
        before_ids, ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in (docs, after)]
        assert ids <= before_ids
        seen[name] = len(before_ids), len(ids)
        if name == "simhash_near_dedup":
            want = plain_components({r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()})
            assert ids == {d for d, c in want.items() if d == c}
        if name == "substring_dedup":
            cut = plain_dedup([(r["doc_id"], r["text"]) for r in docs.collect()])
            for r in after.collect():
                w, gone = cut[r["doc_id"]]
                assert WORD.findall(r["text"]) == [x for x, g in zip(w, gone, strict=True) if not g] and r["n_chars"] == len(r["text"])
        docs = after
    assert seen["quality_rules"][1] < seen["quality_rules"][0]
    pieces = corpus_pipeline.run(spark, sf)
    assert set(pieces.columns) == {"doc_id", *packing.NAMES}
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}


def test_near_dedup_keeps_one_row_of_a_component(spark):
    one, two, three = ("".join(random.Random(seed).choices("abcdefgh ", k=400)) for seed in (1, 2, 3))
    rows = [(5, one), (5, one), (5, two), (3, two), (None, three), (None, three), (None, two), (9, three), (None, "alone here")]
    docs = spark.createDataFrame([(i, t, "Row", "x") for i, t in rows], "doc_id long, text string, Row string, `a.b` string").repartition(3)
    assert corpus_pipeline.near_dedup(spark, docs.where("doc_id = 3"), "").count() == 1
    left = corpus_pipeline.near_dedup(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(5, one), (3, two), (9, three), (None, "alone here")], key=str)


def test_pipeline_stages_stand_odd_tables(spark, odd, nothing):
    base = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "x " * 50, "en", "s", 100), (2, "", "de", None, 0)], nothing.schema)
    for table in (nothing, base):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
            docs.collect()
