"""Exact and near duplicates, fingerprints, against brute force."""

import hashlib
import random
from itertools import combinations

from pyspark.sql import functions as F

from attestor.llm import exact_dedup, fingerprints, near_dedup
from attestor.llm.minhash import parity_bitmap, shingle_sets


def test_exact_duplicates(odd, sample, empty):
    for docs in (odd, sample):
        rows = docs.collect()
        groups = {}
        for r in rows:
            groups.setdefault(r["text"] or "", []).append(r["doc_id"])
        want = []
        for r in rows:
            ids = groups[r["text"] or ""]
            keep = max((i for i in ids if i is not None), default=None)
            want.append((str(r["doc_id"]), str(keep), len(ids), r["doc_id"] == keep, hashlib.sha256((r["text"] or "").encode()).hexdigest()))
        got = exact_dedup.exact_duplicates(docs).collect()
        assert sorted((str(r["doc_id"]), str(r["keep_id"]), *r[2:]) for r in got) == sorted(want)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_index_takes_only_what_is_new(spark):
    make = lambda *rows: exact_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    index = exact_dedup.DigestIndex(spark, buckets=3)
    assert index.add(make((1, "a"), (2, "a"), (3, "b"))).count() == 2
    spark.sql(f"DROP TABLE {index.name}")  # as in a session with another catalog: the folder is all there is
    again = exact_dedup.DigestIndex(spark, index.path)
    assert again.buckets == 3 and [r["keep_id"] for r in again.add(make((9, "a"), (10, "c"))).collect()] == [10]
    assert sorted((r["keep_id"], r["group_size"]) for r in again.entries().collect()) == [(3, 1), (9, 3), (10, 1)]


def test_new_documents_are_held_against_an_older_index(spark):
    make = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark)
    exact_dedup.exact_duplicates(make((1, "a"), (50, "b")), index).count()
    got = exact_dedup.exact_duplicates(make((9, "a"), (10, "a"), (11, "b"), (12, "c")), exact_dedup.DigestIndex(spark, index.path)).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == [(9, 10, 3, False), (10, 10, 3, True), (11, 50, 2, False), (12, 12, 1, True)]


def test_known_digests_leave_by_a_sort_merge_anti_join(spark):
    index = exact_dedup.DigestIndex(spark)
    reduced = exact_dedup.digests(spark.range(5).selectExpr("id AS doc_id", "string(id) AS text"))
    plan = reduced.join(index.known().hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan


def test_hot_texts_go_by_broadcast(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(4000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(docs).collect()}
    assert len(got) == 4000 and got[1]["keep_id"] == 3998 and got[1]["group_size"] == sum(1 for i in range(4000) if i % 3) and got[3]["kept"]


def clashing(docs):
    """docs with further columns named as operators name theirs."""
    for name in ("mark", "sha", "gone", "own", "_digest", "_gone", "_mark_id", "_id", "digest", "keep_id", "Mark_", "hub", "cid"):
        docs = docs.withColumn(name, F.lit("mine"))
    return docs


def test_without_exact_duplicates(odd):
    odd = clashing(odd)
    rows = exact_dedup.without_exact_duplicates(odd).collect()
    assert all(r["sha"] == r["mark"] == r["_gone"] == r["digest"] == "mine" for r in rows)
    assert len(rows) == len({r["text"] or "" for r in odd.collect()}) and rows[0].asDict().keys() == odd.first().asDict().keys()


def shingles(text, words):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def brute(rows, words, percent=80):
    ids = [r[0] for r in rows if r[0] is not None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, words)) for i, t in rows if i is not None]
    for (a, s), (b, t) in combinations(sets, 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_copies(n, groups, seed):
    """Groups of near copies of one text, with so many edits that some pairs lie just over and some just under the limit."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((3, 12, 60, 150)))]
        for _ in range(n):
            words = list(base)
            for _ in range(rng.randrange(1 + len(base) // 8)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows) * 3 + g % 2, " ".join(words)))
    return rows


def test_near_duplicates_find_every_link(spark):
    rows = near_copies(30, 8, 5) + near_copies(3, 30, 6)[:0] + [(10_001, "alone in the world"), (10_002, None), (10_003, ""), (10_004, "one"), (10_005, "ONE")]
    for words in (2, 5):
        want = brute(rows, words)
        got = {r["doc_id"]: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words).collect()}
        assert {i: r["component_id"] for i, r in got.items()} == want
        assert all(got[i]["n_shingles"] == len(shingles(t, words)) and got[i]["kept"] == (want[i] == i) for i, t in rows)


def test_near_duplicates_odd_rows(odd, sample, empty):
    for docs in (odd, sample):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        got = near_dedup.near_duplicates(docs, 2).collect()
        want = brute(rows, 2)
        assert len(got) == len(rows) and all(r["component_id"] == want.get(r["doc_id"]) for r in got)
    assert near_dedup.near_duplicates(empty, 2).count() == 0


def test_one_doc_id_is_one_node_whatever_its_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(5, a), (7, a), (7, b), (9, b), (9, b), (11, c), (3, c), (12, "alone here"), (5, "alone there")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert len(got) == len(rows) and {(r["doc_id"], r["component_id"]) for r in got} == {(5, 5), (7, 5), (9, 5), (11, 3), (3, 3), (12, 12)}


def test_rows_without_an_id_stay_alone_beside_a_hot_group(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), *[(i, "a b c d e") for i in range(5, 40)]]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True)] * 2 + [(i, 5, i == 5) for i in range(5, 40)]


def test_groups_whose_hubs_link_nothing(spark):
    """Copies that all differ from the first ones by too much, in two clusters and a bridge between them."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(100)]
    rows = []

    def copy(fixed, n):
        words = list(base)
        for p in fixed:
            words[p] = f"f{p}"
        for _ in range(n):
            words[rng.randrange(100)] = f"x{rng.randrange(10**9)}"
        rows.append((len(rows), " ".join(words)))

    for _ in range(6):
        copy((), 7)
    for _ in range(40):
        copy(range(0, 27, 3), 2)
        copy(range(1, 28, 3), 2)
    copy(range(0, 12, 3), 0)
    want = brute(rows, 2)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and 1 < len(set(want.values())) < len(rows)


def test_without_near_duplicates(odd):
    odd = clashing(odd)
    rows = near_dedup.without_near_duplicates(odd).collect()
    assert all(r["_id"] == r["mark"] == r["gone"] == "mine" for r in rows)
    kept = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert sorted(kept) == [1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13]


def test_bitmaps_bound_the_difference():
    a, b = shingle_sets([" ".join(f"a{i}" for i in range(300)), " ".join(f"a{i}" for i in range(20, 340))], 1)
    unequal = sum(bin((int(x) ^ int(y)) & (2**64 - 1)).count("1") for x, y in zip(parity_bitmap(a), parity_bitmap(b), strict=True))
    assert unequal <= 60 == len(set(a.tolist()) ^ set(b.tolist()))


def check_fingerprints(docs, buckets):
    order = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (-(r["doc_id"] if r["doc_id"] is not None else -(2**63)), r["text"] or ""))
    want = []
    for k, r in enumerate(order):
        t, n = r["text"] or "", order[(k + 1) % len(order)]["text"] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        marks = [fingerprints.fingerprint(fingerprints.Prefixes(x)) for x in (t, edited, n)]
        want.append((str(r["doc_id"]), len(t), hashlib.sha256(edited.encode()).hexdigest(), marks[0], marks[1], fingerprints.likeness(marks[0], marks[1]), fingerprints.likeness(marks[0], marks[2])))
    got = fingerprints.compare_with_edited_and_next(docs, buckets).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)


def test_fingerprints(odd, sample, empty, spark):
    for buckets in (1, 3, 16):
        check_fingerprints(sample, buckets)
        check_fingerprints(odd, buckets)
    check_fingerprints(spark.createDataFrame([(1, "only one")], "doc_id long, text string"), 4)
    assert fingerprints.compare_with_edited_and_next(empty).count() == 0


def test_common_extension_and_spans():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(2))
        i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        x, y = fingerprints.Prefixes(a), fingerprints.Prefixes(b)
        k = 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        assert fingerprints.common_extension(x, i, y, j) == k
        assert fingerprints.span_hash(x, i, i + k) == fingerprints.span_hash(y, j, j + k)


def test_likeness_follows_the_share_that_stays():
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    mark = lambda t: fingerprints.fingerprint(fingerprints.Prefixes(t))
    assert abs(fingerprints.likeness(mark(text), mark(text[:1000] + "z" * 3000)) - 0.25) < 0.05
    assert fingerprints.likeness(mark(text), mark(text[:2000] + "!" + text[2001:])) > 0.9
    assert fingerprints.likeness(mark(text), mark("q" + text)) > 0.4
    assert fingerprints.likeness(mark(text), mark(text)) == 1.0 and fingerprints.likeness(mark(text), mark(text[::-1])) < 0.02
    assert fingerprints.likeness(mark(""), mark("")) == 1.0 and fingerprints.likeness(mark(""), mark("a")) == 0.0


def test_a_batch_that_comes_again_is_not_counted_again(spark):
    make = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, buckets=2)
    docs = make((1, "a"), (2, "a"), (3, "b"))
    shown = lambda *args: sorted(tuple(r)[:4] for r in exact_dedup.exact_duplicates(*args).collect())
    first = shown(docs, index, "monday")
    assert first == shown(docs, index, "monday") == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]
    assert shown(make((9, "a")), index, "tuesday") == [(9, 9, 3, True)]
    index.close()
    again = exact_dedup.DigestIndex(spark, index.path)
    assert again.has("monday/0") and not again.has("monday") and sorted(r["group_size"] for r in again.add(exact_dedup.digests(docs), "monday/0").collect()) <= [1, 2]
    assert sum(r["group_size"] for r in again.entries().collect()) == 4


def test_calls_leave_no_table_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    exact_dedup.exact_duplicates(spark.createDataFrame([(1, "a")], "doc_id long, text string")).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_sets_of_wanted_classes(spark):
    """Every wanted class comes with its whole set, whatever its id; others and rows without an id do not come."""
    ids = [*range(-40, 160), 2**62, -(2**62), 2**31, 1 << 26]
    texts = {i: " ".join(f"w{abs(i) % 89}x{k}y{i}" for k in range(3 + abs(i) % 20)) for i in ids}
    docs = spark.createDataFrame([*texts.items(), (None, "a row without an id has no class"), (500, None)], "doc_id long, text string")
    marks = near_dedup.signatures(docs, 5).where("digest is not null and doc_id is not null")
    wanted = marks.where("doc_id % 3 = 0 or abs(doc_id) > 1000").select(F.col("doc_id").alias("cid"), F.col("doc_id").alias("rep"), "digest")
    got = {r["cid"]: (r["n"], bytes(r["shingles"])) for r in near_dedup.sets_of(docs, wanted, 5).collect()}
    chosen = [i for i in ids if i % 3 == 0 or abs(i) > 1000]
    sets = dict(zip(chosen, shingle_sets([texts[i] for i in chosen], 5), strict=True))
    assert got == {i: (len(s), s.tobytes()) for i, s in sets.items()}
    assert near_dedup.sets_of(docs, wanted.limit(0), 5).count() == 0
