"""SimHash, substring dedup, decontamination and fingerprints against brute force, with nulls, empty and long texts, ties and empty tables."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from motifloom.llm import decontaminate, merkle, simhash, substrings
from motifloom.llm.common import connected_components, range_buckets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def edited(text, at):
    w = text.split(" ")
    w[at] = "changed"
    return " ".join(w)


@pytest.fixture
def corpus(prose):
    base = [prose(n) for n in (3, 40, 80, 200, 400)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(10 + i, t) for i, t in enumerate(base)] + [(20, edited(base[4], 7)), (21, edited(base[4], 300)), (22, edited(base[3], 9)), (23, base[2] + " " + base[1])]
    rows += [(30, None), (31, ""), (32, " \n\t "), (33, "one"), (34, prose(9000)), (35, base[1].upper()), (36, base[1].replace(" ", "\n"))]
    return rows


def brute_print(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("block", [simhash.BLOCK, 3])
def test_simhash(spark, docs, corpus, block):
    prints = {i: brute_print(t) for i, t in corpus}
    want = components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = simhash.near_duplicates(docs(corpus + [corpus[0]]), block=block).collect()
    assert len(got) == len(corpus) + 1
    for r in got:
        assert (r["fp"] % 2**64, r["component_id"]) == (prints[r["doc_id"]], want[r["doc_id"]])


def test_simhash_tiles():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    a[700:720] = a[:20] ^ np.uint64(0b1011)
    a = np.unique(a)
    home, others = a[::2].copy(), a[1::2].copy()
    u, v = simhash.linked(home, others, 4)
    own = {int(x) for x in home}
    near = {(int(a[i]), int(a[j])) for i, j in zip(*np.triu(np.bitwise_count(a[:, None] ^ a[None]) <= 4, 1).nonzero(), strict=True) if int(a[i]) in own or int(a[j]) in own}
    ids = [int(x) for x in a]
    want = components(sorted({x for p in near for x in p}), lambda x, y: (x, y) in near)
    assert len(near) >= 10 and components(sorted(set(want)), lambda x, y: (x, y) in {tuple(sorted(map(int, p))) for p in zip(u, v, strict=True)}) == want and set(want) <= set(ids)


@pytest.mark.parametrize("verified", [simhash.VERIFIED, 2])
def test_similar_documents(docs, corpus, verified):
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := WORD.findall((t or "").lower())) else set() for i, t in corpus}
    want = components(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = simhash.similar_documents(docs(corpus), block=max(2, verified), verified=verified).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    kept = simhash.drop_near_duplicates(docs(corpus + [(40, corpus[3][1]), (3, corpus[3][1]), (None, "x"), (None, "x")]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 1
    none = simhash.drop_near_duplicates(docs([(None, corpus[3][1]), (None, "A b"), (None, "a  b"), (7, corpus[3][1] + " more"), (None, None), (None, "")]).withColumn("component", F.lit(1)))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in none.collect()) == [(0, ""), (0, "A b"), (7, corpus[3][1] + " more")]


def test_similar_documents_in_blocks_of_groups(docs, prose, monkeypatch):
    """Groups that one task can't hold, one of which is a chain of pairs whose ends aren't similar."""
    monkeypatch.setattr(simhash, "HELD", 3000)
    start = prose(400).split()
    chain = [(i, " ".join(start[8 * i : 8 * i + 120])) for i in range(30)]
    near = prose(80)
    group = [(100 + i, edited(near, i)) for i in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs(chain + group), verified=4).collect()}
    assert got == {**{i: 0 for i, _ in chain}, **{i: 100 for i, _ in group}}


def test_similar_documents_of_every_size(docs, prose):
    """Pairs at exactly 0.8, of 4 m and 5 m shingles, for small and larger m."""
    rows = []
    for m in [m for m in range(1, 31) for _ in range(40)] + [100, 300]:
        words = prose(5 * m + 4).split()
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[m:] if len(rows) % 4 else words[:-m]))]
    rows.append((len(rows), " ".join(rows[0][1].split()[:7])))  # 3 of 4 or 5: below
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in rows if (w := t.split())}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    pairs = [i for i in range(0, len(rows) - 1, 2) if alike(sets[i], sets[i + 1])]
    assert len(pairs) > 1100
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs(rows)).collect()}
    assert [i for i in pairs if got[i] != got[i + 1]] == [] and got[len(rows) - 1] == len(rows) - 1


def test_near_duplicates_of_repeated_ids(docs, prose):
    a, b, c, d = (prose(60) for _ in range(4))
    rows = [(1, a), (5, a + " more"), (5, b), (6, b + " more"), (7, c), (7, d), (8, d + " more"), (7, d)]
    got = {(r["doc_id"], r["component_id"]) for r in simhash.similar_documents(docs(rows)).collect()}
    assert got == {(1, 1), (5, 1), (5, 5), (6, 5), (7, 7), (8, 7)}
    kept = sorted((r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(docs(rows)).collect())
    assert kept == sorted([(1, a), (5, b), (7, c), (7, d)])


def test_odd_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 300, 5000):
        h = np.unique(rng.integers(0, 1 << 63, n + n // 5, dtype=np.uint64))
        a, b = h[: len(h) - n // 5], h[n // 5 :]
        bits = simhash.width(n, 0.8)
        x, y = simhash.odd_sketch(a, bits), simhash.odd_sketch(b, bits)
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))
        assert (simhash.folded(x[None], len(x) // 2)[0] == simhash.odd_sketch(a, bits // 2)).all()


def test_similar_documents_of_nothing(docs):
    assert simhash.similar_documents(docs([])).count() == simhash.near_duplicates(docs([])).count() == 0
    assert simhash.drop_near_duplicates(docs([(1, None), (2, "")])).count() == 1


def brute_repeats(rows, k):
    first, order = {}, sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    key = lambda i: float("inf") if i is None else i
    for i, t in order:
        w = WORD.findall(t or "")
        for p in range(len(w) - k + 1):
            x = tuple(w[p : p + k])
            first[x] = min(first.get(x, float("inf")), key(i))
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < key(i):
                gone[p : p + k] = [True] * k
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [1, 3, 13])
def test_substrings(spark, docs, corpus, prose, k):
    shared = prose(20)
    rows = corpus + [(50 + i, f"{prose(5)}  {shared}\n{prose(i)} {shared}") for i in range(8)] + [(None, corpus[3][1]), (None, shared), (4, corpus[3][1])]
    found = substrings.remove_repeats(docs(rows), k=k, batch_bytes=2000)
    assert found.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in found.collect()), key=str)
    assert got == brute_repeats(rows, k)


@pytest.mark.parametrize("k,hash_bits", [(3, 8), (13, 6), (2, 3)])
def test_substrings_whose_hashes_collide(spark, docs, corpus, prose, k, hash_bits, monkeypatch):
    """With so few bits most windows are proposed for others; the second look must set all right, in several parts."""
    monkeypatch.setattr(substrings, "BROADCAST_ROWS", 20)
    shared = prose(30)
    rows = [r for r in corpus if r[0] != 34] + [(50 + i, f"{prose(5)}  {shared}\n{prose(i)} {shared}") for i in range(6)] + [(None, corpus[3][1]), (None, shared)]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(docs(rows), k=k, batch_bytes=2000, hash_bits=hash_bits).collect()), key=str)
    assert got == brute_repeats(rows, k)


def brute_paths(rows, k):
    """The lengths in edges of the maximal nonbranching paths of the graph of windows that two documents have."""
    seen = {}
    for i, t in rows:
        w = t.split()
        for p in range(len(w) - k + 1):
            seen.setdefault(tuple(w[p : p + k]), set()).add(i)
    edges = [e for e, ids in seen.items() if len(ids) > 1]
    into, out = {}, {}
    for e in edges:
        out.setdefault(e[:-1], []).append(e)
        into.setdefault(e[1:], []).append(e)
    through = lambda v: len(into.get(v, [])) == len(out.get(v, [])) == 1
    left, lengths = set(edges), []
    for e in [e for e in edges if not through(e[:-1])] + edges:  # cycles last
        n = 0
        while e in left:
            left.discard(e)
            n += 1
            if not through(e[1:]):
                break
            e = out[e[1:]][0]
        lengths += [n] * bool(n)
    return sorted(lengths)


def test_compacted_paths(spark, docs, prose, monkeypatch):
    monkeypatch.setattr(substrings, "ASKS", 2)
    a, b, c, d = (prose(n) for n in (60, 30, 25, 40))
    ring = "r1 r2 r3 r4 r5 r6 r7 r1 r2 r3"
    rows = [(1, f"{a} {b}"), (2, f"{c} {a}"), (3, f"{b} {c}"), (4, f"{d[:80]} {a} {d}"), (5, f"{prose(9)} {d}"), (6, ring), (7, f"{ring} r4 r5"), (8, "same " * 30), (9, "same " * 20), (10, f"x {a[20:200]}"), (11, f"{b} {prose(3)} {c}")]
    for k in (3, 5):
        batches = substrings._Batches(docs(rows), k, 300, 1 << 20, "doc_id", "text", 64)
        chains = substrings.written(batches.found(), "t").where("nodes is not null")
        paths = {}
        for r in substrings.compacted_paths(chains).collect():
            paths.setdefault(r["path"], []).append((r["at"], r["n"]))
        for parts in paths.values():
            at = 0
            for start, n in sorted(parts):
                assert start == at
                at += n
        assert sorted(sum(n for _, n in parts) for parts in paths.values()) == brute_paths(rows, k)
        words = {i: t.split() for i, t in rows}
        spans = substrings.repeated_spans(docs(rows), k=k, batch_bytes=300).collect()
        for r in spans:
            assert words[r["doc_id"]][r["word"] :][: r["n_words"]] == words[r["src_doc_id"]][r["src_word"] :][: r["n_words"]] and r["src_doc_id"] < r["doc_id"] and r["n_words"] >= k
        covered = {(r["doc_id"], r["word"] + j) for r in spans for j in range(r["n_words"])}
        assert len(covered) == sum(x[2] for x in brute_repeats(rows, k))


def test_pointers_along_rows_and_rings(spark):
    rows = [(i, i - 1, 2) for i in range(1, 40)] + [(100 + i, 100 + (i + 6) % 7, 1) for i in range(7)] + [(201, 200, 5)]
    links = spark.createDataFrame([(p, b, n) for p, b, n in rows], "piece long, before long, length int")
    got = {r["piece"]: (r["path"], r["at"]) for r in substrings.jumped(links).collect()}
    assert got == {**{i: (0, 2 * i) for i in range(1, 40)}, **{100 + i: (100, i) for i in range(1, 7)}, 201: (200, 5)}
    assert substrings.jumped(links.limit(0)).count() == 0


def test_substrings_without_ids(spark, docs, prose):
    """Rows without an id lie in many batches and aren't earlier for one another."""
    shared = prose(30)
    rows = [(None, f"{shared} {prose(4)}") for _ in range(60)] + [(1, f"{prose(3)} {shared[:90]}"), (2, prose(8))]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(docs(rows), k=5, batch_bytes=500).collect()), key=str)
    assert got == brute_repeats(rows, 5)


def test_substrings_of_nothing_and_clashing_names(spark, docs):
    assert substrings.remove_repeats(docs([])).count() == 0
    rows = docs([(1, "a b c"), (2, "a b c")]).withColumn("n_words", F.lit("x")).withColumn("mf_batch", F.lit("y"))
    got = substrings.remove_repeats(rows, k=3).select("doc_id", "n_words", "n_removed").collect()
    assert sorted(map(tuple, got)) == [(1, 3, 0), (2, 3, 3)]


def test_decontamination(spark, docs, prose):
    items = {i: prose(n) for i, n in enumerate((60, 30, 12, 5, 3, 1))}
    spoilt = edited(edited(items[0], 10), 50)
    rows = [(1, prose(50) + ". " + items[0].upper() + "! " + prose(70)), (2, spoilt), (3, " ".join(items[0].split()[:40])), (4, prose(3000) + " " + items[1] + " " + items[2]), (5, None), (6, ""), (7, items[3]), (8, f"--{items[4]}--"), (9, items[1]), (9, items[1]), (None, items[2])]
    table = spark.createDataFrame([*items.items(), (90, None), (91, " ! ")], "item_id long, text string")

    def shingles(text, k):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = {}
    for j, t in items.items():
        k = min(5, len(t.split()))
        own = shingles(t, k)
        for i, x in rows:
            part = len(own & shingles(x, k)) / len(own)
            if part >= 0.8:
                want[i, j] = part
    got = decontaminate.find_items(docs(rows), table).collect()
    assert {(r["doc_id"], r["item_id"]): r["containment"] for r in got} == pytest.approx(want) and len(got) == len(want)
    clean = decontaminate.drop_contaminated(docs(rows).withColumn("_th", F.lit(1)), table).drop("_th").collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in clean) == sorted((i, t or "") for i, t in rows if i in (3, 5, 6))
    assert decontaminate.find_items(docs([]), table).count() == decontaminate.find_items(docs(rows), table.limit(0)).count() == 0


def test_decontamination_of_shared_phrases_and_repeated_ids(spark, docs, prose):
    phrase = "which of the following is the best answer to the question"
    own = [prose(8) for _ in range(40)]
    items = [(i, f"{phrase} {t}") for i, t in enumerate(own)] + [(500, own[0] + " " + prose(6)), (500, own[1]), (None, own[2]), (None, own[3]), (501, phrase), (502, phrase.upper())]
    rows = [(i, f"{prose(20)} {phrase} {prose(20)}") for i in range(30)] + [(100 + i, f"{prose(9)} {phrase} {t} {prose(9)}") for i, t in enumerate(own[:5])] + [(None, f"{own[7]} {prose(4)}")] * 3 + [(None, own[2]), (None, "clean words " * 5000)]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("k", F.lit("clash")).withColumn("w", F.lit(0))
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontaminate.find_items(docs(rows).withColumn("th", F.lit("clash")), table).collect()}
    grams = lambda t, k=5: {tuple(w[i : i + k]) for w in [t.lower().split()] for i in range(len(w) - k + 1)}
    want = {}
    for j, t in items:
        for i, x in rows:
            part = len(grams(t) & grams(x)) / len(grams(t))
            if part >= 0.8 - 1e-9:
                want[i, j] = max(part, want.get((i, j), 0))
    assert got == pytest.approx(want) and (101, 500) in got and (None, None) in got and (0, 501) in got and (0, 502) in got and (0, 0) not in got


def test_merkle(spark, docs, corpus, prose, monkeypatch):
    rows = corpus + [(60, corpus[4][1] + "\n\n# h\n" + corpus[3][1]), (61, "é" * 10), (62, "a"), (62, "b")]
    monkeypatch.setattr(merkle, "BUCKET_BYTES", 1 << 16)
    nulls = docs([(None, prose(300)) for _ in range(400)] + [(5, "abc")])
    after = {r["text"]: r["next_text"] for r in merkle.with_next(nulls, ["text"]).collect()}
    start, seen = "abc", ["abc"]
    while (start := after[start]) != "abc":
        seen.append(start)
    assert len(seen) == len(after) == 401
    got = merkle.fingerprint_edits(docs(rows)).collect()
    hashes = {(r["doc_id"], r["text"] or ""): r["h"] for r in docs(rows).select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(rows, key=lambda r: (-r[0], hashes[r[0], r[1] or ""]))
    want = []
    for n, (i, t) in enumerate(order):
        t, nxt = t or "", order[(n + 1) % len(order)][1] or ""
        want.append((i, len(t), t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_text"]) for r in got) == sorted(want)
    texts = {i: t or "" for i, t in rows if i != 62}
    prints = {r["doc_id"]: r["fingerprint"] for r in got if r["doc_id"] != 62}
    for a in prints:
        for b in prints:
            assert (texts[a] == texts[b]) == (prints[a] == prints[b]) == (prints[a][:64] == prints[b][:64])
    long = {r["doc_id"]: r for r in got}[34]
    assert 0.6 < long["near_edited"] < 0.85 and long["near_next"] < 0.2
    assert merkle.fingerprint_edits(docs([])).count() == 0
    alone = merkle.fingerprint_edits(docs([(None, "abcdef")])).first()
    assert (alone["edited_text"], alone["n_chars"]) == ("abcdab", 6)


def test_merkle_locates_edits(spark):
    paragraphs = [f"paragraph {i} says {i * i} things about {i}" for i in range(40)]
    changed = [*paragraphs]
    changed[17] += " and more"
    df = spark.createDataFrame([("\n".join(paragraphs), "\n".join(changed))], "a string, b string")
    a, b = merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))
    row = df.select(a.alias("a"), b.alias("b")).select("a", "b", merkle.differing_sections(F.col("a"), F.col("b")).alias("d"), merkle.differing_sections(F.col("a"), F.col("a")).alias("n"), merkle.likeness(F.col("a"), F.col("b")).alias("near")).first()
    sections = row["a"].partition(":")[2].split("|")
    places = df.select(a.alias("a"), b.alias("b")).select(merkle.differing_paragraphs(F.col("a"), F.col("b"))).first()[0]
    assert places == [17]
    assert row["n"] == [] and 1 <= len(row["d"]) <= 2 and len(sections) > 3 and row["near"] > 0.9
    before = sum(s.count("-") for s in sections[: row["d"][0]])
    assert before <= 17 < before + sections[row["d"][0]].count("-")


def test_merkle_uses_whole_digests_and_cuts_by_content(spark, prose):
    words = prose(3000)
    rows = [("w4595637", "w7632605"), (words, "first " + words), ("same " * 3000, "other " + "same " * 3000), ("a b", "a  b"), ("a\nb", "a b"), ("", None)]
    df = spark.createDataFrame(rows, "a string, b string").select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    got = df.select("a", "b", merkle.likeness(F.col("a"), F.col("b")).alias("near")).collect()
    assert [r["a"][:64] == r["b"][:64] for r in got] == [False] * 5 + [True]
    assert got[0]["near"] == 0 and got[1]["near"] > 0.99 and got[5]["near"] == 1


def test_merkle_against_a_brute_tree(spark, prose):
    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    def tree(text):
        out = []
        for par in text.split("\n"):
            w, blocks = par.split(" "), []
            for i, x in enumerate(w):
                first = lambda v: ord(v[0]) if v else 0
                if not i or (5 * first(x) + 3 * len(x) + first(w[i - 1])) % 4 == 0:
                    blocks.append([])
                blocks[-1].append(x)
            leaves = [sha(" ".join(b[t : t + 64])) for b in blocks for t in range(0, len(b), 64)]
            out.append((sha("".join(leaves)), ",".join(x[:8] for x in leaves)))
        sections = [[]]
        for node, shown in out:
            sections[-1].append((node, shown))
            if node < "4":
                sections.append([])
        sections = [s for s in sections if s]
        mark = lambda node: "" if node < "4" else "."
        nodes = [sha("".join(n + mark(n) for n, _ in s)) for s in sections]
        return sha("".join(nodes)) + ":" + "|".join(n[:16] + "=" + "".join(f"{p[:16]}-{shown}{mark(p)}" for p, shown in s) for n, s in zip(nodes, sections, strict=True))

    texts = ["", " ", "\n", "one", "é  two\n\nthree \U0001f600 日本", "again " * 300, "\n".join(prose(30) for _ in range(40)), prose(5000)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", merkle.fingerprint(F.col("t")).alias("f")).collect()
    assert {r["i"]: r["f"] for r in got} == {i: tree(t) for i, t in enumerate(texts)}


def test_fingerprints_ignore_other_columns(docs):
    rows = docs([(1, "a b"), (1, "a b"), (2, None)]).withColumn("fingerprint", F.lit("x")).withColumn("next_text", F.lit("y"))
    assert sorted((r["doc_id"], r["n_chars"]) for r in merkle.fingerprint_edits(rows).collect()) == [(1, 3), (1, 3), (2, 0)]


def test_components(spark):
    path = [(i, i + 1) for i in range(60)]
    hub = [(100, i) for i in range(101, 160)]
    e = spark.createDataFrame([*path, *hub, (7, 7), (None, 3), (300, 200), (300, 200)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 300: 200, 200: 200}
    assert connected_components(e.limit(0)).count() == 0


@pytest.mark.parametrize("coarse,sampled", [(1 << 15, 4_000_000), (4, 4_000_000), (1 << 15, 50)])
def test_range_buckets(spark, monkeypatch, coarse, sampled):
    from motifloom.llm import common

    monkeypatch.setattr(common, "COARSE", coarse)
    monkeypatch.setattr(common, "SAMPLED", sampled)
    df = spark.createDataFrame([(i,) for i in [*range(100), 5, 5, None, None]], "k long")
    rows = range_buckets(df, "k", "b", 10).collect()
    by = {}
    for r in rows:
        by.setdefault(r["b"], set()).add(r["k"])
    spans = sorted((min(x), max(x)) for b, x in by.items() if None not in x)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False)) and {None} in by.values() and len(spans) >= 6


def test_kept_digest_is_of_the_text(spark, docs):
    got = substrings.remove_repeats(docs([(1, "a  b\tc")]), k=13).select(F.sha2("kept_text", 256).alias("s")).first()["s"]
    assert got == hashlib.sha256(b"a b c").hexdigest()
