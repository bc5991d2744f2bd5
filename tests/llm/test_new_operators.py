"""Merkle manifest, spelling variants and b-bit MinHash against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import merkle, minhash, queries, spelling
from conftest import DATA
from .test_llm import WORD, corpus, docs, empty, lower, nulls  # noqa: F401  (fixtures)

# 11: Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars). Multiset of results by the rule."""
    trees = defaultdict(list)
    for r in rows:
        leaf = H(*map(enc, (r[0], r[3], r[2], r[4], r[1])))
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf, r))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    def path(tree, i):
        steps = []
        for nodes in tree[:-1]:
            at = i // 2 * 2
            steps.append((nodes[at] if i % 2 else "", nodes[i + 1] if i % 2 == 0 and i + 1 < len(nodes) else ""))
            i //= 2
        return steps

    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {k: levels([x[2] for x in sorted(trees[k], key=lambda x: x[:3])]) for k in langs}
    top = levels([built[k][-1][0] for k in langs])
    out = []
    for g, k in enumerate(langs):
        for i, (_, _, leaf, r) in enumerate(sorted(trees[k], key=lambda x: x[:3])):
            steps = path(built[k], i) + path(top, g)
            start = leaf
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                start = H(*map(enc, (r[0], r[3], r[2], r[4] + 1, r[1])))
            folded = start
            for a, z in steps:
                folded = H(a, folded, z)
            out.append((r[0], leaf, built[k][-1][0], top[-1][0], H("".join(a + z for a, z in steps)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def digests(df):
    return sorted((tuple(r) for r in merkle.document_digests(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("block", [4, 8192])
def test_manifest_equals_the_rule(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block)  # small blocks have several rounds
    r = random.Random(2)
    rows = [(r.choice([None, *range(60)]), r.choice([None, "", "a", "é😀", "x" * 5000]), r.choice([None, "", "en", "en", "en", "é", "z"]), r.choice([None, "s"]), r.choice([None, 0, 9, 2**63 - 1])) for _ in range(150)]
    rows += [(7, "same", "en", "s", 1)] * 5
    df = spark.createDataFrame([(*x, 1, 2, "k") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, tree int, place int, _kept string")
    got = digests(df.repartition(5))
    assert got == brute_manifest(rows) and not all(x[-1] for x in got)


def test_manifest_of_few_and_no_rows(spark, empty, nulls):  # noqa: F811
    assert digests(empty) == []
    assert digests(nulls) == brute_manifest([(None,) * 5] * 3)
    one = spark.createDataFrame([(3, "t", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert digests(one) == brute_manifest([(3, "t", "en", "s", 1)])


def test_manifest_of_wider_nodes_and_proofs(spark):
    rows = [(i, i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, g long")
    m = merkle.manifest(df, merkle.leaf(F.col("id")), F.col("g").cast("string"), F.col("id"), {"id": F.col("id")}, arity=3)
    got = m.withColumn("folded", merkle.fold(F.col("digest"), F.col("steps"))).collect()
    assert len(got) == 40 and all(r["folded"] == r["root"] for r in got) and {r["place"] for r in got if r["id"] % 3 == 0} == set(range(14))
    assert {len(r["steps"]) for r in got} == {4} and {r["digest"] for r in got} == {H(enc(i)) for i in range(40)}


def test_events_resolve_in_any_order_and_grouping():
    r = random.Random(4)
    for size, arity in itertools.product((1, 2, 3, 5, 16, 17, 41), (2, 3)):
        leaves = [((0, i), H(str(i))) for i in range(size)]
        whole, tops = merkle.climb(leaves, size, arity)
        assert tops == [(merkle.height(size, arity), 0)]
        events = leaves[:]
        while len(events) > 1 or events[0][0][0] < merkle.height(size, arity):
            r.shuffle(events)
            cut = r.randint(0, len(events))
            parts = [p for p in (events[:cut], events[cut:]) if p]
            events = [(n, known[n]) for known, ends in (merkle.climb(p, size, arity) for p in parts) for n in ends]
        assert events == [((merkle.height(size, arity), 0), whole[tops[0]])]


# 12: spelling variants


def brute_words(rows):
    found = Counter()
    for i, t in rows:
        for run, n in Counter(lower(x) for x in re.findall("[A-Za-zÀ-ÿ]+", t or "")).items():
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            found[run] += n
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(words):
    form, near = {}, {w: [v for v in words if distance_one(w, v)] for w in words}
    for w, vs in near.items():
        if vs:
            best = min(vs, key=lambda v: (-words[v], v))
            form[w] = best if words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        top = w
        while form.get(top):
            top = form[top]
        f = form.get(w)
        out.append((w, f, top, words[w], len(near[w]), words[f] if f else None))
    return sorted(out, key=repr)


def test_variants_equal_all_pairs(spark):
    r = random.Random(6)
    words = {}
    for base in ("abcdefg", "aaaaaaa", "éàüabcd", "zzzzzzz", "hellooo", "mississippi"):
        words[base] = r.choice([5, 40, 900, 9000])
        for _ in range(60):
            w = base
            for _ in range(r.randint(1, 3)):
                k, c = r.randrange(len(w) + 1), r.choice("abzéà")
                w = r.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]])
            words.setdefault(w, r.choice([1, 5, 8, 30, 200, 1000]))
    words["x" * 3000], words["x" * 2999 + "y"], words["x" * 3001] = 50, 5, 700
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = sorted((tuple(x) for x in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)
    assert got == brute_variants(words) and any(x[1] and x[2] != x[1] for x in got)


def test_document_variants(docs, empty, nulls, spark):  # noqa: F811
    rows = corpus() + [(900 + k, "Strasse strasse STRASSE Straße strassen, Élevée élevée " * 40) for k in range(3)]
    df = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in rows], "doc_id long, text string, n int, id int, key string")
    got = sorted((tuple(x) for x in spelling.document_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)
    assert got == brute_variants(brute_words(rows)) and len(got) > 50
    assert spelling.document_variants(empty).count() == 0 and spelling.document_variants(nulls).count() == 0


def test_keys_of_deletions():
    r = random.Random(8)
    for _ in range(300):
        w = "".join(r.choices("abé", k=r.randint(1, 9)))
        own, less = spelling.keys(w)
        assert [spelling.keys(w[:k] + w[k + 1 :])[0] for k in range(len(w))] == less and spelling.keys(w)[0] == own


# 13: b-bit MinHash


def shingles4(t):
    w = re.findall(WORD, lower(t or ""))
    return {tuple(w)} if 0 < len(w) < 4 else {tuple(w[i : i + 4]) for i in range(len(w) - 3)}


def brute_near(rows):
    sets, parent = [shingles4(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            parent[find(a)] = find(b)
    low = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)].append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        c = (min(low[find(k)]) if low[find(k)] else None) if sets[k] else i
        out.append((i, len(sets[k]), c, None if i is None or c is None else i == c))
    return sorted(out, key=repr)


def near_rows(df):
    return sorted((tuple(r) for r in minhash.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


@pytest.mark.parametrize("block", [3, 4096])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "FAMILY", block)
    r = random.Random(1)
    vocab = ["".join(r.choices("abcdefgh", k=5)) for _ in range(4000)]
    rows = corpus()
    for base in range(6):  # copies at and around the threshold, and of one template below it
        text = r.choices(vocab, k=150)
        for k in range(14):
            w = text[:]
            for _ in range(k // 2):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((1000 + base * 100 + k, " ".join(w)))
        rows += [(1000 + base * 100 + 50 + k, " ".join(text[:110] + r.choices(vocab, k=30))) for k in range(6)]
    df = spark.createDataFrame([(i, t, b"x", 1, 2, "z") for i, t in rows], "doc_id long, text string, class binary, id int, n int, family string")
    assert near_rows(df) == brute_near(rows)


def test_near_duplicates_of_nothing(empty, nulls):  # noqa: F811
    assert near_rows(empty) == [] and near_rows(nulls) == [(None, 0, None, None)] * 3


def test_estimates_are_corrected_for_collisions():
    g = np.random.default_rng(3)
    for similarity in (0.0, 0.3, 0.8, 1.0):
        found = []
        for _ in range(30):
            both, x, y = (g.integers(0, 2**63, int(n), dtype=np.uint64) for n in (1000 * similarity, 500 * (1 - similarity), 500 * (1 - similarity)))
            m = minhash.minima([np.concatenate([both, x]), np.concatenate([both, y])])
            found.append(float(minhash.estimates(*minhash.signatures(m))))
        assert abs(np.mean(found) - similarity) < 0.03 and minhash.signatures(m).shape == (2, 6)


@pytest.mark.parametrize("name", ["op11_merkle", "op12_spelling", "op13_minhash"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{DATA}/sf0.001/documents.parquet'")
    got = queries.QUERIES[name](spark, f"{DATA}/sf0.001")
    cols = sorted(got.columns)
    rel = c.sql(queries.ORACLE[name])
    at = [rel.columns.index(x) for x in cols]
    assert sorted(rel.columns) == cols
    assert sorted((tuple(r[x] for x in cols) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
