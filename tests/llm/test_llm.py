"""The training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import bitfilter, bpe, components, jaccard, langid, lm, mincut, naming, ogg, packing, quality, queries, suffixes
from chronoweave.llm import words as W
from chronoweave.llm.scratch import Scratch
from conftest import DATA

SF = f"{DATA}/sf0.001"
#: Extra columns have the names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id long, name long, level int, kept string, _row long, _kept string, owner long, n long, score double, held_out string"
WORD = "[^\x20\x09-\x0d]+"


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def corpus():
    r = random.Random(7)
    vocab = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(3000)]
    say = lambda n: " ".join(r.choices(vocab, k=n))
    base, passage = say(90), say(60)
    texts = [say(r.randint(1, 160)) for _ in range(40)]
    texts += [base] * 5  # exact copies
    for k in range(12):  # near copies, more and more apart
        w = base.split()
        for _ in range(k):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts.append(" ".join(w))
    texts += [say(20) + " " + passage + "\n" + say(25) for _ in range(4)] + [passage, passage + " " + passage]
    texts += ["", None, " \n\t ", "one", "One two", "one TWO", "one two three four", "same " * 70, "same " * 71, " ", "É é́ ΣΣ", "a b c\x1cd", "<|endoftext|> x  <|endoftext|>", say(6000), "x" * 20000, "日本語のテキスト" * 30]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    rows = [(i, t) for i, t in zip(ids, texts)] + [(None, base), (None, None), (3, "a repeated id"), (ids[0], texts[0])]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    extra = ("en", "s", 1, 5, 6, 7, "k", 8, "x", 9, 10, 0.5, "h")
    return spark.createDataFrame([(i, t, *extra) for i, t in corpus()], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def nulls(spark):
    """A table with nothing but nulls."""
    return spark.createDataFrame([tuple([None] * 15)] * 3, SCHEMA)


# 9: exact dedup


def test_exact_duplicates(docs):
    got = naming.exact_duplicates(docs, block_bytes=16).collect()
    groups = defaultdict(list)
    for i, t in corpus():
        groups[t or ""].append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == len(corpus())
    for r in got:
        ids = by_sha[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids) and r["keep_id"] == (max(known) if known else None)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(by_sha.keys())


def test_block_size_does_not_matter(docs):
    ids = lambda b: sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in naming.exact_duplicates(docs, block_bytes=b).collect())
    assert ids(7) == ids(4096)


def test_keep_largest_keeps_columns(docs, empty, nulls):
    kept = naming.keep_largest(docs)
    assert kept.columns == docs.columns and kept.count() == len({t or "" for _, t in corpus()})
    assert naming.exact_duplicates(empty).count() == 0 and naming.keep_largest(empty).count() == 0
    assert [(r["keep_id"], r["group_size"]) for r in naming.exact_duplicates(nulls).collect()] == [(None, 3)] * 3


def test_naming_is_native(docs):
    plan = naming.exact_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 1: n-gram Jaccard


def shingles(t):
    w = re.findall(WORD, lower(t or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted((str(i), len(sets[k]), str(low.get(find(k)) if sets[k] else i)) for k, (i, _) in enumerate(rows))


def test_similar_groups(docs):
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.similar_groups(docs).collect())
    assert got == brute_components(corpus())


@pytest.mark.parametrize("seed", range(3))
def test_similar_groups_at_the_threshold(spark, seed):
    """Chains of small edits, so that many pairs lie just above and below the threshold and groups are not stars."""
    r = random.Random(seed)
    rows, w = [], [str(r.randrange(10**6)) for _ in range(60)]
    for i in range(150):
        if i % 30 == 0:
            w = [str(r.randrange(10**6)) for _ in range(r.randint(5, 60))]
        w = list(w)
        for _ in range(r.choice([0, 1, 1, 2])):
            w[r.randrange(len(w))] = str(r.randrange(10**6))
        if r.random() < 0.3:
            w.append(r.choice(w))
        rows.append((i, " ".join(w)))
    got = sorted((str(x["doc_id"]), x["n_shingles"], str(x["component_id"])) for x in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows)


def test_frequent_shingles_lose_nothing(spark):
    """A third of all rows are near copies of one text: their shingles are frequent in every batch."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(600):
        w = list(base) if i % 3 == 0 else [f"u{i}-{k}" for k in range(40)]
        if i % 3 == 0:
            for _ in range(r.randint(0, 3)):
                w[r.randrange(80)] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = sorted((str(x["doc_id"]), x["n_shingles"], str(x["component_id"])) for x in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == brute_components(rows)


def test_jaccard_edges(docs, empty, nulls):
    assert jaccard.similar_groups(empty).count() == 0
    assert [tuple(r) for r in jaccard.similar_groups(nulls).collect()] == [(None, 0, None)] * 3
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    gone = {i for i, _, c in brute_components(corpus()) if i != "None" and i != c}
    assert {str(r["doc_id"]) for r in kept.select("doc_id").collect()} == {str(i) for i, _ in corpus()} - gone


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 15, 16, 31, 64, 200, 1001])
def test_prefix_lengths(n):
    """Two sets with the least overlap that a link needs must meet among the rare prefix shingles."""
    r = random.Random(n)
    for _ in range(60):
        m = r.randint(jaccard.needed(n), max(jaccard.needed(n), 4 * n // 3))
        common = next(c for c in range(n + m) if 4 * c >= 3 * (n + m - c))
        if common > min(n, m):
            continue
        pool = r.sample(range(10**6), n + m - common)
        a, b = pool[:n], pool[:common] + pool[n:]
        pa, pb = sorted(a)[: jaccard.prefix_length(n)], sorted(b)[: jaccard.prefix_length(m)]
        order = {x: r.random() for x in pool}  # any order both agree on
        rare = lambda p, k: set(sorted(p, key=order.get)[: jaccard.rare_length(k)])
        assert rare(pa, n) & rare(pb, m)


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randrange(30), 100 + r.randrange(30)) for _ in range(40)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()))
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_bit_filter(spark):
    values = [0, 1, 2**62, 2**63 - 1, 12345678901234567]
    bits = bitfilter.build(spark.createDataFrame([(v,) for v in values], "v long"), "v", 3)
    assert bitfilter.passes(bits, np.array(values)).all() and len(bits) == 1 << (bitfilter.bits_for(5) - 3)
    assert not bitfilter.passes(bits, np.array([2**61])).any()
    assert [bitfilter.bits_for(n) for n in (0, 1 << 16, 1 << 20, 1 << 40)] == [20, 20, 24, 30]
    many = np.random.default_rng(0).integers(0, 2**63 - 1, 100_000)
    bits = bitfilter.build(spark.createDataFrame([(int(v),) for v in many], "v long"), "v", 3)
    assert bitfilter.passes(bits, many).all() and bitfilter.passes(bits, many ^ 0x5A5A5A5A5A5A5A5A >> 1).mean() < 0.1


def test_very_long_texts_link(spark):
    r = random.Random(8)
    w = [f"w{r.randrange(10**6)}" for _ in range(120_000)]
    near, far = list(w), list(w)
    for i in range(0, 120_000, 50):
        near[i] = "changed"
    for i in range(0, 120_000, 20):
        far[i] = "changed"
    rows = [(1, " ".join(w)), (2, " ".join(near)), (3, " ".join(far)), (4, " " * 2_000_000), (5, "a " * 600_000), (6, "z" * 2_000_000)]
    got = sorted((str(x["doc_id"]), x["n_shingles"], str(x["component_id"])) for x in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows) and got[1][2] == "1"


def test_sizes_of_linked_sets_meet_at_a_pivot(spark):
    """Sets of 3/4 the size and just above and below a border of size classes."""
    r = random.Random(9)
    rows, k = [], 0
    for size in (24, 31, 32, 42, 43, 56, 57, 100):
        w = [f"x{size}-{i}" for i in range(size + 4)]
        for part in (1.0, 0.9, 0.8, 0.76, 0.75, 0.74):
            rows.append((k, " ".join(w[: round(size * part) + 4])))
            k += 1
    r.shuffle(rows)
    got = sorted((str(x["doc_id"]), x["n_shingles"], str(x["component_id"])) for x in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows)


# 3: suffix array


def brute_passages(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    ws = [re.findall(WORD, t or "") for _, t in rows]
    count = Counter(tuple(w[s : s + 50]) for w in ws for s in range(len(w) - 49))
    seen, out = set(), Counter()
    for k in order:
        w = ws[k]
        cover, later = np.zeros(len(w) + 1, bool), np.zeros(len(w) + 1, bool)
        for s in range(len(w) - 49):
            g = tuple(w[s : s + 50])
            if count[g] > 1:
                cover[s : s + 50] = True
                if g in seen:
                    later[s : s + 50] = True
                seen.add(g)
        e = np.flatnonzero(np.diff(np.concatenate([[False], cover]).astype(int)))
        out.update((rows[k][0], int(a), int(z - a), int(later[a:z].sum())) for a, z in zip(e[::2], e[1::2]))
    return out


def test_repeated_passages(spark, docs):
    # Rows that repeat an id count in either order, so they stay out of the exact comparison.
    rows = [x for x in corpus() if x[0] is not None][:-2]
    got = Counter(tuple(r) for r in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == brute_passages(rows) and got
    assert {r["doc_id"] for r in suffixes.repeated_passages(docs).collect()} >= {i for i, *_ in got}


@pytest.mark.parametrize("seed", range(2))
def test_repeated_passages_of_random_texts(spark, seed):
    r = random.Random(seed)
    pool = [[f"{k}-{i}" for i in range(r.randint(45, 130))] for k in range(5)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(r.randint(1, 4)):
            p = r.choice(pool)
            a = r.randrange(len(p))
            w += p[a : a + r.randint(10, 120)] + [f"x{i}-{r.randrange(10**6)}" for _ in range(r.randint(0, 8))]
        rows.append((i, " ".join(w)))
    got = Counter(tuple(x) for x in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_passages(rows)


def test_remove_repeats(spark, docs, empty, nulls):
    rows = [x for x in corpus() if x[0] is not None][:-2]
    left = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert not any(n for *_, n in brute_passages(list(texts.items())))
    untouched = {i for i, _ in rows} - {i for i, *_, n in brute_passages(rows) if n}
    assert all(texts[i] == t for i, t in rows if i in untouched)
    assert suffixes.remove_repeats(docs).columns == docs.columns
    for df in (empty, nulls):
        assert suffixes.repeated_passages(df).count() == 0 and suffixes.remove_repeats(df).count() == df.count()


def test_rows_that_lose_all_words_go(spark):
    say = " ".join(f"w{i}" for i in range(60))
    rows = [(1, say), (2, "\n" + say + " \t\r\n"), (3, "\n"), (4, "\n" + say + " more")]
    left = {r["doc_id"]: r["text"] for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {1: say, 3: "\n", 4: "\nmore"}


@pytest.mark.parametrize("seed", range(4))
def test_repeated_runs_against_brute_force(seed):
    """Suffixes that agree far to one side with one neighbour and to the other side with another."""
    r = np.random.default_rng(seed)
    n, width = 40, suffixes.BEFORE + suffixes.PASSAGE
    base = r.integers(1, 3, size=(4, width)).astype(np.uint64)
    around = base[r.integers(0, 4, n)]
    around[:, suffixes.BEFORE : suffixes.BEFORE + suffixes.LEAD] = 7
    for i in range(n):
        around[i, : r.integers(0, suffixes.BEFORE)] = r.integers(3, 5)
        around[i, width - r.integers(0, 25) :] = r.integers(3, 5)
    least = r.integers(0, 10, n).astype(np.uint8)
    most = (least + r.integers(0, 16, n)).astype(np.uint8)
    found, later = suffixes.repeated_runs(around, least, most)
    for a in range(suffixes.BEFORE + 1):
        runs = [tuple(w[suffixes.BEFORE - a : suffixes.BEFORE - a + 50]) if lo <= a <= hi else None for w, lo, hi in zip(around.tolist(), least, most)]
        for i, x in enumerate(runs):
            assert bool(found[i] >> a & 1) == (x is not None and runs.count(x) > 1)
            assert bool(later[i] >> a & 1) == (x is not None and x in runs[:i])


def test_a_passage_in_many_rows(spark):
    """Beyond two in a task the later ones are known at once, in whatever order ids come."""
    passage = " ".join(f"p{i}" for i in range(120))
    rows = [(1000 - i * 7 % 997, f"a{i} b{i} {passage} c{i}") for i in range(300)]
    got = Counter(tuple(x) for x in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).collect())
    assert got == brute_passages(rows) and sum(1 for *_, later in got if not later) == 1


def test_very_long_texts_repeat(spark):
    long = " ".join(f"w{i * i % 99991}x{i}" for i in range(120_000))
    rows = [(1, long), (2, "start " + long[len(long) // 2 :]), (3, "same " * 100_000), (4, " " * 2_000_000), (5, "y" * 2_000_000)]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    half = len(long[len(long) // 2 :].split()) - 1  # its first word is cut
    assert set(got) == {1, 2, 3} and got[3] == (0, 100_000, 99_999)
    assert got[1] == (120_000 - half, half, 0) and got[2][1:] == (half, half)


def test_cut_words():
    assert suffixes.cut_words("a  b\nc d", [(1, 2)]) == "a  d" and suffixes.cut_words("a b", [(0, 2)]) == "" and suffixes.cut_words(" a b c", [(0, 1), (2, 1)]) == " b "


# 8 and 6: encoding and packing


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary(name))


def test_encode_decode(docs, empty, nulls):
    path, tok = queries.vocabulary("word_bpe_49k.json"), library("word_bpe_49k.json")
    want = Counter()
    for i, t in corpus():
        e = tok.encode(t or "", add_special_tokens=False).ids
        want[i, len(e), hashlib.sha256(struct.pack(f"<{len(e)}I", *e)).hexdigest(), hashlib.sha256(tok.decode(e, skip_special_tokens=False).encode()).hexdigest()] += 1
    for parts in (1, 5):
        assert Counter(map(tuple, bpe.encode_decode(docs.repartition(parts), path).collect())) == want
    assert bpe.encode_decode(empty, path).count() == 0
    assert {r["n_tokens"] for r in bpe.encode_decode(nulls, path).collect()} == {0}


def test_encode_then_decode_columns(spark):
    path = queries.vocabulary("word_bpe_49k.json")
    df = bpe.decode(bpe.encode(spark.createDataFrame([(1, "Hello, World"), (2, None)], "doc_id long, text string"), path), path)
    tok = library("word_bpe_49k.json")
    ids = tok.encode("Hello, World", add_special_tokens=False).ids
    assert sorted(map(tuple, df.collect())) == [(1, ids, tok.decode(ids)), (2, [], "")]
    assert [r["decoded"] for r in bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), path).collect()] == [""]


def test_each_distinct_word_is_encoded_once(spark):
    """In one part of all, however many batches hold it."""
    path = queries.vocabulary("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, f"the same words and word{i % 50} again") for i in range(400)], "doc_id long, text string").repartition(7)
    split = bpe.split_texts(docs, 5, False).cache()
    import zstandard

    where = defaultdict(set)
    for r in split.collect():
        for w in zstandard.decompress(r["words"]).decode().split(" "):
            where[w].add(r["part"])
    assert len(where) == 55 and all(len(p) == 1 for p in where.values())
    assert bpe.encode_parts(split, path).count() == split.count()
    split.unpersist()


def test_very_long_texts_of_words(spark):
    path, tok = queries.vocabulary("word_bpe_49k.json"), library("word_bpe_49k.json")
    texts = ["a " * 700_000, " " * 2_000_000, "z" * 200_000, " ".join(f"w{i}" for i in range(150_000))]
    got = {r["doc_id"]: r for r in bpe.encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    for i, t in enumerate(texts):
        e = tok.encode(t, add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(tok.decode(e, skip_special_tokens=False).encode()).hexdigest()


AWKWARD = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "a", "B", "'s", "'LL", "É", "é", "İ", "ß", "1", "²", "!", "...", "<|endoftext|>", "<|startoftext|>", "日本", "😀", "‍", "don't", "ﬁ", "가"]


def test_awkward_texts_encode_as_the_library_does():
    r = random.Random(5)
    texts = ["".join(r.choices(AWKWARD, k=r.randint(0, 12))) for _ in range(4000)]
    word, byte = library("word_bpe_49k.json"), library("byte_bpe_50k.json")
    lists = [W.words(t) for t in texts]
    flat, n = bpe.encode_words(queries.vocabulary("word_bpe_49k.json"), [w for ws in lists for w in ws])
    of = np.split(flat, np.cumsum(n))
    own = packing.ByteEncoder(queries.vocabulary("byte_bpe_50k.json"))
    at = 0
    for t, ws in zip(texts, lists):
        ids = word.encode(t, add_special_tokens=False).ids
        assert [i for x in of[at : at + len(ws)] for i in x.tolist()] == ids
        at += len(ws)
        assert own.encode(t).tolist() == byte.encode(t, add_special_tokens=False).ids


def test_packing(docs, empty, nulls):
    path, tok = queries.vocabulary("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    got = packing.pack(docs, path).collect()
    pieces = defaultdict(list)
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"] and 0 < r["length"] <= 1024
        pieces[r["sequence_id"]].append(r)
    assert sorted(pieces) == list(range(len(pieces)))
    stream = []
    for s in sorted(pieces):
        at = 0
        for r in sorted(pieces[s], key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
            stream.append(r)
        assert at == 1024 or s == len(pieces) - 1
        n = 1024 if at & (at - 1) else at
        assert all(r["padded_length"] == n for r in pieces[s])
    ids = lambda t: tuple(tok.encode(t or "", add_special_tokens=False).ids + [0])
    found, now = Counter(), []
    for r in stream:
        assert r["start"] == len(now)
        now += np.frombuffer(r["ids"], "<u4").tolist()
        if len(now) == r["doc_tokens"]:
            found[r["doc_id"], tuple(now)] += 1
            now = []
    assert found == Counter((i, ids(t)) for i, t in corpus())
    assert packing.pack(empty, path).count() == 0 and packing.pack(nulls, path).count() == 3


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 1_000_000 + "x", "\n" * 2_000_000, "a" * 300_000, "word " * 400_000, "x" + " " * 1_200_000 + "<|endoftext|>y"], ids=["spaces", "breaks-x", "breaks", "letters", "words", "special"])
def test_very_long_texts_encode_as_the_library_does(text):
    own = packing.ByteEncoder(queries.vocabulary("byte_bpe_50k.json"))
    assert own.encode(text).tolist() == library("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids


def test_other_files_are_left_to_the_library(tmp_path):
    import json

    with open(queries.vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        file = json.load(f)
    file["pre_tokenizer"]["add_prefix_space"] = True
    path = str(tmp_path / "spaced.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(file, f)
    from tokenizers import Tokenizer

    own = packing.ByteEncoder(path)
    assert own.encoding is None and own.encode("hello there").tolist() == Tokenizer.from_file(path).encode("hello there", add_special_tokens=False).ids


# 5: Ogg


def bitwise_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_page_checksum():
    for n in (0, 1, 27, 300):
        data = bytes(random.Random(n).randrange(256) for _ in range(n))
        assert ogg.page_checksum(data) == bitwise_crc(data)


def test_media(docs, empty, nulls):
    got = Counter(map(tuple, ogg.media_digests(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect()))
    want = Counter()
    for i, t in corpus():
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        want[i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])] += 1
    assert got == want and ogg.media_digests(empty).count() == 0 and ogg.media_digests(nulls).count() == 3
    same = ogg.media_digests(docs).groupBy("payload_sha256", "n_bytes").agg(F.countDistinct("media_sha256", "feature").alias("n")).filter("n > 1")
    assert same.count() == 0


def test_ogg_reader_sees_damage():
    media = ogg.write_ogg(bytes(range(256)) * 450, 100)
    streams = ogg.read_ogg(media)
    assert len(streams) == 2 and b"".join(next(s for s in streams.values() if len(s.packets) > 2).packets[1:]) == bytes(range(256)) * 450
    for at in (40, len(media) // 2, len(media) - 1):
        with pytest.raises(ogg.OggError):
            ogg.read_ogg(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
    with pytest.raises(ogg.OggError):
        ogg.read_ogg(media[:-5])


def test_packets_over_page_borders():
    packets = [(b"a" * 70000, 1), (b"", 2), (b"b" * 255, 3), (b"c" * 65025, 4), (b"d", 5)]
    pages = list(ogg.stream_pages(9, packets))
    s = ogg.read_ogg(b"".join(pages))[9]
    assert s.packets == [p for p, _ in packets] and len(pages) > 2 and s.granules[-1] == 5


def test_times():
    s = ogg.LogicalStream(packets=[b""] * 4, granules=[0, -1, -1, 3 * 576])
    assert ogg.packet_times(s).tolist() == [0, 72, 144]


# 2: quality


def brute_marginals(model, f, n):
    e = model.potentials(f, np.array([n]))
    good, bad = model.stay
    z, p = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        s = np.exp(sum(e[t] * y[t] for t in range(n)) + sum(good if a and b else bad if not a and not b else 0 for a, b in zip(y, y[1:])))
        z += s
        p += s * np.array(y)
    return p / z


def test_forward_backward():
    r = np.random.default_rng(1)
    model = quality.LineField(r.normal(size=3 * quality.FEATURES), np.array([0.7, -0.4]), np.array([1.0, 0.0]))
    f = r.normal(size=(12, quality.FEATURES))
    got = model.marginals(f, np.array([5, 1, 6]))
    assert got == pytest.approx(np.concatenate([brute_marginals(model, f[:5], 5), brute_marginals(model, f[5:6], 1), brute_marginals(model, f[6:], 6)]), abs=1e-9)


def test_line_features_do_not_depend_on_the_batch():
    texts = ["a b\n\nC! c", "", "tail\n", "x" * 50, "é 1 2 3\nsame\nsame"]
    whole = quality.line_features(texts)
    alone = [quality.line_features([t]) for t in texts]
    assert np.allclose(whole[0], np.concatenate([a[0] for a in alone])) and whole[2].tolist() == [3, 1, 2, 1, 3]


def test_quality_held_out(spark):
    d = f"{DATA}/sf0.01"
    got = queries.op2_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert (good.predicted == 1).mean() > 0.97 and (bad.predicted == 0).mean() > 0.85


def test_quality_edges(spark, docs, empty, nulls):
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(docs, model).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0 and quality.score(nulls, model).count() == 3
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, None), (0, 1)], "doc_id long, quality int")
    some = quality.train(docs, labels)
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs, some).collect())
    assert quality.keep_good(docs, some).columns == docs.columns
    assert quality.label_lines(docs, some).count() == sum((t or "").count("\n") + 1 for _, t in corpus())


def test_quality_ids_of_any_type_and_names_with_dots(spark):
    """Training meets ids as text, so an int column does as well as a long one."""
    rows = [(i, "Good words in a line.\nAnd more of them." if i % 2 else "!!! $$$ ###\n###") for i in range(40)]
    labels = [(i, i % 2) for i in range(40)]
    a = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    b = quality.train(spark.createDataFrame(rows, "`d.id` int, `the.text` string"), spark.createDataFrame(labels, "`d.id` int, `q.x` int"), "d.id", "the.text", "q.x")
    assert np.allclose(a.weights, b.weights) if hasattr(a, "weights") else True
    short = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), lines=1)
    assert short.score(["Good words in a line."])[0] == 0.5


# 10: language


def test_language_held_out(spark):
    d = f"{DATA}/sf0.01"
    got = queries.op10_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98


def test_filters_hold_their_grams():
    r = np.random.default_rng(2)
    langs = [f"l{i}" for i in range(70)]  # more than one plane
    grams = {k: r.integers(0, 2**32, 500, dtype=np.uint32) for k in langs}
    f = langid.Filters.build(langs, grams, 1 << 19)
    for k in ("l0", "l63", "l64", "l69"):
        hits = f.hits(grams[k])
        assert hits[langs.index(k)] == 500 and np.delete(hits, langs.index(k)).max() < 50


def test_language_against_sets(spark):
    """Filters and popcounts against sets of n-grams: counts, telling n-grams, hits and decision recounted plainly."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    learn = docs.filter((queries.fold(4) != 2) & F.col("lang").isNotNull())
    f = langid.train(learn)
    counts = defaultdict(Counter)
    for i, t, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            data = re.sub(rb"[^a-zA-Z\x80-\xff]", b" ", (" " + (t or "").lower() + " ").encode())
            counts[lang].update(data[k : k + 4] for k in range(len(data) - 3))
    total = {k: sum(c.values()) for k, c in counts.items()}
    assert f.langs == sorted(total, key=lambda k: (-total[k], k))
    rate = lambda k, g: counts[k][g] / total[k]
    telling = {k: {g for g in c if rate(k, g) >= langid.SHARE * max(rate(j, g) for j in counts)} for k, c in counts.items()}
    agree, every = 0, set()
    for i, t, _ in rows:
        data = re.sub(rb"[^a-zA-Z\x80-\xff]", b" ", (" " + (t or "").lower() + " ").encode())
        grams = [data[k : k + 4] for k in range(len(data) - 3)]
        want = {k: sum(g in telling[k] for g in grams) for k in f.langs}
        lang, score = f.predict(t)
        if lang == "und":
            assert not any(map(str.isalpha, t or ""))
            continue
        every.update(grams)
        hits, n = f.hits(langid.gram_codes(t)), len(grams)
        assert all(hits[j] >= want[k] for j, k in enumerate(f.langs))  # a filter never loses an n-gram
        agree += lang == max(f.langs, key=lambda k: want[k])
        true = [max(0.0, (h - n * r) / (1 - r)) for h, r in zip(hits, f.false_rate)]
        assert lang == f.langs[true.index(max(true))] and score == pytest.approx(max(true) / sum(true) if sum(true) else 0)
    assert agree >= 0.99 * sum(any(map(str.isalpha, t or "")) for _, t, _ in rows)
    codes = np.array([int.from_bytes(g, "big") for g in every], np.uint32)
    for j, (k, h) in enumerate(zip(f.langs, f.hits(codes))):
        other = len(every - telling[k])
        assert h - len(every & telling[k]) <= 20 + 3 * other * f.false_rate[j]


def test_no_ngram_is_left_out(spark):
    """Filters grow with the n-grams, and all of a language's are in."""
    r = random.Random(4)
    text = " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(40_000))
    f = langid.train(spark.createDataFrame([(text, "a"), ("zz zz", "b")], "text string, lang string"))
    codes = np.unique(langid.gram_codes(text))
    assert len(codes) > 150_000 and len(f.planes[0]) >= 8 * len(codes) and f.hits(codes)[f.langs.index("a")] > 0.999 * len(codes)


def test_very_long_and_very_short_texts_have_a_language(spark):
    f = langid.train(spark.createDataFrame([("the house of the river " * 50, "en"), ("das haus an dem fluss " * 40, "de")], "text string, lang string"))
    assert f.predict("das haus " * 300_000)[0] == "de" and f.predict(" " * 2_000_000) == ("und", 0.0)
    assert f.predict("a") == ("en", 0.0)


def test_language_edges(spark, docs, empty, nulls):
    f = langid.train(docs.filter("lang is not null"))
    got = {r["doc_id"]: r for r in langid.identify(docs, f).filter("doc_id is not null").collect()}
    for i, t in corpus():
        if i is not None and i != 3:
            assert got[i]["lang_pred"] == ("en" if t and any(map(str.isalpha, t)) else "und") and 0 <= got[i]["score"] <= 1
    nothing = langid.train(empty)
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(empty, f).count() == 0 and langid.identify(nulls, f).count() == 3


# 4: language model


def test_scores_against_counts(docs):
    got = lm.score(docs, F.col("doc_id") % 7 != 2).collect()
    words = lambda t: re.findall(WORD, lower(t or ""))
    c = Counter()
    for i, t in corpus():
        if i is not None and i % 7 != 2:
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(w := [*words(t), None]), sum(c[x] > 0 for x in w), n, round(sum(log10((c[x] + 1) / (n + v + 1)) for x in w), 5)) for i, t in corpus())
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def small_model(seed=0):
    """A vocabulary with words that are classes, words with entries of their own, other known words and a tail."""
    head = [(f"w{i}", 4000 - i) for i in range(3000)]
    tail = {"rare": 1, "odd": 2}
    sums = defaultdict(int)
    for w, k in [*head[lm.SINGLES :], *tail.items()]:
        sums[lm._shape(w)] += k + 1
    v = lm.Vocabulary.build(head, sums, 5, 1000, 3003)
    weights = np.random.default_rng(seed).normal(size=(v.buckets, lm.CLASSES)).astype(np.float32)
    return v, weights, dict(head) | tail


def model_logs(v, weights, texts):
    return lm.log_probabilities(v, weights, v.stream(texts))


def test_probabilities_sum_to_one():
    """Over all known words, an unknown word of each shape and the end, after any history."""
    v, weights, counts = small_model()
    unknown = {}
    for i in itertools.count():
        unknown.setdefault(lm._shape(f"?{i}"), f"?{i}")
        if len(unknown) == lm.SHAPES:
            break
    for history in ([], ["w3"], ["w2999", "rare", "w70", "zzz"]):
        total = 0.0
        for w in [*counts, *unknown.values(), None]:
            text = [*history, w] if w else history
            p = model_logs(v, weights, [text])[len(history)]
            total += 10**p * (counts[w] + 1 if w in counts and w not in v.index else 1)
        assert total == pytest.approx(1, abs=1e-3)


def test_softmax_against_brute_force():
    """Both factors of every token from the weights, one outcome at a time."""
    v, weights, counts = small_model(1)
    texts = [["w3", "rare", "w70", "zzz", "w2999", "w1"], [], ["odd"]]
    want = []
    for t in texts:
        kinds = [int(v.kind[v.index[w]]) for w in t] + [lm.SINGLES]
        seen = [zlib.crc32(w.encode()) for w in t]
        for i, w in enumerate([*t, None]):
            back = lambda k, what, none: what[i - k] if i >= k else none  # noqa: B023, E731
            c, ctx = [back(k, kinds, lm.CLASSES) for k in (1, 2, 3)], [back(k, seen, 2) for k in (1, 2)]
            own = kinds[i] << 40
            keys = [ctx[0], ctx[1], c[0] * 128 + c[1], c[2], ctx[0] + own, ctx[1] + own]
            rows = [int(W.mix(np.array([k * 8 + j + 0x2545F490], np.uint64))[0]) % v.buckets for j, k in enumerate(keys)]

            def log_p(rows, base, y):
                z = [sum(float(weights[r, o]) for r in rows) + float(base[o]) for o in range(lm.CLASSES)]
                return z[y] - max(z) - np.log(sum(np.exp(x - max(z)) for x in z))

            p = log_p(rows[:4], v.class_base, kinds[i])
            if kinds[i] > lm.SINGLES:
                entry = int(v.entry[v.index[w]])
                p += log_p(rows[4:], v.word_base[kinds[i]], entry)
                if entry == lm.OWN:
                    p += np.log((counts[w] + 1 if w in v.index else 1) / 10 ** v.log_share[kinds[i]])
            want.append(p / np.log(10))
    assert model_logs(v, weights, texts) == pytest.approx(want, abs=1e-4)


def test_expected_counts_against_brute_force():
    v, weights, _ = small_model(2)
    texts = [["w3", "w3", "w70", "w3", "w3"] * 30, ["rare", "w5"]]
    got, want = np.zeros((v.buckets, lm.CLASSES)), np.zeros((v.buckets, lm.CLASSES))
    lm.expected(v, weights, got, texts)
    s = v.stream(texts)
    for window in s.windows():
        for _, buckets, _, z in lm.factors(v, weights, s, window):
            for row, e in zip(buckets, np.exp(z.astype(float))):
                for b in row:
                    want[b] += e / e.sum()
    assert np.allclose(got, want, atol=1e-4)
    data = np.zeros((v.buckets, lm.CLASSES), np.int64)
    lm.observed(v, data, texts)
    assert data.sum() == lm.CLASS_FEATURES * len(s.rows) + lm.WORD_FEATURES * (v.kind[s.rows] > lm.SINGLES).sum() and np.allclose(data.sum(axis=1), got.sum(axis=1), atol=1e-3)


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = [dict(map(tuple, lm.score(docs.repartition(k), queries.fold(7) != 2).select("doc_id", "score").collect())) for k in (1, 4, 32)]
    for other in got[1:]:
        assert other.keys() == got[0].keys() and all(abs(other[i] - got[0][i]) <= 1e-6 * abs(got[0][i]) for i in other)


def test_model_beats_unigrams_held_out(spark):
    got = queries.op4_lm_score(spark, f"{DATA}/sf0.01").filter("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum() and len(got)


def test_lm_edges(docs, empty, nulls):
    none = lm.score(docs, F.lit(False)).collect()
    assert {r["base_score"] for r in none} == {0.0} and {r["n_known"] for r in none} == {0}
    assert lm.score(empty, F.lit(True)).count() == 0
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in lm.score(nulls, F.lit(True)).collect()} == {(1, 1, 3)}


def test_every_context_word_is_told_apart():
    """Words outside the head too, and the class three words back is seen, by both factors."""
    head = [(f"w{i}", 10_000 - i) for i in range(5000)]
    v = lm.Vocabulary.build(head, {}, 5, 1000, 5002)
    back = lambda t: np.hstack(v.stream([t]).features(slice(0, 10)))
    a, b = "xxing", "yying"
    assert lm._shape(a) == lm._shape(b) and a not in v.index
    for x, y in ((a, b), ("w4998", "w998"), ("w4999", "w999")):
        assert lm._shape(x) == lm._shape(y)
        for k in (0, 1, 4, 5):  # the word before and the one before that
            at = 1 + k % 2
            assert back([x, "w1"])[at, k] != back([y, "w1"])[at, k]
    assert (back(["w1", "w2", "w3"])[3] != back(["w4", "w2", "w3"])[3]).sum() == 1 and back(["w1"]).shape == (2, 6)


def test_buckets_grow_with_the_vocabulary():
    size = lambda distinct: lm.Vocabulary.build([("a", 1)], {}, 1, 1, distinct).buckets
    assert size(93) == lm.BUCKETS and 1.9 < size(16_000_000) / size(8_000_000) < 2.1 and size(10**12) == lm.MOST_BUCKETS
    v = lm.Vocabulary.build([("a", 1)], {}, 1, 1, 8_000_000)
    s = v.stream([[f"t{i}" for i in range(20_000)]])
    assert max(max(x.max() for x in s.features(w)) for w in s.windows()) > lm.BUCKETS


def test_very_long_text_scores_as_its_windows_do():
    """A text over many windows has the sum of its tokens' scores, whatever the window."""
    v, weights, _ = small_model(3)
    text = [f"w{i * 7 % 3100}" for i in range(3 * lm.WINDOW + 5)]
    whole = model_logs(v, weights, [text])
    assert len(whole) == len(text) + 1 and whole[lm.WINDOW - 4 : lm.WINDOW + 4] == pytest.approx(model_logs(v, weights, [text[: lm.WINDOW + 50]])[lm.WINDOW - 4 : lm.WINDOW + 4], abs=1e-5)



# 7: HTML


PAGE = """<body class="has-sidebar"><header class="site-header"><h1>Site</h1><a href=/>Home</a></header><div id="cookieNotice"><p>We use cookies to improve your experience on this site.</p></div>
<main><article><header><h1>Title here</h1></header><p>First paragraph of the article, with <a href=x>a link</a> &amp; more.</p><div class="ad">Buy this thing now, it is the best thing ever made.</div><p>Short   one.</p>
<ul><li>Item one<li>Item two is longer</ul><form><label>Mail</label><input></form><p>The last&nbsp;paragraph&#8212;ends.<br>Here.</article><section class="comments"><h2>Comments</h2><p>I really like this article, it was very good to read.</p></section></main>
<aside><h3>Related</h3><p>Another article you may like to read today.</p></aside><script>var a = "<p>no</p>";</script><footer>c 2020</footer></body>"""


def test_page():
    assert mincut.main_text(PAGE).split("\n") == ["Title here", "First paragraph of the article, with a link & more.", "Short one.", "Item one", "Item two is longer", "The last paragraph—ends. Here."]


def test_page_without_named_parts():
    got = mincut.main_text("<div><a href=1>One</a> <a href=2>Two</a></div><div><h2>A story</h2><p>Once upon a time there was a very long sentence that had many words in it.<p>And then it went on with another sentence.</div><div><a href=q>more</a> | <a href=z>links here</a></div>")
    assert got.split("\n")[0] == "A story" and len(got.split("\n")) == 3


@pytest.mark.parametrize("seed", range(8))
def test_minimum_cut_against_all_labellings(seed):
    r = random.Random(seed)
    n = 8
    gain = [r.uniform(-3, 3) for _ in range(n)]
    edges = [(i, j, r.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if r.random() < 0.4]
    cost = lambda y: sum(-g if not k and g > 0 else 0 for g, k in zip(gain, y)) * -1 + sum(-g for g, k in zip(gain, y) if k and g < 0) + sum(c for a, b, c in edges if y[a] != y[b])
    assert cost(mincut.minimum_cut(gain, edges)) == pytest.approx(min(cost(y) for y in itertools.product((False, True), repeat=n)))


def test_pages_of_the_driver(spark):
    import html as H

    got = queries.op7_html_mincut(spark, SF).toPandas()
    src = spark.read.parquet(f"{SF}/pages.parquet").toPandas().set_index("page_id")
    for r in got.itertuples():
        body = re.search("<article>(.*?)</article>", src.html[r.page_id], re.S)[1]
        parts = (" ".join(H.unescape(re.sub("</?b>|<br>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", body))
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_training_reads_whole_pages(spark):
    """What stands after 500 blocks counts."""
    body = "<main>" + "".join(f"<p>Paragraph number {i} of the article is here.</p>" for i in range(600)) + "</main>"
    end = "".join(f"<footer><p>Link {i}</p></footer>" for i in range(300))
    train = lambda html: mincut.train(spark.createDataFrame([(html,)], "html string"))
    assert not np.allclose(train(body), train(body + end))



WRAPPED = '<body><div class="layout with-sidebar"><article><h1>Title here</h1><p>The first paragraph of the article.</p><div class="share">Share this</div><p>The last paragraph of it.</p></article><div class="sidebar"><p>Other things to read.</p></div></div></body>'


def test_article_in_a_wrapper_named_like_noise():
    assert mincut.main_text(WRAPPED).split("\n") == ["Title here", "The first paragraph of the article.", "The last paragraph of it."]


@pytest.mark.parametrize("first", [True, False])
def test_teasers_stay_noise(first):
    """Where an article stands outside, articles of a noisy container are teasers."""
    own, other = "<article><p>The first paragraph of the article.</p></article>", '<div class="related"><article><p>Another article you may like to read today.</p></article></div>'
    assert mincut.main_text(own + other if first else other + own) == "The first paragraph of the article."



LONG = ["The first paragraph of this article says a good deal about the matter at hand, and it does so at length.", "A second paragraph follows it, which goes on about the same things for a while longer than it should have."]
TWO = "".join(f"<p>{t}</p>" for t in LONG)


@pytest.fixture(scope="module")
def trained(spark):
    return mincut.train(spark.read.parquet(f"{SF}/pages.parquet"))


@pytest.mark.parametrize(
    "body",
    [
        f'<main class="with-sidebar">{TWO}</main>',
        f'<article class="post category-search">{TWO}</article>',
        f'<div id="page" class="has-nav"><nav><a href=/>Home</a></nav><div class="post-content">{TWO}</div></div>',
        f'<div class="related post-with-comments">{TWO}</div>',
        f'<form id="search"><div>{TWO}</div></form>',
        f'<div class="entry no-comments">{TWO}</div><div class="comments"><p>I think that this is a very good article, thank you for it.</p></div>',
    ],
)
def test_one_word_of_a_class_is_no_veto(trained, body):
    html = f"<body><nav><a href=/>Home</a></nav>{body}<footer>c 2020</footer></body>"
    for w in (mincut.PRIOR, trained):
        assert mincut.main_text(html, w).split("\n") == LONG


def unnamed_page(r):
    """A page without any names or semantic elements, and the label of each block: the article has paragraphs of one
    word and of links, the list of links has a line of prose."""
    say = lambda k: " ".join(r.choices("stone river walks along under many green the of a house light".split(), k=k))
    own = [r.choice([say(r.randint(15, 40)) + ".", say(r.randint(15, 40)) + ".", say(2), say(1) + "?", f"<a href=y>{say(4)}</a>"]) for _ in range(r.randint(5, 12))]
    links = lambda k: "".join(f"<li><a href=x>{say(r.randint(1, 4))}</a></li>" for _ in range(k))
    html = f"<div>{''.join(f'<div><a href=x>{say(2)}</a></div>' for _ in range(6))}</div><div><div>{''.join(f'<p>{t}</p>' for t in own)}</div></div><div><ul>{links(5)}</ul><div><div>{say(9)}.</div></div><ul>{links(5)}</ul></div>"
    return html, [False] * 6 + [True] * len(own) + [False] * 11


def test_the_cut_corrects_the_classifier(trained):
    r, sign, cut, total, changed = random.Random(1), 0, 0, 0, 0
    for _ in range(100):
        html, want = unnamed_page(r)
        gain, edges = mincut.graph(mincut.parse(html), trained)
        alone, found = [g > 0 for g in gain], mincut.settle(gain, edges)
        sign, cut, total, changed = sign + sum(map(bool.__eq__, alone, want)), cut + sum(map(bool.__eq__, found, want)), total + len(want), changed + (alone != found)
    assert changed > 50 and cut - sign > total * 0.04 and cut / total > 0.95


def test_membership_is_a_node_of_the_cut():
    """An article carries its weak blocks, and one of links alone is not drawn to content."""
    weak = mincut.parse(f"<article>{TWO}<p><a href=x>Yes</a></p><p>No</p></article>")
    gain, edges = mincut.graph(weak, mincut.PRIOR)
    assert gain[2] < 0 and mincut.settle(gain, edges)[:4] == [True] * 4 and len(gain) == 5
    teasers = "<article class=related>" + "".join(f"<a href={i}>More</a><br>" for i in range(5)) + "</article>"
    assert mincut.main_text(f"<article>{TWO}</article>{teasers}").split("\n") == LONG


@pytest.mark.parametrize("seed", range(6))
def test_settled_labels_are_a_minimum_cut(seed):
    r = random.Random(seed)
    n = 9
    gain = [r.uniform(-4, 4) for _ in range(n)]
    edges = [(i, j, r.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if r.random() < 0.3]
    cost = lambda y: sum(abs(g) for g, k in zip(gain, y) if (g > 0) != k) + sum(c for a, b, c in edges if y[a] != y[b])
    assert cost(mincut.settle(gain, edges)) == pytest.approx(min(cost(y) for y in itertools.product((False, True), repeat=n)))


def test_training_labels_are_not_the_features(trained):
    """Blocks in and out of the article with equal features: membership itself is none, and training moves weights."""
    page = lambda tag: mincut.parse(f"<body><div><{tag}><p>Some words here.</p></{tag}></div><div><div><p>Some words here.</p></div></div></body>")
    for tag in ("article", "div"):
        p = page(tag)
        x = mincut.block_features(p, mincut.setting(p))
        assert (x[0] == x[1]).all()
    assert mincut.labelled(page("article"))[1].tolist() == [True, False] and not len(mincut.labelled(page("div"))[1])
    assert np.abs(trained - mincut.PRIOR).max() > 0.3


def test_very_long_page():
    html = "<body><nav>" + "<a href=x>Link</a><br>" * 2000 + "</nav><main>" + f"{TWO}<p>Yes</p>" * 4000 + "</main></body>"
    assert mincut.main_text(html).split("\n") == [*LONG, "Yes"] * 4000
    word = "x" * 3_000_000
    assert mincut.main_text(f"<article><p>{LONG[0]}<p>{word}<p>{LONG[1]}</article>").split("\n") == [LONG[0], word, LONG[1]]


def test_html_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p>"), (4, "w", "plain text, no tags at all."), (4, "w", "<nav>a</nav>"), (5, "x", "<p>" * 3000 + "deep text."), (6, "y", "</div></p>&bogus; &#0; <![x ok text.")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    got = mincut.extract(df, mincut.train(df)).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["text"] for r in got if r["page_id"] in (1, 2, None)} == {""}
    assert mincut.extract(df.limit(0)).count() == 0


# words


def test_words():
    t = "a\x1cb c d\x0b e　f\x85g "
    assert W.words(t) == re.findall(WORD, t) and W.lower_ascii("ÀBC É İ") == "Àbc É İ"


def test_gram_order_counts():
    h = W.Hashes()
    a, b = h.of(["x", "y", "z"]), h.of(["y", "x", "z"])
    assert W.grams(a, 3)[0] != W.grams(b, 3)[0] and len(W.grams(a, 4)) == 0


def test_lm_rows_are_added_by_key():
    """Keys of many rows, of few and of one, in small and large tables."""
    r = np.random.default_rng(5)
    for size in (70_000, 500):
        keys = np.concatenate([np.full(200, 3), r.integers(0, size, 700), np.full(33, 9), np.full(32, 11)])
        x = r.random((len(keys), 4), dtype=np.float32)
        got, want = np.ones((size, 4)), np.ones((size, 4))
        lm.add_rows(got, keys, x)
        np.add.at(want, keys, x)
        assert np.allclose(got, want, rtol=1e-5)


def test_lm_first_expectation_needs_no_softmax():
    """With weights of 0 what is expected is known from counts; other weights go through odds."""
    texts = [[f"w{i * i % 97}" for i in range(k)] for k in (0, 1, 5, 400, 90)]
    count = Counter(w for t in texts for w in t)
    head = sorted(count.items(), key=lambda x: (-x[1], x[0]))[:70]
    sums = Counter()
    for w, n in list(count.items()):
        if w not in dict(head[: lm.SINGLES]):
            sums[lm._shape(w)] += n + 1
    v = lm.Vocabulary.build(head, sums, len(texts), sum(count.values()) + len(texts), len(count) + 1)
    a, b = np.zeros((v.buckets, lm.CLASSES)), np.zeros((v.buckets, lm.CLASSES))
    lm.expected(v, np.zeros((v.buckets, lm.CLASSES), np.float32), a, texts)
    lm.expected_at_start(v, b, texts)
    assert np.allclose(a, b, rtol=1e-4, atol=1e-5) and b.sum() > 0
    a, b = np.zeros((v.buckets, lm.CLASSES)), np.zeros((v.buckets, lm.CLASSES))
    lm.expected(v, np.zeros((v.buckets, lm.CLASSES), np.float32), a, [[]])
    lm.expected_at_start(v, b, [[]])
    assert np.allclose(a, b, rtol=1e-4, atol=1e-5)


def test_sets_of_no_pair_are_not_joined(spark):
    """Of 2,000 sets, two pairs name three: few others pass the filter, and the overlaps are right."""
    rows = [(i << 44, 4, 0, np.arange(i, i + 4, dtype=np.uint64).tobytes()) for i in range(2000)]
    sets = spark.createDataFrame(rows, "owner long, n long, fragment int, tokens binary")
    pairs = spark.createDataFrame([(5 << 44, 6 << 44), (5 << 44, 8 << 44)], "a long, b long")
    left = [r["a"] for r in jaccard._sets_of(sets, pairs, "a", "x", 3).collect()]
    right = [r["b"] for r in jaccard._sets_of(sets, pairs, "b", "y", 3).collect()]
    assert 5 << 44 in left and {6 << 44, 8 << 44} <= set(right) and len(left) + len(right) < 40
    assert sorted((r["a"] >> 44, r["b"] >> 44, r["common"]) for r in jaccard.count_overlaps(pairs, sets).collect()) == [(5, 6, 3), (5, 8, 1)]
    assert jaccard.count_overlaps(pairs.limit(0), sets).count() == 0


def test_lm_scores_take_known_odds():
    """Scores from the weights' exponentials are those from the weights, for words of every kind."""
    v, weights, _ = small_model(4)
    texts = [["w3", "w70", "rare", "w5"] * 20, [], ["w1"]]
    s = v.stream(texts)
    want = np.zeros(len(s.rows))
    for window in s.windows():
        for places, _, y, z in lm.factors(v, weights, s, window):
            z = z.astype(float)
            want[window.start + places] += (z[np.arange(len(y)), y] - np.log(np.exp(z).sum(axis=1))) / np.log(10)
    kinds = v.kind[s.rows]
    want += np.where((kinds > lm.SINGLES) & (v.entry[s.rows] == lm.OWN), v.logc[s.rows] - v.log_share[kinds], 0.0)
    got = lm.log_probabilities(v, weights, s, np.exp(weights))
    assert np.allclose(got, want, atol=1e-5) and np.isfinite(got).all()


def test_lm_reads_texts_once_to_count_and_once_to_code(spark):
    """Rows go through the source three times (words, their number, codes), however many updates and scores follow."""
    read = spark.sparkContext.accumulator(0)

    def texts(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = spark.createDataFrame([(i, f"one two w{i % 9} w{i % 5} v{i}") for i in range(60)], "doc_id long, text string").mapInArrow(texts, "doc_id long, text string")
    assert lm.score(docs, F.lit(True)).count() == 60 and read.value <= 3 * 60


def test_lm_codes_are_the_texts(spark, monkeypatch):
    """What is read back, in slices of any size, is what the words give; words outside the head keep their own hash."""
    v, _, counts = small_model(5)
    texts = [["w3", "rare", "zzz", "zzz", "w2999"], [], ["odd"], ["w1"] * 40 + ["é", "日本"], ["zzz"]]
    source = spark.createDataFrame([(i, " ".join(t) if t else None, i % 2 or None) for i, t in enumerate(texts)], "doc_id long, text string, share long").coalesce(1)
    table = lm._code(source, spark.sparkContext.broadcast(v), 5, 1000, 3003).toArrow().combine_chunks()
    (b,) = table.to_batches()
    whole = v.stream(texts)
    for size in (1, 7, 1 << 17):
        monkeypatch.setattr(lm, "TOKENS", size)
        got = list(v.streams(b))
        assert [start for start, _ in got] == [sum(len(s.n) for _, s in got[:i]) for i in range(len(got))] and len(got) == (1 if size > 100 else 5 if size == 1 else len(got))
        for name in ("rows", "n", "context"):
            assert np.array_equal(np.concatenate([getattr(s, name) for _, s in got]), getattr(whole, name))
    rows = table.to_pylist()
    assert [dict(r["rest"]) for r in rows] == [dict(Counter(w for w in t if w not in v.index)) for t in texts]
    assert [r["known"] for r in rows] == [sum(w in v.index for w in t) + 1 for t in texts] and [r["share"] for r in rows] == [None, 1, None, 1, None]
