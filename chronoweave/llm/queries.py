"""The subpackage's queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard, langid, lm, merkle, mincut, minhash, naming, ogg, packing, quality, spelling, suffixes


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op5_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_digests(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.exact_duplicates(documents(spark, sf_dir)).drop("row_id")


def fold(of: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold(5) != 0)
    found = quality.score(docs, quality.train(docs, labels), threshold=0.3)
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(documents(spark, sf_dir))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score(documents(spark, sf_dir), fold(7) != 2)
    return found.select("doc_id", (fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return mincut.extract(pages, mincut.train(pages))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learn = docs.filter((fold(4) != 2) & F.col("lang").isNotNull())
    found = langid.identify(docs, langid.train(learn))
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json")).drop("ids")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_digests(documents(spark, sf_dir))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.document_variants(documents(spark, sf_dir))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_quality": op2_quality,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_lm_score": op4_lm_score,
    "op5_media_ogg": op5_media_ogg,
    "op6_packing": op6_packing,
    "op7_html_mincut": op7_html_mincut,
    "op8_bpe": op8_bpe,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language": op10_language,
    "op11_merkle": op11_merkle,
    "op12_spelling": op12_spelling,
    "op13_minhash": op13_minhash,
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc32(x: str) -> str:
    """crc32 of a string's UTF-8 bytes."""
    data = f"list_transform(range(1, CAST(length(hex({x})) AS BIGINT), 2), lambda p: CAST('0x' || substr(hex({x}), CAST(p AS BIGINT), 2) AS BIGINT))"
    eight = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), lambda c, b: {eight}))"


def _field(x: str) -> str:
    return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


def _levels(nodes: str) -> str:
    """Nodes of all levels of the trees in ``nodes`` (tree, i, digest), as levels (tree, k, list)."""
    return f"""SELECT tree, 0 AS k, list(digest ORDER BY i) AS nodes FROM {nodes} GROUP BY tree
        UNION ALL SELECT tree, k + 1, list_transform(range(1, len(nodes) + 1, 2), lambda p: sha256(nodes[p] || coalesce(nodes[p + 1], ''))) FROM {{}} WHERE len(nodes) > 1"""
ORACLE = {
    "op1_ngram_jaccard": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w),
        grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (min(a.n) + min(b.n) - count(*))),
        sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT d, b FROM reach JOIN sym ON a = r)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(r) FROM reach WHERE d = doc_id) AS component_id FROM sets""",
    "op3_suffix_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        runs AS (SELECT doc_id, s, array_to_string(w[s + 1 : s + 50], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS s FROM w WHERE len(w) >= 50)),
        found AS (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r, count(*) OVER (PARTITION BY g) AS n FROM runs),
        marked AS (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p, lag(s) OVER (PARTITION BY doc_id, r > 1 ORDER BY s) AS q FROM found WHERE n > 1),
        -- A later run adds the words that the later run before it does not reach.
        grown AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS k, CASE WHEN r = 1 THEN 0 WHEN q IS NULL THEN 50 ELSE least(50, s - q) END AS more FROM marked)
        SELECT doc_id, min(s) AS start_word, max(s) + 50 - min(s) AS n_words, CAST(sum(more) AS BIGINT) AS n_later FROM grown GROUP BY doc_id, k""",
    "op11_merkle": f"""
        WITH RECURSIVE leaves AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_leaf("n_chars")} AS digest,
            CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf("CAST(n_chars AS HUGEINT) + 1")} END AS tampered FROM documents),
        placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS i FROM leaves),
        levels AS ({_levels("placed").format("levels")}),
        tops AS (SELECT '' AS tree, tree AS of, nodes[1] AS digest, row_number() OVER (ORDER BY tree) - 1 AS i FROM levels WHERE len(nodes) = 1),
        crown AS ({_levels("tops").format("crown")}),
        nodes AS (SELECT tree, k, unnest(nodes) AS digest, unnest(range(len(nodes))) AS i FROM levels WHERE len(nodes) > 1
            UNION ALL SELECT '', 1000 + k, unnest(nodes), unnest(range(len(nodes))) FROM crown WHERE len(nodes) > 1),
        ways AS (SELECT p.tree, p.i, l.k, p.i >> l.k AS at FROM placed p JOIN levels l ON l.tree = p.tree WHERE len(l.nodes) > 1
            UNION ALL SELECT p.tree, p.i, 1000 + c.k, t.i >> c.k FROM placed p JOIN tops t ON t.of = p.tree JOIN crown c ON len(c.nodes) > 1),
        steps AS (SELECT w.tree, w.i, string_agg(coalesce(n.digest, ''), '' ORDER BY w.k) AS proof,
                list(CASE WHEN w.at % 2 = 1 THEN n.digest ELSE '' END || '|' || CASE WHEN w.at % 2 = 0 THEN coalesce(n.digest, '') ELSE '' END ORDER BY w.k) AS s
            FROM ways w LEFT JOIN nodes n ON n.tree = CASE WHEN w.k < 1000 THEN w.tree ELSE '' END AND n.k = w.k AND n.i = xor(w.at, 1) GROUP BY w.tree, w.i),
        folded AS (SELECT p.doc_id, p.digest AS leaf, t.digest AS subroot, (SELECT nodes[1] FROM crown WHERE len(nodes) = 1) AS root, sha256(coalesce(s.proof, '')) AS proof_sha256,
                list_reduce(list_prepend(coalesce(p.tampered, p.digest), coalesce(s.s, [])), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root
            FROM placed p JOIN tops t ON t.of = p.tree LEFT JOIN steps s ON s.tree = p.tree AND s.i = p.i)
        SELECT *, folded_root = root AS verified FROM folded""",
    "op12_spelling": f"""
        WITH RECURSIVE runs AS (SELECT doc_id, {_lower("r")} AS r, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY ALL),
        hashed AS (SELECT r, k, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r")} AS h FROM runs),
        damaged AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, k FROM hashed),
        words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM damaged WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
        less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, n, unnest(range(CAST(length(word) AS BIGINT))) AS i FROM words)),
        near AS (SELECT a.word AS a, b.word AS b, b.n FROM less a JOIN less b ON a.i = b.i AND a.d = b.d AND a.word != b.word
            UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.d = b.word
            UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.d = b.word),
        best AS (SELECT a, count(*) AS n_near, max(n) AS m, first(b ORDER BY n DESC, b) AS b FROM near GROUP BY a),
        forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN b END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM words LEFT JOIN best ON a = word),
        up AS (SELECT word, word AS root FROM words UNION ALL SELECT up.word, f.form FROM up JOIN forms f ON f.word = up.root WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM forms f JOIN up ON up.word = f.word JOIN forms last ON last.word = up.root AND last.form IS NULL""",
    "op13_minhash": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_lower("coalesce(text, '')"))} AS w FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM w),
        grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (min(a.n) + min(b.n) - count(*))),
        sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT d, b FROM reach JOIN sym ON a = r),
        low AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN low ON d = doc_id""",
    "op9_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               CAST(count(*) OVER (PARTITION BY coalesce(text, '')) AS BIGINT) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
}
