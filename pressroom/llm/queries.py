"""The registered queries of this folder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.llm import bpe, decontaminate, html_text, idfiles, licences, minhash, phrases, pii, quality, search, suffix, toxicity, vectors
from pressroom.llm.common import scratch_folder, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenise(
        table(spark, sf_dir, "documents"),
        RANKS,
        public_tokenizers.PATTERN,
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(table(spark, sf_dir, "documents"), size=3, percent=85)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.report(table(spark, sf_dir, "documents"))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "id-files")
    keys = idfiles.write(table(spark, sf_dir, "documents"), folder, WORD_TOKENIZER, END_ID)
    return idfiles.read(spark, folder, keys).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_minhash": op2_minhash,
    "op3_decontamination": op3_decontamination,
    "op4_html": op4_html,
    "op5_suffix": op5_suffix,
    "op6_pii": op6_pii,
    "op7_licences": op7_licences,
    "op8_vectors": op8_vectors,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_id_files": op11_id_files,
    "op12_phrases": op12_phrases,
    "op13_search": op13_search,
}

# SQL twins, where SQL can tell the result and is quick enough on whole tables. All others are tested
# against plain Python in tests/llm.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2_SQL = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
   spots AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM w WHERE len(w) > 0),
   sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM spots),
   size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
   pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
   near AS (SELECT a, b FROM pair p JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * p.n >= 85 * (x.n + y.n - p.n)),
   link AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
   reach(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM reach r JOIN link l ON l.a = r.id),
   comp AS (SELECT id, min(root) AS c FROM reach GROUP BY id)
   SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
   FROM documents d JOIN comp ON id = d.doc_id LEFT JOIN size s ON s.doc_id = d.doc_id"""

_OP3_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
   b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
   starts AS (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0),
   windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + 12], ' ') AS phrase FROM starts),
   sizes AS (SELECT DISTINCT size FROM windows),
   places AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase
              FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)),
   hits AS (SELECT doc_id, item_id, i, p.size FROM places p JOIN windows v ON v.size = p.size AND v.phrase = p.phrase),
   covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS k FROM hits) GROUP BY doc_id),
   found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
             FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
   SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items,
          sha256(coalesce(items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * c.n >= len(w) AS contaminated
   FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id"""

_OP8_SQL = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
      WHERE len(embedding) > 0 AND list_count(embedding) = len(embedding) AND isfinite(list_sum(embedding)) AND list_min(embedding) < list_max(embedding)),
   link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
   reach(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM reach r JOIN link l ON l.a = r.id),
   comp AS (SELECT id, min(root) AS c FROM reach GROUP BY id), links AS (SELECT a, count(*) AS n FROM link GROUP BY a)
   SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept
   FROM embeddings JOIN comp ON id = vec_id LEFT JOIN links ON a = vec_id"""

_OP12_SQL = rf"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
   w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
   total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
   spots AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM w WHERE len(w) > 0),
   runs AS (SELECT lang, w[i:i + 3] AS run FROM spots),
   f AS (SELECT lang, size, phrase, count(*) AS n
         FROM (SELECT lang, size, array_to_string(run[1:size], ' ') AS phrase FROM runs, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(run) >= size)
         GROUP BY ALL HAVING count(*) >= 30),
   c AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
   cuts AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y
            FROM (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM c)),
   scored AS (SELECT cuts.lang, cuts.phrase, a, k, l.n AS l, r.n AS r, CAST((2000000::HUGEINT * a) // (l.n + r.n) AS BIGINT) AS score
              FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
   cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
   inside AS (SELECT lang, phrase, max(a) AS longer
              FROM (SELECT lang, a, array_to_string(ws[i:i + size_ - 1], ' ') AS phrase
                    FROM (SELECT *, unnest(generate_series(1, size - size_ + 1)) AS i FROM c, (SELECT unnest([2, 3]) AS size_) WHERE size_ < size))
              GROUP BY ALL),
   kept AS (SELECT cut.* FROM cut LEFT JOIN inside i ON i.lang = cut.lang AND i.phrase = cut.phrase WHERE longer IS NULL OR 100 * longer < 80 * a),
   ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
   SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""

_OP13_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
   whole AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
   total AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM whole),
   m AS (SELECT doc_id, 75 + (25 * n * nn) // ll AS m FROM whole, total),
   tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
   wt AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS wt
          FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
   i AS (SELECT item_id, term, count(*) AS k
         FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS term FROM benchmark) GROUP BY ALL),
   s AS (SELECT item_id, doc_id, CAST(sum(k * wt * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
         FROM i JOIN tf USING (term) JOIN wt USING (term) JOIN m USING (doc_id) GROUP BY ALL),
   r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
         FROM s WHERE score > 0)
   SELECT * FROM r WHERE rank <= 20"""

ORACLES: dict[str, str] = {"op2_minhash": _OP2_SQL, "op3_decontamination": _OP3_SQL, "op8_vectors": _OP8_SQL, "op12_phrases": _OP12_SQL, "op13_search": _OP13_SQL}
