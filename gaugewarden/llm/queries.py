"""One registered query per operator on its whole table, with the SQL it must agree with where SQL can say it."""

from collections.abc import Callable
import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import bound_batches, scratch_path, share_package
from . import centroids, collocations, decontamination, encode, exact_dedup, language_id, mixing, packing, secret_scan, simhash, token_counts, token_files, vector_dedup, warc

#: Vocabulary the queries use; the operators take any path.
VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2_048
PIECE_TOKENS = 4_096

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        share_package(spark)
        bound_batches(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", mixing.domain_of(F.col("quality"), F.col("toxic")).alias("domain"))


@query
def op1_mixture_rates(spark, sf_dir):
    """Tokens, domain posteriors, fitted rate and copies of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    mixed = mixing.mixture(docs, domain_labels(spark, sf_dir), keep=["doc_id"])
    shares = [F.round(F.col("posterior")[i], 9).alias(f"p_{d}") for i, d in enumerate(mixing.DOMAINS)]
    return mixed.select("doc_id", "n_tokens", *shares, "rate", "copies")


@query
def op2_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path(VOCABULARY))
    return counted.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens",
                          (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@query
def op3_simhash_near_duplicates(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_exact_duplicates(spark, sf_dir):
    found = exact_dedup.exact_duplicates(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op4_exact_duplicates"] = r"""
    SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, text_sha256
    FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    WINDOW same AS (PARTITION BY text_sha256)"""


@query
def op5_warc_archives(spark, sf_dir):
    """Writes every page, reads the archives back and describes what they hold."""
    folder = scratch_path(spark, "warc")
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((" + " + ".join(
    f"(strpos('0123456789abcdef', substr(h, CAST(1 + (i // 4) * 5 + {k} AS INTEGER), 1)) - 1) * {16 ** (4 - k)}" for k in range(5)
) + ") // CAST(2 ** (15 - 5 * (i % 4)) AS BIGINT)) % 32, 1)), '')"
ORACLES["op5_warc_archives"] = f"""
    SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
        CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h,
        min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)"""


@query
def op6_secret_scans(spark, sf_dir):
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query
def op7_near_duplicate_vectors(spark, sf_dir):
    return vector_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@query
def op8_packed_sequences(spark, sf_dir):
    return packed_documents(table(spark, sf_dir, "documents"))


def packed_documents(docs: DataFrame) -> DataFrame:
    """Pieces of all documents with their place in sequences; the ids are reduced to their checksum before anything is written."""
    pieces = encode.encode_pieces(docs, public_tokenizers.path(VOCABULARY), end_id=1, piece_tokens=PIECE_TOKENS)
    digested = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(digested, PIECE_TOKENS).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op9_token_files(spark, sf_dir):
    """Writes the token files of all documents, reads them back and describes what they hold."""
    folder = scratch_path(spark, "token-files")
    docs = table(spark, sf_dir, "documents")
    index = token_files.write_token_files(docs, folder, public_tokenizers.path(VOCABULARY), end_id=2)
    return token_files.read_token_files(spark, folder, index).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn(
        "remainder", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3)
    model = language_id.fit_languages(docs.where("remainder <> 1"))
    return language_id.identify_languages(docs.select("doc_id", "text", "remainder"), model).select(
        "doc_id", F.coalesce(F.col("remainder") == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op11_benchmark_overlap(spark, sf_dir):
    """Words, hit words and items found of every document."""
    found = decontamination.find_benchmark_text(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _words_sql(of: str) -> str:
    lower = f"translate(coalesce({of}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


# Windows are numbered by their first word; a document is keyed by its row, as ids may repeat.
ORACLES["op11_benchmark_overlap"] = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words_sql('text')} AS w FROM documents),
    b AS (SELECT item_id, {_words_sql('text')} AS w FROM benchmark),
    wanted AS (SELECT DISTINCT item_id, least(len(w), 10) AS m,
        unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS phrase
        FROM b WHERE len(w) > 0),
    there AS (SELECT r, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM d, (SELECT DISTINCT m FROM wanted) WHERE len(w) >= m),
    met AS (SELECT r, i, t.m, item_id FROM there t JOIN wanted ON t.m = wanted.m AND array_to_string(w[i:i + t.m - 1], ' ') = phrase),
    covered AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + m)) FROM met) GROUP BY r),
    named AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM met WHERE item_id IS NOT NULL) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)"""


@query
def op12_centroid_clusters(spark, sf_dir):
    clustered, final = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.tolist()]
    return clustered.withColumn("centroid_sha256", F.array(*map(F.lit, digests)).cast("array<string>")[F.col("cluster")])


def _rounds_sql(rounds: int) -> str:
    near = "SELECT r, i, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, i) AS place FROM ({})) WHERE place = 1"
    gap = ("SELECT r, i, CAST(list_sum(list_transform(range(1, 65), lambda j: (x[j] - c[j]) * (x[j] - c[j]))) AS BIGINT) AS d"
           " FROM v, c{}")
    steps = []
    for n in range(rounds):
        steps += [f"a{n} AS MATERIALIZED ({near.format(gap.format(n))})",
                  f"""m{n} AS (SELECT i, list(f ORDER BY j) AS c FROM (SELECT i, j, CAST(floor_div AS BIGINT) AS f FROM (
                      SELECT i, j, (CAST(sum(y) AS BIGINT) - ((CAST(sum(y) AS BIGINT) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div
                      FROM (SELECT i, unnest(range(1, 65)) AS j, unnest(x) AS y FROM a{n} JOIN v USING (r)) GROUP BY i, j)) GROUP BY i)""",
                  f"c{n + 1} AS MATERIALIZED (SELECT i, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (i))"]
    steps.append(f"a{rounds} AS MATERIALIZED ({near.format(gap.format(rounds))})")
    return ", ".join(steps)


ORACLES["op12_centroid_clusters"] = f"""
    WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
        FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS i, x AS c FROM v QUALIFY i < 40),
    {_rounds_sql(centroids.ROUNDS)}
    SELECT vec_id, CAST(i AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY i) AS BIGINT) AS cluster_inertia,
        CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a{centroids.ROUNDS} JOIN v USING (r) JOIN c{centroids.ROUNDS} USING (i)"""


@query
def op13_phrase_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


_PIECES = ("unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
           "'[.,;:!?\\x0A-\\x0D]'))")
ORACLES["op13_phrase_collocations"] = f"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT lang, {_PIECES} AS piece FROM documents)),
    f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM (SELECT lang, size, unnest(list_transform(
        range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
        FROM p, (SELECT unnest(range(1, 4)) AS size) WHERE len(w) >= size) GROUP BY ALL),
    totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
    c AS MATERIALIZED (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
    cuts AS (SELECT c.lang, c.phrase, a, k, lf.f AS l, rf.f AS r, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(lf.f AS HUGEINT) * rf.f) AS BIGINT) AS score
        FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c
        JOIN f lf ON lf.lang = c.lang AND lf.phrase = array_to_string(w[1:k], ' ')
        JOIN f rf ON rf.lang = c.lang AND rf.phrase = array_to_string(w[k + 1:], ' ')),
    scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inner_ AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a AS longer FROM c WHERE size = 3),
    kept AS (SELECT * FROM scored s WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = s.lang AND i.phrase = s.phrase AND 100 * longer >= 50 * a))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000"""
