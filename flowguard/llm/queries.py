"""Named queries of the operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowguard.llm import (ann, decontam, exact_dedup, langid, lmscore, packing, pii, rans, sharding, simhash,
                           trie, warc, whiten)

SHARDS = [f"shard-{k:03d}" for k in range(64)]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_lm_scoring")
def lm_scoring(spark, sf_dir):
    """Target: documents labelled as good. doc_id, n_tokens, ce_target, ce_background, score."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lmscore.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


@query("op2_simhash_near_dedup")
def simhash_near_dedup(spark, sf_dir):
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


SHARD_SQL = f"""
WITH slots AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)
  % {sharding.TABLE_SIZE} AS BIGINT) AS slot FROM documents),
filled AS (SELECT {sharding.fill(SHARDS)} AS shards)
SELECT doc_id, slot, shards[slot + 1] AS shard FROM slots, filled"""


@query("op3_sharding", SHARD_SQL)
def shard_documents(spark, sf_dir):
    """Shard of every document: doc_id, slot, shard."""
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


@query("op4_language_id")
def language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op5_token_ids")
def token_ids(spark, sf_dir):
    found = rans.encode_and_read(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                        F.crc32("ids").alias("ids_crc32"))


PAGES_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hex FROM p),
b AS (SELECT *, MIN(page_id) OVER (PARTITION BY hex) AS first_id,
  list_reduce(list_transform(range(0, 40), lambda i: lpad(bin(('0x' || hex[i + 1])::INT), 4, '0')),
    lambda x, y: x || y) AS bits FROM h)
SELECT page_id, n AS payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    list_reduce(list_transform(range(0, 5), lambda j: bits[i * 5 + j + 1]::INT), lambda x, y: x * 2 + y) + 1]),
    lambda x, y: x || y) AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b"""


@query("op6_warc_salvage", PAGES_SQL)
def warc_salvage(spark, sf_dir):
    files = warc.write(table(spark, sf_dir, "pages"))
    found = warc.read(files, with_payload=False)
    return found.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest",
                        "record_type", warc.page_of("refers_to").alias("refers_to"))


@query("op7_packing")
def pack_documents(spark, sf_dir):
    packed = packing.pack(table(spark, sf_dir, "documents"), with_ids=False)
    return packed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
                         "doc_tokens", "sequence_id", "offset")


@query("op8_benchmark_decontamination")
def benchmark_decontamination(spark, sf_dir):
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_pii")
def personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.train(docs))


@query("op10_exact_dedup", r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, MIN(doc_id) OVER same AS keep_id, COUNT(*) OVER same AS group_size,
  doc_id = MIN(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM n WINDOW same AS (PARTITION BY body)""")
def exact(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))



TRIE_SQL = r"""
WITH RECURSIVE polynomials AS (
  SELECT range AS byte, list_reduce(list_prepend(range, range(0, 8)), lambda a, i:
    CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS crc FROM range(0, 256)),
codes AS (SELECT list(crc ORDER BY byte) AS crcs FROM polynomials),
t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, ROW_NUMBER() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(length(coalesce(role, ''))::VARCHAR || ':' ||
      coalesce(role, '') || coalesce(text, '')), 1, 32)) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'r': r, 'x': x} ORDER BY pos) AS turns FROM t GROUP BY conv_id),
heads AS (SELECT conv_id, turns, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, c: xor(a >> 8, crcs[xor(a & 255, c) + 1])), 4294967295) % 4 AS h FROM own, codes),
c AS (SELECT a.conv_id, list_concat(coalesce(list_slice(b.turns, 1, a.h), []), list_slice(a.turns, a.h + 1, len(a.turns)))
    AS turns FROM heads a LEFT JOIN own b ON b.conv_id = a.base),
p AS (SELECT conv_id, turns, d, CASE WHEN d = 0 THEN [] ELSE list_slice(turns, 1, d) END AS path
  FROM c, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)),
n AS (SELECT path, d, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(turns) = d), '') AS ends
  FROM p GROUP BY path, d),
k AS (SELECT path, d, CASE WHEN d > 0 THEN list_slice(path, 1, d - 1) END AS above,
    (n_convs - 1) * CASE WHEN d > 0 THEN len(regexp_extract_all(path[d].x, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved FROM n),
kids AS (SELECT above, COUNT(*) AS n FROM k WHERE d > 0 GROUP BY above),
s AS (SELECT list_slice(k.path, 1, u.a) AS path, SUM(k.saved) AS saved, COUNT(*) FILTER (WHERE kids.n IS NULL) AS leaves
  FROM k LEFT JOIN kids ON kids.above = k.path, LATERAL (SELECT unnest(range(0, k.d + 1)) AS a) u GROUP BY 1)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children,
  s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN k ON k.path = n.path LEFT JOIN n up ON up.path = k.above
LEFT JOIN kids ON kids.above = n.path JOIN s ON s.path = n.path"""


@query("op11_conversation_trie", TRIE_SQL)
def conversation_trie(spark, sf_dir):
    """A row for each node of the trie of rebuilt conversations."""
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


@query("op12_nearest_neighbours")
def nearest_neighbours(spark, sf_dir):
    """The 5 nearest rows of every vector whose id is divisible by 50."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5)


@query("op13_embedding_whitening")
def embedding_whitening(spark, sf_dir):
    return whiten.whiten(table(spark, sf_dir, "embeddings"))
