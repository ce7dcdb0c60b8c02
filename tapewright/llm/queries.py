"""One registered query per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import (
    centroids, chat, decontaminate, language_id, minhash, nearest, packing, quality, sharding, substring_dedup, toxicity, url_filters,
    whitening,
)
from tapewright.llm.shipping import ship
from tapewright.session import configure, settle

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(configure(spark)).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return sharding.place(docs, F.col("doc_id"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.deduplicate(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def held_out(modulus: int, rest: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == rest, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language_id.train(docs.where(F.col("doc_id").isNotNull() & ~held_out(4, 2)))
    return language_id.predict(docs, net).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Neighbours:
    """Fit on labelled documents whose id is not held out."""
    return quality.train(docs, labels.where(~held_out(3, 1)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


PROBE = "<|im_end|><|im_start|>assistant ok"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    tree = settle(chat.linear_tree(rows), "messages")
    return chat.digests(chat.format_paths(tree)).drop("branch")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


LIST_START = "2023-01-01"


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages carry no fetch date: each gets one day of 1,000 by its id."""
    day = F.date_add(F.lit(LIST_START).cast("date"), F.pmod(F.col("page_id") * 37, F.lit(1000)).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched"))


def lists_of(pages: DataFrame) -> DataFrame:
    """Dated changes for every host and parent domain of two labels seen in ``pages``, by its smallest page id.

    Three of four are listed; one listing in four allows, the rest block. It ends after some hundred days,
    and for every third domain it is renewed later with the other action.
    """
    hosts = pages.where(F.col("page_id").isNotNull()).select("page_id", url_filters.host_of(F.col("url")).alias("host")).where("host is not null")
    seen = hosts.groupBy("host").agg(F.min("page_id").alias("p"))
    names = seen.select("p", F.explode(F.array_distinct(F.array(
        "host", F.substring_index("host", ".", -2)))).alias("domain")).groupBy("domain").agg(F.min("p").alias("p"))
    p = F.col("p")
    begin = F.date_add(F.lit(LIST_START).cast("date"), (p * 53 % 600).cast("int"))
    first = F.when(p % 4 == 1, "allow").otherwise("block")
    other = F.when(p % 4 == 1, "block").otherwise("allow")
    end = F.date_add(begin, (p * 11 % 300 + 1).cast("int"))
    renewed = F.date_add(end, (p * 7 % 90 + 1).cast("int"))
    listed = names.where(p % 4 != 3)
    return (
        listed.select("domain", begin.alias("changed"), first.alias("action"))
        .unionByName(listed.select("domain", end.alias("changed"), F.lit("remove").alias("action")))
        .unionByName(listed.where(p % 3 == 0).select("domain", renewed.alias("changed"), other.alias("action"))))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge(captures_of(pages), lists_of(pages))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs.where(~held_out(5, 0)), table(spark, sf_dir, "labels").where(~held_out(5, 0)))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language_id": op3_language_id,
    "op4_quality": op4_quality,
    "op5_packing": op5_packing,
    "op6_chat": op6_chat,
    "op7_minhash": op7_minhash,
    "op8_decontamination": op8_decontamination,
    "op9_nearest": op9_nearest,
    "op10_url_filters": op10_url_filters,
    "op11_toxicity": op11_toxicity,
    "op12_whitening": op12_whitening,
    "op13_centroids": op13_centroids,
}

def rounds_sql(rounds: int) -> str:
    """Relations a1, c1, a2, ... of the centroid rounds; the last assignment is a<rounds + 1>."""
    steps = []
    for r in range(1, rounds + 2):
        steps.append(f"""a{r} AS (
  SELECT i, min(d * 64 + c) AS best FROM (
    SELECT i, c, list_sum(list_transform(list_zip(kept.x, m.x), lambda z: ((z[1] - z[2]) * (z[1] - z[2]))::HUGEINT)) AS d
    FROM kept CROSS JOIN c{r - 1} AS m) GROUP BY i)""")
        if r <= rounds:
            steps.append(f"""s{r} AS (
  SELECT c, pos, sum(v) AS s, count(*) AS n FROM (
    SELECT (best % 64)::BIGINT AS c, unnest(x) AS v, unnest(range(1, 65)) AS pos FROM a{r} JOIN kept USING (i)) GROUP BY c, pos),
c{r} AS (
  SELECT c, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY pos) AS x FROM s{r} GROUP BY c
  UNION ALL SELECT c, x FROM c{r - 1} WHERE c NOT IN (SELECT c FROM s{r}))""")
    return ",\n".join(steps)


ORACLE: dict[str, str] = {
    "op8_decontamination": """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
items AS (
  SELECT item_id, least(5, len(w)) AS width,
    list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) AS s
  FROM item_words WHERE len(w) > 0),
item_rows AS (SELECT item_id, width, len(s) AS n, unnest(s) AS sh FROM items),
doc_rows AS (
  SELECT DISTINCT doc_id, width, sh FROM (
    SELECT doc_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))) AS sh
    FROM words, (SELECT DISTINCT width FROM items))),
hits AS (
  SELECT doc_id, item_id, count(*) AS shared, any_value(n) AS n_shingles
  FROM doc_rows JOIN item_rows USING (width, sh) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared, n_shingles, shared::DOUBLE / n_shingles AS containment
FROM hits WHERE shared >= ceil(n_shingles * 0.8 - 1e-9)
""",
    "op10_url_filters": """
WITH hosts AS (
  SELECT page_id, url, nullif(regexp_replace(regexp_replace(regexp_replace(lower(
    regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '[.]$', ''), '') AS host,
    DATE '2023-01-01' + ((page_id * 37) % 1000)::INTEGER AS fetched
  FROM pages),
seen AS (SELECT host, min(page_id) AS p FROM hosts WHERE host IS NOT NULL GROUP BY host),
names AS (
  SELECT domain, min(p) AS p FROM (
    SELECT host AS domain, p FROM seen
    UNION ALL SELECT array_to_string(string_split(host, '.')[-2:], '.'), p FROM seen) GROUP BY domain),
dated AS (
  SELECT domain, p, DATE '2023-01-01' + ((p * 53) % 600)::INTEGER AS a,
    DATE '2023-01-01' + ((p * 53) % 600 + (p * 11) % 300 + 1)::INTEGER AS b,
    DATE '2023-01-01' + ((p * 53) % 600 + (p * 11) % 300 + 1 + (p * 7) % 90 + 1)::INTEGER AS c
  FROM names WHERE p % 4 <> 3),
spans AS (
  SELECT domain, CASE WHEN p % 4 = 1 THEN 'allow' ELSE 'block' END AS action, a AS since, b AS until FROM dated
  UNION ALL SELECT domain, CASE WHEN p % 4 = 1 THEN 'block' ELSE 'allow' END, c, NULL FROM dated WHERE p % 3 = 0),
hits AS (
  SELECT page_id, domain, action, since,
    row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC) AS r
  FROM hosts JOIN spans ON (host = domain OR host LIKE '%.' || domain) AND fetched >= since
    AND (until IS NULL OR fetched < until))
SELECT h.page_id, h.host, h.fetched, coalesce(action, 'none') AS decision, domain AS matched, since AS listed_since
FROM hosts h LEFT JOIN hits ON hits.page_id = h.page_id AND r = 1
""",
    "op13_centroids": f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x FROM kept WHERE vec_id IS NOT NULL
  QUALIFY c < {centroids.CENTROIDS}),
{rounds_sql(centroids.ROUNDS)},
met AS (
  SELECT vec_id, (best % 64)::INTEGER AS cluster, (best // 64)::BIGINT AS distance FROM a{centroids.ROUNDS + 1} JOIN kept USING (i)),
total AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM met GROUP BY cluster)
SELECT vec_id, cluster, distance, cluster_inertia, (SELECT sum(distance)::BIGINT FROM met) AS inertia,
  sha256(array_to_string(c{centroids.ROUNDS}.x, ',')) AS centroid_sha256
FROM met JOIN total USING (cluster) JOIN c{centroids.ROUNDS} ON c{centroids.ROUNDS}.c = cluster
""",
}
