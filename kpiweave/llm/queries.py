"""The registered queries of this package: one for each operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiweave.llm import context_tree, conversations, decontaminate, hard_negatives, languages, merkle, near_copies, pieces, quality, secrets, shards, sketch_dedup, token_files
from kpiweave.llm.common import fold, scratch, table

Run = Callable[[SparkSession, str], DataFrame]

#: Texts that score less are predicted to be of label 0.
QUALITY_FLOOR = 0.3
#: Bytes of text that a shard holds at most.
SHARD_BYTES = 32 << 20
BYTE_MODEL = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of all documents, learned from labels of four of five folds."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(fold("doc_id", 5) != 0)
    scored = quality.score(docs, quality.learn(docs, labels))
    return scored.select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= QUALITY_FLOOR, 1).otherwise(0).alias("predicted"),
    )


def op2_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of all documents, learned from three of four folds."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = languages.identify(docs.select("doc_id", "text"), docs.where(fold("doc_id", 4) != 2))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "language.lang_pred", "language.score")


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in all documents: counts and digest of the base kinds, and all spans."""
    found = secrets.find_secrets(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secrets.BASE_RULES]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(r.kind).alias(f"n_{r.kind}") for r in secrets.BASE_RULES],
        F.sha2(secrets.spelled(base), 256).alias("base_sha256"),
        secrets.spelled(F.col("spans")).alias("spans"),
    )


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents, written to files in ascending order of the ids and read back from them."""
    target = scratch(spark, "tokens")
    docs = table(spark, folder, "documents")
    files = token_files.write_files(docs, public_tokenizers.path(BYTE_MODEL), target)
    return token_files.read_files(files, target).withColumnRenamed("id", "doc_id")


def op5_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Log probabilities of all documents, learned from six of seven folds."""
    docs = table(spark, folder, "documents")
    scored = context_tree.score(docs, fold("doc_id", 7) != 2)
    return scored.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents inside occurrences of benchmark windows."""
    found = decontaminate.find_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_sql() -> str:
    upper = "".join(map(chr, range(65, 91)))
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{decontaminate.WORD}', 0)"
    span = decontaminate.SPAN
    return f"""WITH b AS (SELECT item_id::VARCHAR AS item, {words} AS w, least(len(w), {span}) AS n FROM benchmark),
      bw AS (SELECT DISTINCT item, n, array_to_string(w[i + 1 : i + n], ' ') AS x
        FROM (SELECT *, unnest(range(0, len(w) - n + 1)) AS i FROM b WHERE n > 0)),
      d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
      dw AS (SELECT r, i, n, array_to_string(w[i + 1 : i + n], ' ') AS x
        FROM (SELECT *, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
      m AS (SELECT r, i, n, item FROM dw JOIN bw USING (n, x)),
      c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
      k AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM m GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
      sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
      FROM d LEFT JOIN c USING (r) LEFT JOIN k USING (r)"""


def op7_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shard of each document, read back from written shards of at most SHARD_BYTES of text."""
    docs = table(spark, folder, "documents")
    assigned = shards.assign(docs, SHARD_BYTES)
    back = shards.read_shards(assigned, shards.write_shards(assigned))
    return back.select("doc_id", "shard", "depth", "shard_bytes", "shard_rows")


def op8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """SentencePiece ids of all documents and the texts decoded from them, as digests."""
    model = public_tokenizers.path(PIECE_MODEL)
    encoded = pieces.encode_texts(table(spark, folder, "documents").select("doc_id", "text"), model)
    decoded = pieces.decode_ids(encoded.select("doc_id", "ids"), model)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        pieces.ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles are alike by 90 percent or more."""
    return near_copies.find_groups(table(spark, folder, "documents"), length=3, least=90)


def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    docs = merkle.with_next(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text", "following")
    docs = docs.withColumn("edited", merkle.edited(F.col("text"), F.col("following")))
    for text, name in (("text", "fingerprint"), ("edited", "edited_fingerprint"), ("following", "next_fingerprint")):
        docs = merkle.with_fingerprint(docs, text, name)
    return docs.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        merkle.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        merkle.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op10_sql() -> str:
    """The same in SQL: the pattern of the cut, the hashes and the fan-out are the operator's."""
    cut = lambda x, pattern: f"regexp_extract_all({x}, '{pattern}', 0)"
    fingerprint = lambda x: f"""(SELECT concat_ws('|', sha256(array_to_string(s, '')),
            array_to_string(list_transform(s, lambda h: h[1:{merkle.SHORT}]), ','),
            array_to_string(list_transform(list_zip(p, l), lambda z: z[1][1:{merkle.SHORT}] || ':' || len(z[2])), ','),
            array_to_string(list_transform(flatten(l), lambda h: h[1:{merkle.SHORT}]), ','))
        FROM (SELECT *, list_transform(range(0, (len(p) + {merkle.FANOUT - 1}) // {merkle.FANOUT}),
                lambda i: md5(array_to_string(p[i * {merkle.FANOUT} + 1 : i * {merkle.FANOUT} + {merkle.FANOUT}], ''))) AS s
            FROM (SELECT *, list_transform(l, lambda x: md5(array_to_string(x, ''))) AS p
                FROM (SELECT list_transform({cut(x, merkle.PARAGRAPH)}, lambda x: list_transform({cut("x", merkle.SENTENCE)}, lambda y: md5(y))) AS l))))"""  # noqa: E731
    leaves = lambda f: f"list_distinct(string_split(string_split({f}, '|')[4], ','))"
    near = lambda a, b: f"""CASE WHEN string_split({a}, '|')[1] = string_split({b}, '|')[1] THEN 1.0::DOUBLE
        ELSE 2.0::DOUBLE * len(list_intersect({leaves(a)}, {leaves(b)})) / (len({leaves(a)}) + len({leaves(b)})) END"""  # noqa: E731
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC, t), first_value(t) OVER (ORDER BY doc_id DESC, t)) AS x FROM d),
      e AS (SELECT *, left(t, (length(t) - length(t) // 2)::BIGINT) || left(x, (length(t) // 2)::BIGINT) AS y FROM n),
      f AS (SELECT *, {fingerprint("t")} AS ft, {fingerprint("y")} AS fy, {fingerprint("x")} AS fx FROM e)
    SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(y) AS edited_sha256, ft AS fingerprint, fy AS edited_fingerprint,
      {near("ft", "fy")} AS near_edited, {near("ft", "fx")} AS near_next FROM f"""


def op7_sql() -> str:
    return f"""WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS b,
        ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h FROM documents),
      l AS (SELECT depth, h >> (60 - depth) AS p, sum(b) AS b, count(*) AS n
        FROM d, (SELECT unnest(range(0, 61))::INTEGER AS depth) GROUP BY ALL)
    SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(p), depth, '0') END AS shard, depth,
        l.b::BIGINT AS shard_bytes, n::BIGINT AS shard_rows
      FROM d JOIN l ON h >> (60 - depth) = p WHERE l.b <= {SHARD_BYTES}
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1"""


def op11_sketch_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles are alike by 80 percent or more, and which documents stay."""
    return sketch_dedup.find_groups(table(spark, folder, "documents"), length=4, least=80)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations, damaged by crc32 of ``conv_id:turn``; nulls count as one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(kind == 4, "user").otherwise(said("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Repairs of all conversations after damage: faults, cost, audit and digest of the repaired rows."""
    rows = table(spark, folder, "conversations")
    summary, edits = conversations.find_repairs(damaged(rows))
    both = summary.join(conversations.digests(edits).withColumnRenamed("conv_id", "conv_id_"), F.col("conv_id").eqNullSafe(F.col("conv_id_"))).drop("conv_id_")
    every = rows.select(F.col("conv_id").alias("conv_id_")).distinct()
    out = every.join(both, F.col("conv_id").eqNullSafe(F.col("conv_id_")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        F.col("conv_id_").alias("conv_id"),
        *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of all anchors; the label of every seventh id is first moved on by one."""
    rows = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label))


QUERIES: dict[str, Run] = {f.__name__: f for f in (op1_quality, op2_languages, op3_secrets, op4_token_files, op5_context_tree, op6_decontaminate, op7_shards, op8_pieces, op9_near_copies, op10_fingerprints, op11_sketch_dedup, op12_conversations, op13_hard_negatives)}
SQL: dict[str, str] = {"op6_decontaminate": op6_sql(), "op7_shards": op7_sql(), "op10_fingerprints": op10_sql()}
