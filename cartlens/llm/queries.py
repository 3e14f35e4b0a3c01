"""Registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm import bpe, decontaminate, fingerprint, jaccard, language, pii, suffixes, toxicity, urls, windows
from cartlens.llm.frames import documents, held_out, table
from cartlens.llm.queries_alignment import op13_token_alignment
from cartlens.llm.queries_mixing import OP12_SQL, op12_source_mix
from cartlens.llm.queries_trie import OP11_SQL, op11_prefix_trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rank_file() -> str:
    """The public rank file every node has with the package public_tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes they decode to."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    both = bpe.encode(docs, rank_file(), split_pattern(), bytes_col="decoded")
    return both.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learnt from the rows that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", held_out(3, 1))
    model = language.train(docs.filter(~F.col("held_out")))
    found = language.identify(docs.select("doc_id", "text", "held_out"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "lang_mix")


def _span_list(spans):
    """`kind:start:end` by kind as listed, then start, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in pii.KINDS))
    keyed = F.transform(spans, lambda s: F.struct(F.array_position(kinds, s["kind"]).alias("k"), s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("kind")))
    return F.concat_ws(",", F.transform(F.sort_array(keyed), lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))))


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of plain identifiers, and the places of all found ones, disguised ones included."""
    found = pii.find(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("plain_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(kind) for kind in pii.KINDS),
        F.sha2(_span_list(F.col("plain_spans")), 256).alias("base_sha256"),
        _span_list(F.concat("plain_spans", "added_spans")).alias("spans"),
        F.size("added_spans").cast("long").alias("n_added"),
    )


#: Rules of the pages query, and hosts its list blocks where no rule fits.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
BLOCKED_HOSTS = ["casino-win.example.com", "free-bets.example.com", "cheap-pills.example.com", "ads-track.example.com"]


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page by the longest rule, else by the host list."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, URL_RULES, BLOCKED_HOSTS).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op5_url_filter"] = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT parts.page_id, host, path, rule, coalesce(v, CASE WHEN regexp_full_match(host,
  '(.*[.])?(casino-win|free-bets|cheap-pills|ads-track)[.]example[.]com') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits ON fits.page_id = parts.page_id AND k = 1
"""


@query
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every text and of its edited form, and what they share with each other and the next text."""
    return fingerprint.with_next(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left in every text once windows of 20 words that occur earlier are gone."""
    kept = windows.without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op3_substring_dedup"] = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM texts WHERE len(w) >= 20),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(list_slice(w, i, i + 19), ' ') ORDER BY doc_id, i) AS k FROM starts)
  WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM later, range(20) r(j)),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM texts),
kept AS (
  SELECT p.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p.i) AS t
  FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i WHERE g.i IS NULL GROUP BY 1)
SELECT t.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id
"""


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left in every text once strings of 400 bytes that occur elsewhere are gone."""
    kept = suffixes.without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document under links of similarity 0.75 over five-word shingles."""
    return jaccard.groups(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every benchmark item that it contains."""
    return decontaminate.find(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learnt from the labels of the rows that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", held_out(4, 2))
    model = toxicity.train(docs, docs.filter(~F.col("held_out")), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, restored_col=None)
    return scored.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


query(op11_prefix_trie)
ORACLES["op11_prefix_trie"] = OP11_SQL

query(op12_source_mix)
ORACLES["op12_source_mix"] = OP12_SQL

query(op13_token_alignment)
