"""Search queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from ..sources.tables import table
from .registry import query

_TOK = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> '')"
_HAS = "contains(' ' || array_to_string(ts, ' ') || ' ', ' {} ')"
WORDS = '"the and" that -idiot or license version'
_MATCH = f"(({_HAS.format('the and')} AND {_HAS.format('that')} AND NOT {_HAS.format('idiot')}) OR ({_HAS.format('license')} AND {_HAS.format('version')}))"
_D = f"WITH d AS (SELECT doc_id, {_TOK} AS ts FROM documents)"
_KW = f"kw AS (SELECT doc_id, s, CAST(row_number() OVER (ORDER BY s DESC, doc_id) AS INT) AS kw_rank FROM (SELECT doc_id, len(list_filter(ts, lambda t: t IN ('the', 'and', 'that', 'license', 'version'))) / CAST(len(ts) AS DOUBLE) AS s FROM d WHERE {_MATCH}) QUALIFY kw_rank <= 50)"
_COS = "list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_VEC = f"vec AS (SELECT v.vec_id AS doc_id, CAST(row_number() OVER (ORDER BY round(1 - {_COS}, 12), v.vec_id) AS INT) AS vec_rank FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 3) q QUALIFY vec_rank <= 50)"


def _seed(spark, d, vec_id: int):
    return S.seed_vector(table(spark, d, "embeddings"), "vec_id", vec_id)


@query(f"{_D} SELECT doc_id FROM d WHERE {_MATCH}")
def fts_match(spark, d):
    """FTS-02, FTS-05, FLT-07: words, phrases, exclusions and alternatives."""
    return table(spark, d, "documents").filter(S.WebQuery.parse(WORDS).matches(F.col("text"))).select("doc_id")


@query(f"{_D} SELECT doc_id FROM d WHERE len(list_filter(ts, lambda t: starts_with(t, 'licen'))) > 0")
def fts_prefix(spark, d):
    """FTS-03."""
    return table(spark, d, "documents").filter(F.exists(S.tokens(F.col("text")), lambda t: t.startswith("licen"))).select("doc_id")


@query(f"""{_D}, p AS (SELECT doc_id, unnest(ts) AS term FROM d) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY 1""")
def fts_index_stats(spark, d):
    """FTS-01, TRN-12: the inverted index's statistics; terms are counted inside a document first."""
    return S.index_stats(table(spark, d, "documents"), "text")


@query(f"""SELECT v.vec_id, round({_COS}, 6) AS sim FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 3) q WHERE v.label <> 0 ORDER BY round(1 - {_COS}, 12), v.vec_id LIMIT 20""")
def vec_topk(spark, d):
    """VEC-01, HYB-02: the filter applies below the top-K."""
    e = table(spark, d, "embeddings").filter("label <> 0")
    return S.vector_leg(e, "vec_id", "embedding", _seed(spark, d, 3), 20).select("vec_id", F.round(1 - F.col("vec_dist"), 6).alias("sim"))


@query(f"""SELECT q.vec_id AS seed, v.vec_id, round({_COS}, 6) AS sim FROM embeddings q JOIN embeddings v ON v.label = q.label AND v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 10) DESC, v.vec_id) <= 12""")
def similar_items(spark, d):
    """VEC-03, INV-S1: neighbours of the same kind, itself left out; seeds are the vectors whose id 20 divides."""
    near = S.neighbours(table(spark, d, "embeddings"), "vec_id", "embedding", "label", "vec_id % 20 = 0", 12)
    return near.select("seed", "vec_id", F.round("sim", 6).alias("sim"))


@query(f"""{_D}, {_KW}, {_VEC} SELECT coalesce(kw.doc_id, vec.doc_id) AS doc_id, kw_rank, vec_rank, round(coalesce(1.0 / (60 + kw_rank), 0) + coalesce(1.0 / (60 + vec_rank), 0), 8) AS score FROM kw FULL JOIN vec ON kw.doc_id = vec.doc_id ORDER BY coalesce(1.0 / (60 + kw_rank), 0) + coalesce(1.0 / (60 + vec_rank), 0) DESC, 1 LIMIT 30""")
def hybrid_rrf(spark, d):
    """HYB-01, JN-03: two cut legs, fused by rank."""
    kw = S.keyword_leg(table(spark, d, "documents"), "doc_id", "text", WORDS, 50)
    vec = S.vector_leg(table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", _seed(spark, d, 3), 50)
    return S.hybrid(kw, vec, "doc_id", 30).select("doc_id", "kw_rank", "vec_rank", F.round("score", 8).alias("score"))


@query("""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, '(?i)<a [^>]*href="[^"]+"')) AS n_links, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages""")
def page_facts(spark, d):
    """SRC-14, SRC-15, TXT-05."""
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_extract(h, "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.size(F.regexp_extract_all(h, F.lit('(?i)<a [^>]*href="[^"]+"'), F.lit(0))).cast("long").alias("n_links"), F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host"))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS body FROM pages""")
def page_text(spark, d):
    """TXT-01: visible text by expressions, without a UDF."""
    x = F.regexp_replace("html", "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"[ \t\n\r]+", " ")).alias("body"))


def excerpt_places(spark, d):
    """``item_id, doc_id, text, body, at`` of claimed excerpts that occur in a text, at their first place (from 1).

    An excerpt of five words or more meets the texts that hold its second to
    fourth word in a row (its outer words may be cut); a shorter one those that hold
    its first eight characters.  Only such pairs are compared, however many claims
    there are.
    """
    b, docs = table(spark, d, "benchmark"), table(spark, d, "documents").select("doc_id", F.col("text").alias("body"))
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")

    def runs(items, n: int, join):
        """Distinct runs of n neighbours; shifted copies are zipped, so no element is looked up by its place."""
        zipped = F.arrays_zip(*[F.slice(items, k + 1, F.greatest(F.size(items) - k, F.lit(0))).alias(f"c{k}") for k in range(n)])
        full = F.filter(zipped, lambda x: x[f"c{n - 1}"].isNotNull())
        return F.array_distinct(F.transform(full, lambda x: join(*[x[f"c{k}"] for k in range(n)])))

    b = b.withColumn("ws", words("text"))
    long = b.filter(F.size("ws") >= 5).withColumn("key", F.xxhash64(F.get("ws", F.lit(1)), F.get("ws", F.lit(2)), F.get("ws", F.lit(3)))).drop("ws")
    held = docs.select("doc_id", F.explode(runs(words("body"), 3, F.xxhash64)).alias("key")).join(long.select("key").distinct(), "key", "left_semi")
    found = held.join(long, "key").drop("key").join(docs, "doc_id")
    short = b.filter(F.size("ws") < 5).filter(F.length("text") > 0).drop("ws").withColumn("n", F.least(F.length("text"), F.lit(8)))
    for n in sorted(r.n for r in short.select("n").distinct().collect()):  # eight lengths at most
        some = short.filter(F.col("n") == n).drop("n").withColumn("key", F.left("text", F.lit(n)))
        parts = docs.select("doc_id", F.explode(runs(F.split("body", ""), n, F.concat)).alias("key"))
        held = parts.join(some.select("key").distinct(), "key", "left_semi")
        found = found.unionByName(held.join(some, "key").drop("key").join(docs, "doc_id"))
    return found.filter(F.contains("body", F.col("text"))).withColumn("at", F.instr("body", F.col("text")))


@query("""SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def evidence_excerpts(spark, d):
    """DQ-05: claimed excerpts that occur in a text."""
    return excerpt_places(spark, d).select("item_id", "doc_id")
