"""Registered queries over the test tables, each with SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import text as X
from tidemark.functions import validators as Q
from tidemark.functions import vectors as V
from tidemark.operators import ann, backfill, chunking, cleaning, embedding, hybrid, text_index, text_search, vector_search
from tidemark.plans import serving
from tidemark.sources import export, files
from tidemark.sources.store import document_rows, latest, merge_vectors, upsert
from tidemark.streaming import ingest

QUERY, PHRASE = "apache license version", "licensed under the apache license"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents")


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# SQL that several queries share.
TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
WORDS = "list_filter(regexp_split_to_array(text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda w: w <> '')"
STOPS = _list(X.STOP_WORDS)
POSTINGS = f"""tok AS (SELECT doc_id, {TOKENS} AS toks FROM documents WHERE text IS NOT NULL),
pos AS (SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM tok),
kept AS (SELECT * FROM pos WHERE NOT list_contains({STOPS}, term)),
dls AS (SELECT doc_id, len(list_filter(toks, lambda t: NOT list_contains({STOPS}, t))) AS dl FROM tok),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls),
post AS (SELECT term, doc_id, count(*) AS tf FROM kept GROUP BY term, doc_id),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
"""
IDF = "ln(1 + (n - df + 0.5) / (df + 0.5))"
WEIGHT = "tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"


def _or_sql(q: str) -> str:
    return f"""scored AS (SELECT p.doc_id, sum({IDF} * {WEIGHT}) AS score, count(*) AS n_terms FROM post p JOIN dfs USING (term) JOIN dls USING (doc_id) CROSS JOIN stats
WHERE list_contains({_list(text_search.query_terms(q))}, p.term) GROUP BY p.doc_id)"""


def _phrase_sql(phrase: str, name: str = "ph") -> str:
    tokens = text_search.query_tokens(phrase)
    first = tokens[0][0]
    joins = " ".join(f"JOIN kept k{j} ON k{j}.doc_id = k0.doc_id AND k{j}.term = '{t}' AND k{j}.pos = k0.pos + {i - first}" for j, (i, t) in enumerate(tokens) if j)
    return f"{name} AS (SELECT k0.doc_id, count(*) AS tf FROM kept k0 {joins} WHERE k0.term = '{tokens[0][1]}' GROUP BY k0.doc_id)"


def _postings(spark: SparkSession, sf: str) -> tuple[DataFrame, text_index.Stats]:
    index = serving.text(spark, sf)
    return index.postings, index.numbers


@query(f"SELECT doc_id, len(t)::INT AS n_tokens, len(list_filter(t, lambda x: NOT list_contains({STOPS}, x)))::INT AS n_terms, len(list_distinct(t))::INT AS n_distinct FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def tokenize_stats(spark, sf):
    t = docs(spark, sf).select("doc_id", X.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.filter("t", lambda w: ~X.is_stop(w))).alias("n_terms"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query(f"WITH {POSTINGS} x AS (SELECT 1) SELECT term, df FROM dfs ORDER BY df DESC, term LIMIT 50")
def term_df_top(spark, sf):
    return serving.text(spark, sf).terms.orderBy(F.desc("df"), "term").limit(50)


@query(f"WITH {POSTINGS} x AS (SELECT 1) SELECT n, round(avgdl, 4) AS avgdl FROM stats")
def corpus_stats(spark, sf):
    return text_index.corpus_stats(docs(spark, sf), "text").select("n", F.round("avgdl", 4).alias("avgdl"))


@query(f"WITH {POSTINGS} {_or_sql(QUERY)} SELECT doc_id::VARCHAR AS id, round(score, 4) AS score FROM scored ORDER BY round(score, 4) DESC, id LIMIT 10")
def bm25_or_top10(spark, sf):
    return text_search.top(text_search.or_scores(*_postings(spark, sf), QUERY).select("id", "score"), 10, 4)


@query(f"WITH {POSTINGS} {_or_sql(QUERY)} SELECT doc_id::VARCHAR AS id, round(score, 4) AS score FROM scored WHERE n_terms = 3 ORDER BY round(score, 4) DESC, id LIMIT 10")
def bm25_and_top10(spark, sf):
    return text_search.top(text_search.and_scores(*_postings(spark, sf), QUERY).select("id", "score"), 10, 4)


@query(f"WITH {POSTINGS} {_phrase_sql(PHRASE)} SELECT doc_id::VARCHAR AS id, tf::INT AS tf FROM ph")
def phrase_match(spark, sf):
    return text_search.phrase_matches(_postings(spark, sf)[0], PHRASE).select("id", "tf")


def _boosted_sql(q: str) -> str:
    n = len(text_search.query_terms(q))
    terms = [t for _, t in text_search.query_tokens(q)]
    return f"""{_or_sql(q)}, {_phrase_sql(q)}, pidf AS (SELECT sum({IDF} * len(list_filter({_list(terms)}, lambda t: t = term))) AS s FROM dfs CROSS JOIN stats WHERE list_contains({_list(terms)}, term)),
phs AS (SELECT ph.doc_id, s * {WEIGHT} AS score FROM ph JOIN dls USING (doc_id) CROSS JOIN stats CROSS JOIN pidf),
boosted AS (SELECT scored.doc_id, scored.score * CASE WHEN n_terms = {n} THEN 3 ELSE 1 END + 4 * coalesce(phs.score, 0) AS score FROM scored LEFT JOIN phs USING (doc_id))"""


@query(f"WITH {POSTINGS} {_boosted_sql(PHRASE)} SELECT doc_id::VARCHAR AS id, round(score, 4) AS score FROM boosted ORDER BY round(score, 4) DESC, id LIMIT 10")
def bm25_boosted(spark, sf):
    return text_search.top(text_search.boosted_scores(*_postings(spark, sf), PHRASE), 10, 4)


@query(f"WITH {POSTINGS} {_or_sql('license')} SELECT doc_id::VARCHAR AS id, round(score, 4) AS score FROM scored WHERE doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'apache')")
def bool_not(spark, sf):
    return text_search.search_query("license NOT apache", *_postings(spark, sf)).select("id", F.round("score", 4).alias("score"))


@query(f"""WITH {POSTINGS} {_or_sql('mit license')}, gnu AS (SELECT p.doc_id, {IDF} * {WEIGHT} AS score FROM post p JOIN dfs USING (term) JOIN dls USING (doc_id) CROSS JOIN stats WHERE term = 'gnu')
SELECT coalesce(a.doc_id, b.doc_id)::VARCHAR AS id, round(coalesce(a.score, 0) + 2 * coalesce(b.score, 0), 4) AS score
FROM (SELECT * FROM scored WHERE n_terms = 2) a FULL JOIN gnu b ON a.doc_id = b.doc_id""")
def query_grammar(spark, sf):
    return text_search.search_query("(mit AND license) OR gnu^2", *_postings(spark, sf)).select("id", F.round("score", 4).alias("score"))


@query("SELECT doc_id, source, lang FROM documents WHERE source = 'src7' AND lang = 'en'")
def keyword_filter(spark, sf):
    return docs(spark, sf).where((F.col("source") == "src7") & (F.col("lang") == "en")).select("doc_id", "source", "lang")


@query(f"WITH {POSTINGS} hits AS (SELECT DISTINCT doc_id FROM post WHERE term = 'license') SELECT '/' || lang AS facet, count(*) AS count FROM documents JOIN hits USING (doc_id) GROUP BY lang")
def facet_counts(spark, sf):
    index = serving.text(spark, sf)
    return text_search.facet_counts(index.stored, index.entries.where("term = 'license'"))


@query("SELECT lang, source, count(*) AS count FROM documents GROUP BY ROLLUP (lang, source)")
def facet_rollup(spark, sf):
    return docs(spark, sf).rollup("lang", "source").agg(F.count("*").alias("count"))


@query(f"""WITH {POSTINGS} q AS (SELECT DISTINCT item_id, unnest({TOKENS}) AS term FROM benchmark),
s AS (SELECT item_id, p.doc_id, round(sum({IDF} * {WEIGHT}), 3) AS score FROM q JOIN post p USING (term) JOIN dfs USING (term) JOIN dls USING (doc_id) CROSS JOIN stats GROUP BY item_id, p.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT item_id, doc_id, score, rank::INT AS rank FROM r WHERE rank <= 3""")
def batch_bm25_benchmark(spark, sf):
    p, s = _postings(spark, sf)
    q = read(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(X.terms("text"))).alias("term"))
    scored = text_search.batch_or_scores(p, s, q, "item_id").select("item_id", F.col("id").cast("long").alias("doc_id"), F.round("score", 3).alias("score"))
    return text_search.best_of_each(scored, "item_id", "doc_id", 3)


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
x AS (SELECT doc_id, w, unnest(CASE WHEN len(w) <= 375 THEN CASE WHEN len(w) > 0 THEN [0] ELSE []::BIGINT[] END ELSE range(0, (ceil((len(w) - 300) / 240.0)::BIGINT * 240) + 1, 240) END) AS s FROM w)
SELECT doc_id, (s // 240)::INT AS chunk_index, len(w[s + 1 : s + CASE WHEN len(w) <= 375 THEN 375 ELSE 300 END])::INT AS n_words, md5(array_to_string(w[s + 1 : s + CASE WHEN len(w) <= 375 THEN 375 ELSE 300 END], ' ')) AS content_md5 FROM x""")
def chunk_windows(spark, sf):
    w = docs(spark, sf).select("doc_id", X.whitespace_words("text").alias("w"))
    chunks = F.when(F.size("w") == 0, F.array().cast("array<string>")).when(F.size("w") <= 375, F.array(F.array_join("w", " "))).otherwise(chunking.windows(F.col("w")))
    rows = w.select("doc_id", F.posexplode(chunks).alias("chunk_index", "content"))
    return rows.select("doc_id", "chunk_index", X.word_count("content").alias("n_words"), F.md5("content").alias("content_md5"))


_PARAGRAPHS = f"""WITH p AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10))) AS p, generate_subscripts(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), 1) AS i FROM documents),
t AS (SELECT doc_id, i, trim(p, ' ') AS text FROM p WHERE trim(p, ' ') <> ''),
w AS (SELECT doc_id, i, text, {WORDS} AS w FROM t),
x AS (SELECT doc_id, i, text, w, unnest(CASE WHEN len(w) <= 375 THEN [0] ELSE range(0, (ceil((len(w) - 300) / 240.0)::BIGINT * 240) + 1, 240) END) AS s FROM w),
c AS (SELECT doc_id, i, s, CASE WHEN len(w) <= 375 THEN text ELSE array_to_string(w[s + 1 : s + 300], ' ') END AS content FROM x)
"""


def _paragraph_chunks(spark, sf):
    return chunking.chunk(docs(spark, sf).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))))


@query(_PARAGRAPHS + "SELECT doc_id || ':' || (row_number() OVER (PARTITION BY doc_id ORDER BY i, s) - 1) AS id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, s) - 1)::INT AS chunk_index, count(*) OVER (PARTITION BY doc_id)::INT AS total_chunks, md5(content) AS content_md5 FROM c")
def chunk_paragraphs(spark, sf):
    return _paragraph_chunks(spark, sf).select("id", "chunk_index", "total_chunks", F.md5("content").alias("content_md5"))


@query(_PARAGRAPHS + "SELECT count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, sum(length(content))::BIGINT AS n_chars FROM c")
def chunk_stats(spark, sf):
    # Documents are counted where their first chunk is: no distinct count.
    return _paragraph_chunks(spark, sf).agg(F.count("*").alias("n_chunks"), F.count_if(F.col("chunk_index") == 0).alias("n_docs"), F.sum(F.length("content")).alias("n_chars"))


@query()
def recursive_chunks(spark, sf):
    d = docs(spark, sf).select(F.col("doc_id").cast("string").alias("file_name"), F.col("text").alias("content"))
    return chunking.recursive_chunks(d).select("chunk_id", "chunk_index", "total_chunks", F.length("content").alias("n_chars"))


@query("""SELECT coalesce(nullif(lower(regexp_extract(list_last(string_split(regexp_replace(url, '[?#].*$', ''), '/')), '[^.]\\.([^.]+)$', 1)), ''), '-') AS ext, count(*) AS n FROM pages GROUP BY 1""")
def ext_distribution(spark, sf):
    path = F.regexp_replace("url", "[?#].*$", "")
    ext = X.extension(path)
    return files.ext_distribution(read(spark, sf, "pages").select(F.when(ext == "", "-").otherwise(ext).alias("ext")))


@query("SELECT doc_id, md5(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS clean_md5 FROM documents")
def clean_ascii(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.drop_non_ascii("text")).alias("clean_md5"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS clean_md5 FROM documents")
def clean_whitespace(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.collapse_blanks("text")).alias("clean_md5"))


@query("SELECT doc_id, length(text) > 100 AND length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) / length(text) > 0.1 AS aggressive FROM documents")
def needs_aggressive(spark, sf):
    return docs(spark, sf).select("doc_id", X.needs_aggressive("text").alias("aggressive"))


@query("""SELECT doc_id, len(k)::INT AS n_kept, md5(array_to_string(k, chr(10))) AS kept_md5 FROM (SELECT doc_id, list_filter(string_split(text, chr(10)),
lambda l: length(trim(l, ' ')) >= 10 AND length(regexp_replace(l, '[^\\p{L}\\p{N}]', '', 'g')) / length(trim(l, ' ')) >= 0.3) AS k FROM documents)""")
def line_filter(spark, sf):
    k = cleaning.kept_lines("text", cleaning.Cleaning(normalize_whitespace=False))
    return docs(spark, sf).select("doc_id", F.size(k).alias("n_kept"), F.md5(F.array_join(k, "\n")).alias("kept_md5"))


@query("SELECT page_id, md5(regexp_replace(regexp_replace(html, '&[a-zA-Z0-9#]+;', '', 'g'), '\\s+', ' ', 'g')) AS clean_md5 FROM pages")
def html_artifacts(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.md5(X.html_artifacts("html")).alias("clean_md5"))


@query()
def html_extract(spark, sf):
    pages = read(spark, sf, "pages").select(F.col("url").alias("path"), F.octet_length("html").cast("long").alias("length"), F.lit("html").alias("ext"), F.encode("html", "UTF-8").alias("content"))
    return files.extract(pages).select(F.col("metadata.file_path").alias("url"), F.size("metadata.elements").alias("n_elements"), F.length("content").alias("n_chars"))


@query()
def clean_text_full(spark, sf):
    cleaned = docs(spark, sf).select("doc_id", cleaning.clean_text("text", F.lit("txt")).alias("text"))
    return cleaned.select("doc_id", F.length("text").alias("n_chars"), F.size(F.split("text", "\n\n")).alias("n_paragraphs"))


@query("""SELECT doc_id, NOT regexp_matches(text, ' {3,}|\\n{3,}|\\t') AS whitespace_normalized, NOT regexp_matches(text, '\\w+-\\s*\\n\\s*\\w+') AS hyphenation_fixed,
NOT regexp_matches(text, '[‘’“”]') AS quotes_normalized, NOT regexp_matches(text, '[–—]') AS dashes_normalized, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 50 AS min_length,
len(list_filter(string_split(text, chr(10)), lambda l: trim(l, ' ') = '')) <= len(string_split(text, chr(10))) * CASE WHEN len(string_split(text, chr(10))) < 10 THEN 0.4 ELSE 0.2 END AS empty_lines FROM documents""")
def quality_report(spark, sf):
    found = Q.checks("text", F.lit("txt"))
    names = ("whitespace_normalized", "hyphenation_fixed", "quotes_normalized", "dashes_normalized", "min_length", "empty_lines")
    return docs(spark, sf).select("doc_id", *(found[n].alias(n) for n in names))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark, sf):
    return docs(spark, sf).groupBy(X.content_hash("text").alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


_MD5_EMBED = f"""e AS (SELECT doc_id, (('0x' || substr(md5(unnest(w)), 1, 6))::BIGINT % 16) AS cell FROM (SELECT doc_id, {WORDS.replace('text', 'lower(text)')} AS w FROM documents)),
c AS (SELECT doc_id, cell, count(*)::DOUBLE AS v FROM e GROUP BY doc_id, cell), nrm AS (SELECT doc_id, greatest(sqrt(sum(v * v)), 1e-6) AS nrm FROM c GROUP BY doc_id)"""


@query(f"WITH {_MD5_EMBED} SELECT d.doc_id, i::INT AS cell, round(coalesce(v, 0) / coalesce(nrm, 1), 5) AS v FROM documents d CROSS JOIN range(16) r(i) LEFT JOIN c ON c.doc_id = d.doc_id AND c.cell = i LEFT JOIN nrm ON nrm.doc_id = d.doc_id")
def hash_embed_md5(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(embedding.md5_embedding("text")).alias("cell", "v")).withColumn("v", F.round("v", 5))


@query()
def hash_embed_xx(spark, sf):
    e = docs(spark, sf).select("doc_id", embedding.embed_column(embedding.HashingEmbedder(64), F.col("text")).alias("e"))
    return e.select("doc_id", F.size("e.vector").alias("dim"), F.round(V.norm("e.vector"), 4).alias("norm"))


def _emb(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


_Q0 = "(SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1)"


def _query_vector(spark, sf) -> list[float]:
    return list(_emb(spark, sf).orderBy("id").first()["vector"])


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS norm FROM embeddings")
def vector_norms(spark, sf):
    return _emb(spark, sf).select(F.col("id").alias("vec_id"), F.round(V.norm("vector"), 5).alias("norm"))


def _knn_sql(score: str, where: str = "") -> str:
    return f"SELECT vec_id AS id, round({score}, 5) AS score FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v, q FROM embeddings CROSS JOIN {_Q0}) {where} ORDER BY round({score}, 5) DESC, id LIMIT 10"


@query(_knn_sql("1 - list_sum(list_transform(list_zip(v, q), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"))
def knn_l2(spark, sf):
    return vector_search.flat_search(_emb(spark, sf), _query_vector(spark, sf), 10, "l2", digits=5)


@query(_knn_sql("list_cosine_similarity(v, q)"))
def knn_cosine(spark, sf):
    return vector_search.flat_search(_emb(spark, sf), _query_vector(spark, sf), 10, "cosine", digits=5)


@query(_knn_sql("list_dot_product(v, q)"))
def knn_dot(spark, sf):
    return vector_search.flat_search(_emb(spark, sf), _query_vector(spark, sf), 10, "dot", digits=5)


@query(_knn_sql("list_cosine_similarity(v, q)", "WHERE label = 3"))
def knn_label_filter(spark, sf):
    return vector_search.flat_search(_emb(spark, sf).where("label = 3"), _query_vector(spark, sf), 10, "cosine", digits=5)


@query("""WITH q AS (SELECT label AS query_id, min(vec_id) AS v FROM embeddings GROUP BY label), s AS (SELECT query_id, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], qe.embedding::DOUBLE[]), 6) AS score
FROM q JOIN embeddings qe ON qe.vec_id = q.v CROSS JOIN embeddings e), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, score, rank::INT AS rank FROM r WHERE rank <= 5""")
def knn_batch(spark, sf):
    e = _emb(spark, sf)
    q = e.groupBy(F.col("label").alias("query_id")).agg(F.min_by("vector", "id").alias("query"))
    return vector_search.batch_search(e, q, 5)


@query()
def ivf_knn(spark, sf):
    return serving.ivf(spark, sf, 16).search(_query_vector(spark, sf), 10, nprobe=14)


@query("SELECT count(*) AS n_queries, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
def ivf_batch_recall(spark, sf):
    """Whether a search of many queries at once, 14 of 16 cells each, finds 0.9 of what the exact one does."""
    e = _emb(spark, sf)
    q = e.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    exact = vector_search.batch_search(e, q, 10).select("query_id", "id")
    found = serving.ivf(spark, sf, 16).batch_search(q, 10, nprobe=14).select("query_id", "id", F.lit(1).alias("hit"))
    met = exact.join(found, ["query_id", "id"], "left")
    return met.agg(F.countDistinct("query_id").alias("n_queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("reached"))


@query()
def ivf_recall(spark, sf):
    """Recall@10 against the exact search, by number of probed cells of 16."""
    found = ann.recalls(serving.ivf(spark, sf, 16), (1, 8, 16), sample=10)
    return spark.createDataFrame([(n, round(r, 4)) for n, r in found], "nprobe int, recall double")


@query("SELECT n, CASE WHEN n <= 1 THEN 1 ELSE least(least(greatest(2048, 2 * floor(sqrt(n))::BIGINT), 65536), n - 1) END::BIGINT AS nlist, 16 AS m FROM (SELECT unnest([0, 1, 2, 32, 300, 2048, 2049, 2050, 1000000, 4000000, 25000000, 2000000000])::BIGINT AS n)")
def ivf_params(spark, sf):
    rows = [(n, ann.ivf_params(n, 64).nlist, ann.ivf_params(n, 64).m) for n in (0, 1, 2, 32, 300, 2048, 2049, 2050, 1_000_000, 4_000_000, 25_000_000, 2_000_000_000)]
    return spark.createDataFrame(rows, "n long, nlist long, m int")


_NEAR = f"""{_MD5_EMBED}, qv AS (SELECT unnest([@QV@]) AS q, generate_subscripts([@QV@], 1) - 1 AS cell),
near AS (SELECT d.doc_id::VARCHAR AS id, any_value(d.text) AS text, round(1 - sum((coalesce(v / nrm, 0) - q) * (coalesce(v / nrm, 0) - q)), 5) AS score FROM documents d CROSS JOIN qv LEFT JOIN c ON c.doc_id = d.doc_id AND c.cell = qv.cell LEFT JOIN nrm ON nrm.doc_id = d.doc_id GROUP BY d.doc_id)"""


def _md5_query(text: str) -> list[float]:
    import hashlib

    cells = [0.0] * 16
    for w in text.lower().split():
        cells[int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % 16] += 1
    n = max(sum(c * c for c in cells) ** 0.5, 1e-6)
    return [c / n for c in cells]


_QV = ", ".join(f"{x!r}::DOUBLE" for x in _md5_query(QUERY))
NEAR = _NEAR.replace("@QV@", _QV)


@query(f"""WITH {NEAR}, cand AS (SELECT * FROM near ORDER BY score DESC, id LIMIT 100)
SELECT id, round(0.7 * score + 0.3 * ({" + ".join(f"contains(lower(text), '{w}')::INT" for w in QUERY.split())}) / 3, 4) AS score FROM cand ORDER BY 2 DESC, id LIMIT 10""")
def rerank_lexical(spark, sf):
    near = vector_search.flat_search(serving.doc_vectors(spark, sf), _md5_query(QUERY), 100, "l2", digits=5)
    return vector_search.lexical_rerank(text_search.fetch(serving.text(spark, sf).stored, near), QUERY, 10, digits=4).select("id", "score")


_BOTH = f"""WITH {POSTINGS} {_or_sql(QUERY)}, {NEAR}, tx AS (SELECT doc_id::VARCHAR AS id, round(score, 4) AS score FROM scored ORDER BY round(score, 4) DESC, id LIMIT 10), vx AS (SELECT id, score FROM near ORDER BY score DESC, id LIMIT 10)"""


def _lists(spark, sf):
    near = vector_search.flat_search(serving.doc_vectors(spark, sf), _md5_query(QUERY), 10, "l2", digits=5)
    return near, bm25_or_top10(spark, sf)


@query(_BOTH + """, u AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, source DESC) AS rn FROM (SELECT *, 'vector' AS source FROM vx UNION ALL SELECT *, 'text' AS source FROM tx))
SELECT id, score, source FROM u WHERE rn = 1 ORDER BY score DESC, id LIMIT 10""")
def hybrid_max(spark, sf):
    return hybrid.fuse(*_lists(spark, sf), 10, "max")


@query(_BOTH + """, u AS (SELECT id, source, 1 / (60 + row_number() OVER (PARTITION BY source ORDER BY score DESC, id)) AS part FROM (SELECT *, 'vector' AS source FROM vx UNION ALL SELECT *, 'text' AS source FROM tx))
SELECT id, round(sum(part), 6) AS score, CASE WHEN count(*) > 1 THEN 'both' ELSE max(source) END AS source FROM u GROUP BY id ORDER BY sum(part) DESC, id LIMIT 10""")
def hybrid_rrf(spark, sf):
    return hybrid.fuse(*_lists(spark, sf), 10, "rrf").withColumn("score", F.round("score", 6))


def _cached(spark, sf):
    return docs(spark, sf).join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select(X.content_hash("text").alias("content_hash"))


@query("SELECT doc_id FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))")
def cache_hits(spark, sf):
    return docs(spark, sf).select("doc_id", X.content_hash("text").alias("content_hash")).join(_cached(spark, sf), "content_hash", "left_semi").select("doc_id")


@query("SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))")
def cache_misses(spark, sf):
    return docs(spark, sf).select("doc_id", X.content_hash("text").alias("content_hash")).join(_cached(spark, sf), "content_hash", "left_anti").select("doc_id")


def _versions(spark, sf):
    e = _emb(spark, sf).select("id", F.col("label").alias("version"), "vector")
    return e.unionByName(e.select("id", (F.col("version") + 10).alias("version"), F.reverse("vector").alias("vector")))


@query("SELECT vec_id AS id, label + 10 AS version, round(list_last(embedding)::DOUBLE, 5) AS head FROM embeddings")
def latest_embedding(spark, sf):
    return latest(_versions(spark, sf), ["id"], "version").select("id", "version", F.round(F.get("vector", F.lit(0)).cast("double"), 5).alias("head"))


@query("SELECT d.doc_id::VARCHAR AS id, round(e.embedding[1]::DOUBLE, 5) AS head FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def merge_serving(spark, sf):
    d = docs(spark, sf).select(F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("array<float>").alias("vector"))
    e = _emb(spark, sf).select(F.col("id").cast("string").alias("id"), "vector", F.lit(dt.datetime(2024, 1, 1)).alias("embedded_at"))
    return merge_vectors(d, e).select("id", F.round(F.get("vector", F.lit(0)).cast("double"), 5).alias("head"))


@query("SELECT * FROM (VALUES ('active', 'idx-2'), ('dim', '64'), ('model', 'fake')) t(key, value)")
def meta_upsert(spark, sf):
    day = lambda n: dt.datetime(2024, 1, n)
    old = spark.createDataFrame([("active", "idx-1", day(1)), ("dim", "64", day(1))], schemas.META)
    new = spark.createDataFrame([("active", "idx-2", day(2)), ("model", "fake", day(2))], schemas.META)
    return upsert(old, new, ["key"], "updated_at").select("key", "value")


@query("SELECT CASE WHEN doc_id IN (SELECT vec_id FROM embeddings) THEN 'ready' ELSE 'new' END AS status, count(*) AS n FROM documents GROUP BY 1")
def backfill_status(spark, sf):
    d = docs(spark, sf).select(F.col("doc_id").cast("string").alias("id"))
    e = _emb(spark, sf).select(F.col("id").cast("string").alias("id"), F.lit("e").alias("embedder_id"))
    return backfill.derived_status(d, e, "e").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT d.doc_id || ':0' AS id, sha256(text) AS content_hash, 'new' AS embedding_status, 0 AS embedding_version, 'stale' AS index_status FROM documents d")
def document_status_rows(spark, sf):
    d = docs(spark, sf).withColumn("doc_id", F.col("doc_id").cast("string"))
    chunks = d.select(F.concat("doc_id", F.lit(":0")).alias("id"), "doc_id", F.col("doc_id").alias("doc_path"), F.lit("/misc").alias("category"), F.lit("/misc").alias("category_text"), F.col("text").alias("content"), F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"))
    return document_rows(chunks).select("id", "content_hash", "embedding_status", "embedding_version", "index_status")


@query("SELECT doc_id || '_0' AS id, text AS content, doc_id::VARCHAR AS file_name, '' AS file_path, 0 AS chunk_index, 1 AS total_chunks, 0 AS token_count FROM documents")
def chunk_export_json(spark, sf):
    d = docs(spark, sf).select(F.concat_ws("_", "doc_id", F.lit(0)).alias("chunk_id"), F.col("text").alias("content"), F.struct(F.col("doc_id").cast("string").alias("file_name")).alias("metadata"))
    return export.text_export(d)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf):
    return ingest.windowed_counts(read(spark, sf, "events")).withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT min(ts) AS session_start, user_id, count(*) AS n FROM s GROUP BY user_id, sid""")
def stream_sessions(spark, sf):
    return ingest.session_counts(read(spark, sf, "events"))


@query()
def snippet_top5(spark, sf):
    return text_search.search(serving.text(spark, sf), QUERY, 5).select("id", F.round("score", 4).alias("score"), "snippet")


# Relational operations beyond the search engine.


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ALL""")
def ext_pricing_summary(spark, sf):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return read(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def ext_nation_revenue(spark, sf):
    line, orders, customer, nation = (read(spark, sf, t) for t in ("lineitem", "orders", "customer", "nation"))
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def ext_customers_without_orders(spark, sf):
    return read(spark, sf, "customer").join(read(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT * FROM (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INT AS rank FROM part) WHERE rank <= 3")
def ext_top_parts_per_brand(spark, sf):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return read(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice", F.row_number().over(w).alias("rank")).where("rank <= 3")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def ext_order_cube(spark, sf):
    return read(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


from tidemark.plans import part_queries  # noqa: E402, F401  registers the queries of single functions and tables


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
