"""Token, n-gram, vocabulary and weighting queries over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions import stemming
from docsieve.functions import text as tx
from docsieve.functions.stopwords import ENGLISH
from docsieve.operators import features as ft
from docsieve.operators.analyzer import Analyzer
from docsieve.operators.landmarks import choose_landmarks, kernel_values
from docsieve.plans import mapping as m
from docsieve.session import materialize, spread
from docsieve.sources.tables import read_table

WORDS = Analyzer()
# Fixed values of these queries: pruning bounds and vocabulary cap.
MIN_DF, MAX_DF, MAX_FEATURES = 0.01, 0.8, 5000
LANDMARKS, LANDMARK_SEED, GAMMA = 16, 5, 0.5


def _text(spark: SparkSession, folder: str) -> DataFrame:
    docs = m.documents(spark, folder).select("doc_id", "text")
    return spread(docs, "doc_id")


def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = tx.printable_ascii(F.col("text"))
    return _text(spark, folder).select("doc_id", cleaned.alias("clean"), F.length(cleaned).alias("n_clean"))


def nonascii_profile(spark: SparkSession, folder: str) -> DataFrame:
    docs = m.documents(spark, folder).select("lang", tx.has_non_ascii(F.col("text")).alias("flag"))
    return docs.groupBy("lang").agg(
        F.count_if("flag").alias("n_non_ascii"), F.count_if(~F.col("flag")).alias("n_ascii")
    )


def url_stripped(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with their URLs blanked; pages carry theirs in the markup."""
    pages = read_table(spark, folder, "pages").select(
        F.concat(F.lit("P-"), F.col("page_id")).alias("id"), F.concat_ws(" ", "url", "html").alias("text")
    )
    docs = _text(spark, folder).select(m.record_id().alias("id"), "text")
    return docs.unionByName(pages).select("id", tx.strip_urls(F.col("text")).alias("text"))


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    plain = WORDS.with_options(stop_words=None).tokens(_text(spark, folder))
    return plain.select("doc_id", F.posexplode(tx.filled(F.col("tokens"))).alias("pos", "token"))


def stopword_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return WORDS.tokens(_text(spark, folder)).select("doc_id", F.posexplode(tx.filled(F.col("tokens"))).alias("pos", "token"))


def ngrams_1_3(spark: SparkSession, folder: str) -> DataFrame:
    grams = WORDS.with_options(ngrams=(1, 3)).terms(_text(spark, folder))
    return ft.term_counts(grams, ["doc_id"]).withColumnRenamed("term", "ngram")


def stemmed_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Stems of all tokens, counted over the corpus."""
    stems = WORDS.with_options(stem="words").tokens(_text(spark, folder))
    return ft.document_frequency(stems, "tokens").withColumnRenamed("term", "stem")


def stemmed_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Words and word pairs with only the last word stemmed, counted over the corpus."""
    pairs = WORDS.with_options(ngrams=(1, 2), stem="last").terms(_text(spark, folder))
    return ft.document_frequency(pairs).withColumnRenamed("term", "ngram")


def doc_freq(spark: SparkSession, folder: str) -> DataFrame:
    docs = _text(spark, folder)
    return ft.prune(ft.document_frequency(WORDS.terms(docs)), docs.agg(F.count("*")).scalar(), MIN_DF, MAX_DF)


def doc_freq_by_class(spark: SparkSession, folder: str) -> DataFrame:
    """Documents per class a term occurs in."""
    counts = ft.term_counts(WORDS.terms(m.labelled_documents(spark, folder)), ["label"])
    return counts.groupBy("term").agg(
        F.count_if(F.col("label") == 0).alias("df_no"), F.count_if(F.col("label") == 1).alias("df_yes")
    )


def _vocabulary(spark: SparkSession, folder: str, **bounds: object) -> DataFrame:
    docs = _text(spark, folder)
    return ft.fit_vocabulary(WORDS.terms(docs), docs.count(), **bounds)


def vocabulary_pruned(spark: SparkSession, folder: str) -> DataFrame:
    return _vocabulary(spark, folder, min_df=MIN_DF, max_df=MAX_DF)


def vocabulary_max_features(spark: SparkSession, folder: str) -> DataFrame:
    return _vocabulary(spark, folder, min_df=2, max_df=0.95, max_features=MAX_FEATURES)


def vocabulary_slices(spark: SparkSession, folder: str) -> DataFrame:
    """First, middle and last ten terms with the vocabulary size."""
    vocabulary = _vocabulary(spark, folder, min_df=MIN_DF, max_df=MAX_DF)
    return ft.vocabulary_slices(vocabulary, 10)


def _features(spark: SparkSession, folder: str, weighting: str, scaler: str | None) -> DataFrame:
    spec = ft.FeatureSpec(MIN_DF, MAX_DF, None, weighting, scaler)
    return ft.long_features(WORDS.terms(_text(spark, folder)), "doc_id", spec)


def term_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder, "count", None)


def binary_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder, "binary", None)


def tfidf_l2(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder, "tfidf", None).withColumn("value", F.round("value", 6))


def landmark_kernel(spark: SparkSession, folder: str) -> DataFrame:
    """Sigmoid kernel of every document with the landmarks it shares a term with."""
    values = materialize(_features(spark, folder, "tfidf", None).select("doc_id", "term", "value"), "values")
    landmarks = choose_landmarks(values, "doc_id", LANDMARKS, LANDMARK_SEED)
    return kernel_values(values, landmarks, "doc_id", GAMMA).withColumn("value", F.round("value", 6))


def std_scaled(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder, "tfidf", "std").withColumn("value", F.round("value", 6))


def maxabs_scaled(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder, "count", "maxabs").withColumn("value", F.round("value", 6))


def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    labels = read_table(spark, folder, "labels").select(F.col("quality").alias("label"))
    return ft.class_weights(labels).withColumn("weight", F.round("weight", 6))


def word_count_hist(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents have how many words, in ranges of 50, with the extremes of each range."""
    sizes = WORDS.tokens(_text(spark, folder)).select(F.size("tokens").alias("n"))
    return ft.histogram(sizes, "n", 50)


def tfidf_hist(spark: SparkSession, folder: str) -> DataFrame:
    """How many tf-idf weights lie in which twentieth of the unit range."""
    values = _features(spark, folder, "tfidf", None).select(F.floor(F.round("value", 6) * 20).alias("bucket"))
    return values.groupBy("bucket").agg(F.count("*").alias("n_rows"))


QUERIES = {
    "clean_text": clean_text,
    "nonascii_profile": nonascii_profile,
    "url_stripped": url_stripped,
    "tokens": tokens,
    "stopword_filtered": stopword_filtered,
    "ngrams_1_3": ngrams_1_3,
    "stemmed_tokens": stemmed_tokens,
    "stemmed_ngrams": stemmed_ngrams,
    "doc_freq": doc_freq,
    "doc_freq_by_class": doc_freq_by_class,
    "vocabulary_pruned": vocabulary_pruned,
    "vocabulary_max_features": vocabulary_max_features,
    "vocabulary_slices": vocabulary_slices,
    "term_counts": term_counts,
    "binary_counts": binary_counts,
    "tfidf_l2": tfidf_l2,
    "landmark_kernel": landmark_kernel,
    "std_scaled": std_scaled,
    "maxabs_scaled": maxabs_scaled,
    "class_weights": class_weights,
    "word_count_hist": word_count_hist,
    "tfidf_hist": tfidf_hist,
}

_STOP_LIST = ", ".join(f"'{w}'" for w in ENGLISH)


def sql_tokens(table: str, keys: str) -> str:
    """CTEs raw_tok and tok: token lists before and after stop words."""
    return f"""
raw_tok AS (
  SELECT {keys}, regexp_extract_all(strip_accents(lower(text)), '(?i)\\b([a-z_]\\w+)\\b', 1) AS toks FROM {table}),
tok AS (SELECT {keys}, list_filter(toks, lambda t: t NOT IN ({_STOP_LIST})) AS toks FROM raw_tok)"""


def sql_counts(keys: str) -> str:
    """CTE cnt: term counts per document from tok."""
    return f"cnt AS (SELECT {keys}, term, count(*) AS tf FROM (SELECT {keys}, unnest(toks) AS term FROM tok) GROUP BY ALL)"


_DOCS = sql_tokens("documents", "doc_id")
_CNT = f"{_DOCS}, {sql_counts('doc_id')}"
_FREQ = f"{_CNT}, freq AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM cnt GROUP BY term)"
_N = "(SELECT count(*) FROM documents)"
_PRUNED = f"""{_FREQ},
kept AS (SELECT * FROM freq WHERE df >= {MIN_DF}::DOUBLE * {_N} AND df <= {MAX_DF}::DOUBLE * {_N}),
vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, df, total FROM kept)"""
_WEIGHTED = f"""{_PRUNED},
w AS (SELECT doc_id, v.term, v.idx, tf * (ln((1.0 + {_N}) / (1.0 + v.df)) + 1.0) AS value FROM cnt JOIN vocab v USING (term)),
u AS (SELECT doc_id, term, idx, value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)) AS value FROM w)"""
_POSITIONS = "SELECT doc_id, CAST(unnest(range(len(toks))) AS INTEGER) AS pos, unnest(toks) AS token FROM"
_REGION = "[^aeiouy]*[aeiouy]+[^aeiouy]"
_PREFIX = "gener|commun|arsen"


def _sql_cut(w: str, n: int) -> str:
    return f"left({w}, length({w}) - {n})"


def _sql_in(part: str, more: str) -> str:
    """Whether a word part holds R1 (more='') or R2, or R1 and something after it."""
    return (
        f"(CASE WHEN regexp_matches({part}, '^({_PREFIX})') THEN regexp_matches({part}, '^({_PREFIX}){more}') "
        f"ELSE regexp_matches({part}, '^{_REGION}{more}') END)"
    )


def _sql_suffixes(rules, more: str, in_r2=()) -> str:
    whens = []
    for suffix, new in rules:
        cut = _sql_cut("w", len(suffix))
        test = _sql_in(cut, _REGION if suffix in in_r2 else more)
        if suffix in stemming.BEFORE:
            test += f" AND regexp_matches({cut}, '{stemming.BEFORE[suffix]}')"
        whens.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {test} THEN {cut} || '{new}' ELSE w END")
    return "CASE " + " ".join(whens) + " ELSE w END"


def sql_stems() -> str:
    """CTEs up to stems(word, stem) for the words of CTE words(word)."""
    short = stemming.SHORT_SYLLABLE
    c1, c2 = _sql_cut("w", 1), _sql_cut("w", 2)

    def drop(suffix: str) -> str:
        cut = _sql_cut("w", len(suffix))
        return f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN regexp_matches({cut}, '[aeiouy]') THEN {cut} || '+' ELSE w END"

    def to_ee(suffix: str) -> str:
        cut = _sql_cut("w", len(suffix))
        return f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {_sql_in(cut, '')} THEN {cut} || 'ee' ELSE w END"

    steps = [
        "regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g')",
        f"""CASE WHEN ends_with(w, 'sses') THEN {c2}
            WHEN ends_with(w, 'ied') OR ends_with(w, 'ies') THEN CASE WHEN length(w) > 4 THEN {c2} ELSE {c1} END
            WHEN ends_with(w, 'us') OR ends_with(w, 'ss') THEN w
            WHEN regexp_matches(w, '[aeiouy].+s$') THEN {c1} ELSE w END""",
        f"CASE {to_ee('eedly')} {drop('ingly')} {drop('edly')} {to_ee('eed')} {drop('ing')} {drop('ed')} ELSE w END",
        f"""CASE WHEN NOT ends_with(w, '+') THEN w
            WHEN regexp_matches({c1}, '(at|bl|iz)$') THEN {c1} || 'e'
            WHEN regexp_matches({c1}, '{stemming.DOUBLED}') THEN {c2}
            WHEN regexp_matches({c1}, '{short}') AND NOT {_sql_in(c1, '.')} THEN {c1} || 'e' ELSE {c1} END""",
        f"CASE WHEN regexp_matches(w, '^.+[^aeiouy][yY]$') THEN {c1} || 'i' ELSE w END",
        _sql_suffixes(stemming.STEP_2, ""),
        _sql_suffixes(stemming.STEP_3, "", stemming.STEP_3_IN_R2),
        _sql_suffixes([(s, "") for s in stemming.STEP_4], _REGION),
        f"""CASE WHEN ends_with(w, 'e') THEN CASE WHEN {_sql_in(c1, _REGION)}
                 OR ({_sql_in(c1, '')} AND NOT regexp_matches({c1}, '{short}')) THEN {c1} ELSE w END
            WHEN ends_with(w, 'll') THEN CASE WHEN {_sql_in(c1, _REGION)} THEN {c1} ELSE w END ELSE w END""",
    ]
    ctes = ["s0 AS (SELECT word, word AS w FROM words)"]
    ctes += [f"s{i + 1} AS (SELECT word, {step} AS w FROM s{i})" for i, step in enumerate(steps)]
    finished = {f: w for w in stemming.FINISHED_AFTER_PLURALS for f in (w, w + "s")}
    fixed = " ".join(f"WHEN '{w}' THEN '{s}'" for w, s in {**stemming.WHOLE_WORDS, **finished}.items())
    final = f"CASE WHEN length(word) <= 2 THEN word ELSE CASE word {fixed} ELSE replace(w, 'Y', 'y') END END"
    ctes.append(f"stems AS (SELECT word, {final} AS stem FROM s{len(steps)})")
    return ", ".join(ctes)


SQL = {
    "clean_text": """
        SELECT doc_id, regexp_replace(text, '[^\\x20-\\x7E\\t\\n]', '', 'g') AS clean,
               CAST(length(regexp_replace(text, '[^\\x20-\\x7E\\t\\n]', '', 'g')) AS INTEGER) AS n_clean
        FROM documents""",
    "nonascii_profile": """
        SELECT lang, count(*) FILTER (regexp_matches(text, '[^\\x00-\\x7F]')) AS n_non_ascii,
               count(*) FILTER (NOT regexp_matches(text, '[^\\x00-\\x7F]')) AS n_ascii
        FROM documents GROUP BY lang""",
    "url_stripped": """
        SELECT 'D-' || doc_id AS id, regexp_replace(text, 'https?://\\S+', ' ', 'g') AS text FROM documents
        UNION ALL
        SELECT 'P-' || page_id, regexp_replace(url || ' ' || html, 'https?://\\S+', ' ', 'g') FROM pages""",
    "tokens": f"WITH {_DOCS} {_POSITIONS} raw_tok",
    "stopword_filtered": f"WITH {_DOCS} {_POSITIONS} tok",
    "ngrams_1_3": f"""
        WITH {_DOCS},
        grams AS (
          SELECT doc_id, unnest(toks) AS ngram FROM tok
          UNION ALL
          SELECT doc_id, unnest(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) FROM tok
          UNION ALL
          SELECT doc_id, unnest(list_transform(range(1, len(toks) - 1),
                                lambda i: toks[i] || ' ' || toks[i + 1] || ' ' || toks[i + 2])) FROM tok)
        SELECT doc_id, ngram, count(*) AS tf FROM grams GROUP BY doc_id, ngram""",
    "stemmed_tokens": f"""
        WITH {_DOCS}, occ AS (SELECT doc_id, unnest(toks) AS word FROM raw_tok),
        words AS (SELECT DISTINCT word FROM occ), {sql_stems()},
        cnt AS (SELECT doc_id, stem, count(*) AS tf FROM occ JOIN stems USING (word)
                WHERE stem NOT IN ({_STOP_LIST}) GROUP BY doc_id, stem)
        SELECT stem, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM cnt GROUP BY stem""",
    "stemmed_ngrams": f"""
        WITH {_DOCS}, pairs AS (
          SELECT doc_id, unnest(toks[:-2]) || ' ' AS head, unnest(toks[2:]) AS word FROM tok WHERE len(toks) > 1
          UNION ALL SELECT doc_id, '', unnest(toks) FROM tok),
        words AS (SELECT DISTINCT word FROM pairs), {sql_stems()},
        cnt AS (SELECT doc_id, head || stem AS ngram, count(*) AS tf FROM pairs JOIN stems USING (word) GROUP BY ALL)
        SELECT ngram, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM cnt GROUP BY ngram""",
    "doc_freq": f"WITH {_PRUNED} SELECT term, df, total FROM kept",
    "doc_freq_by_class": f"""
        WITH lab AS (SELECT d.doc_id, d.text, l.quality AS label FROM documents d JOIN labels l USING (doc_id)),
        {sql_tokens('lab', 'doc_id, label')}, {sql_counts('doc_id, label')}
        SELECT term, count(*) FILTER (label = 0) AS df_no, count(*) FILTER (label = 1) AS df_yes
        FROM cnt GROUP BY term""",
    "vocabulary_pruned": f"WITH {_PRUNED} SELECT term, idx, df, total FROM vocab",
    "vocabulary_max_features": f"""
        WITH {_FREQ}, capped AS (
          SELECT * FROM freq WHERE df >= 2 AND df <= 0.95::DOUBLE * {_N} ORDER BY total DESC, term LIMIT {MAX_FEATURES})
        SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, df, total FROM capped""",
    "vocabulary_slices": f"""
        WITH {_PRUNED}, sized AS (SELECT term, idx, (SELECT count(*) FROM vocab) AS n_terms FROM vocab)
        SELECT 'first' AS part, idx, term, n_terms FROM sized WHERE idx < 10
        UNION ALL SELECT 'middle', idx, term, n_terms FROM sized WHERE idx >= n_terms // 2 AND idx < n_terms // 2 + 10
        UNION ALL SELECT 'last', idx, term, n_terms FROM sized WHERE idx >= n_terms - 10""",
    "term_counts": f"WITH {_PRUNED} SELECT doc_id, idx, term, CAST(tf AS DOUBLE) AS value FROM cnt JOIN vocab USING (term)",
    "binary_counts": f"WITH {_PRUNED} SELECT doc_id, idx, term, 1.0::DOUBLE AS value FROM cnt JOIN vocab USING (term)",
    "tfidf_l2": f"WITH {_WEIGHTED} SELECT doc_id, idx, term, round(value, 6) AS value FROM u",
    "landmark_kernel": f"""
        WITH {_WEIGHTED},
        mark AS (
          SELECT doc_id AS m, row_number() OVER (ORDER BY doc_id) - 1 AS landmark FROM (
            SELECT DISTINCT doc_id FROM u ORDER BY md5('{LANDMARK_SEED}|' || doc_id), doc_id LIMIT {LANDMARKS}))
        SELECT x.doc_id, CAST(landmark AS INTEGER) AS landmark, round(tanh({GAMMA}::DOUBLE * sum(x.value * y.value)), 6) AS value
        FROM mark JOIN u y ON y.doc_id = m JOIN u x ON x.term = y.term GROUP BY x.doc_id, landmark""",
    "tfidf_hist": f"""
        WITH {_WEIGHTED}
        SELECT CAST(floor(round(value, 6) * 20) AS BIGINT) AS bucket, count(*) AS n_rows FROM u GROUP BY 1""",
    "std_scaled": f"""
        WITH {_WEIGHTED}, sd AS (
          SELECT term, sqrt(greatest(sum(value * value) / {_N} - (sum(value) / {_N}) * (sum(value) / {_N}), 0)) AS s
          FROM u GROUP BY term)
        SELECT doc_id, idx, u.term, round(value / CASE WHEN s > 1e-9 THEN s ELSE 1 END, 6) AS value
        FROM u JOIN sd ON sd.term = u.term""",
    "maxabs_scaled": f"""
        WITH {_PRUNED}, top AS (SELECT term, max(tf) AS m FROM cnt GROUP BY term)
        SELECT doc_id, idx, term, round(tf::DOUBLE / m, 6) AS value FROM cnt JOIN vocab USING (term) JOIN top USING (term)""",
    "class_weights": """
        SELECT quality AS label, count(*) AS n,
               round(CAST((SELECT count(*) FROM labels) AS DOUBLE) / (2 * count(*)), 6) AS weight
        FROM labels GROUP BY quality""",
    "word_count_hist": f"""
        WITH {_DOCS}, sizes AS (SELECT len(toks) AS n FROM tok)
        SELECT CAST(n // 50 * 50 AS BIGINT) AS low, count(*) AS n_rows, CAST(min(n) AS BIGINT) AS smallest,
               CAST(max(n) AS BIGINT) AS largest
        FROM sizes GROUP BY 1""",
}
