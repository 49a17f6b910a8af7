"""Registered queries: one per operator key, each ``(spark, sf_dir) -> DataFrame``,
plus the matching DuckDB SQL where the result is SQL-checkable.

Every query reads the given parquet tables (or data Spark derives from
them) in full. Doubles that are value-compared are rounded to 6 places.
"""

from __future__ import annotations

import uuid
import zlib
from typing import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkvox.functions import lexicon as L
from sparkvox.functions.vectors import round6
from sparkvox.operators import normalize as N
from sparkvox.operators import tagger as TG
from sparkvox.operators import tokens as TK
from sparkvox.functions import vectors as V
from sparkvox.operators import charts as CH
from sparkvox.operators import columns as COL
from sparkvox.operators import hierarchy as HI
from sparkvox.sources import corpus_io as IO
from sparkvox.operators import docmap as DM
from sparkvox.operators import network as NW
from sparkvox.operators import segment as SG
from sparkvox.operators import similarity as SI
from sparkvox.operators import spans as SP
from sparkvox.operators import sparse as SR
from sparkvox.operators.numbering import join_by_position
from sparkvox.operators import vectors as VC
from sparkvox.session import bucketed, buckets_of, drop_folder, scratch_path
from sparkvox.streaming import monitor as MON
from sparkvox.operators import wordstats as WS
from sparkvox.plans import oracle as O

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return deco


# ---------------------------------------------------------------------------
# Shared inputs (lazy; each query builds its own plan)
# ---------------------------------------------------------------------------

def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def clean_docs(spark: SparkSession, d: str) -> DataFrame:
    """documents → (doc_id, lang, text) with the default cleaning, whole texts."""
    return N.normalize_text(table(spark, d, "documents").select("doc_id", "lang", "text"))


# Tables that many queries read (the word table, document frequencies, the table
# of labels, layouts) are written once per application and state of the corpus.
_SHARED: dict[tuple, str] = {}

# Bytes of text per bucket of the word table (some thirty times that as sorted
# words in a task's memory), and the most buckets that Spark takes.
BUCKET_BYTES, MAX_BUCKETS = 4 << 20, 100_000


def corpus_files(spark: SparkSession, d: str) -> dict[str, tuple[int, int]]:
    """Length and time of change of every file of a corpus."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(d)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    out = {}
    while files.hasNext():
        f = files.next()
        out[f.getPath().toString()] = (f.getLen(), f.getModificationTime())
    return out


def shared(spark: SparkSession, d: str, name: str, write: Callable[[], str]) -> str:
    """What ``write`` returned (a path or a table's name) when this table of the
    corpus was first asked for; written anew when the corpus' files have changed."""
    key = (spark.sparkContext.applicationId, d, name, tuple(sorted(corpus_files(spark, d).items())))
    if key not in _SHARED:
        _SHARED[key] = write()
    return _SHARED[key]


def shared_table(spark: SparkSession, d: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    def write() -> str:
        path = scratch_path(spark, name)
        build().write.parquet(path)
        return path

    return spark.read.parquet(shared(spark, d, name, write))


def n_buckets(spark: SparkSession, d: str) -> int:
    """Buckets by the bytes of the documents' texts, whatever their files'
    compression, at least one per core."""
    size = table(spark, d, "documents").select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return min(max(spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES)), MAX_BUCKETS)


def words_table(spark: SparkSession, d: str) -> str:
    """The word table, as a table bucketed by doc_id under the shared
    checkpoint folder. Reads keep the doc_id co-location (no exchange for
    per-document work), prune columns, cut lineage, and survive executor
    loss. ``release`` drops it."""
    def write() -> str:
        n = n_buckets(spark, d)
        name = f"sparkvox_words_{uuid.uuid4().hex[:12]}"
        bucketed(TK.tokenize_docs(TK.by_document(clean_docs(spark, d), n_partitions=n)), n, "doc_id", name, scratch_path(spark, "words"))
        return name

    return shared(spark, d, "words", write)


def words(spark: SparkSession, d: str) -> DataFrame:
    return spark.table(words_table(spark, d))


def release(spark: SparkSession, d: str, name: str | None = None) -> None:
    """Forget the shared tables of a corpus, or the one of a name; the next
    query builds them anew."""
    for key in [k for k in _SHARED if k[:2] == (spark.sparkContext.applicationId, d) and name in (None, k[2])]:
        at = _SHARED.pop(key)
        if key[2] == "words":
            spark.sql(f"DROP TABLE IF EXISTS {at}")
        else:
            drop_folder(spark, at)


def padded(spark: SparkSession, d: str) -> DataFrame:
    return WS.pad_empty_sentences(words(spark, d))


def dfreq(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary with its document frequencies, counted once."""
    return shared_table(spark, d, "dfreq", lambda: WS.doc_frequency(padded(spark, d), table(spark, d, "documents")))


N_WORDS_WIDE = 20
N_WORDS_TOP = 300
N_COLUMNS = 200
N_TOP_PER_LABEL = 20

# ---------------------------------------------------------------------------
# B. normalisation
# ---------------------------------------------------------------------------


@register("normalize_text", O.with_(O.cte_docs()) + "SELECT doc_id, text FROM docs")
def q_normalize_text(spark, d):
    return clean_docs(spark, d).select("doc_id", "text")


@register("normalize_custom", "SELECT doc_id, lower(text) AS text FROM documents")
def q_normalize_custom(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return N.normalize_text(docs, custom=F.lower)


# ---------------------------------------------------------------------------
# D. tokens
# ---------------------------------------------------------------------------

WORD_COLS = "doc_id, sent_id, word_id, text, lemma, is_stop, pos, dep, ent_type"


@register("tokenize_docs", O.with_(*O.words_base()) + f"SELECT {WORD_COLS} FROM words")
def q_tokenize_docs(spark, d):
    return words(spark, d).select(*WORD_COLS.split(", "))


# The corpus has no texts of scripts without spaces, so those of two languages are
# respelled: a syllable sign per letter, and for unspaced texts no spaces.
RESPELLED = ("es", "fr")
LETTERS, SIGNS = "abcdefghijklmnopqrstuvwxyzçèéêíñó", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむ"
PIECE_LENGTH, UNKNOWN_COST = 12, 50_000_000


def respelled(spark: SparkSession, d: str, spaces: bool) -> DataFrame:
    signs = F.translate(F.lower("text"), LETTERS, SIGNS)
    return clean_docs(spark, d).withColumn("text", F.when(
        F.col("lang").isin(*RESPELLED), signs if spaces else F.translate(signs, " ", "")).otherwise(F.col("text")))


def known_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Words of the spaced spelling and their cost: a fixed vocabulary."""
    counts = (TK.tokenize_docs(respelled(spark, d, True).where(F.col("lang").isin(*RESPELLED)))
              .where((F.length("text") <= PIECE_LENGTH) & F.col("text").rlike(f"^{L.UNSPACED_JAVA}+$"))
              .groupBy(F.col("text").alias("piece")).agg(F.count("*").alias("n"))
              .orderBy((F.col("n") * F.length("piece")).desc(), "piece").limit(SG.MAX_PIECES))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("piece", F.round(SG.UNIT * F.log(total / F.col("n"))).cast("long").alias("cost"))


_RESPELLED_SQL = f"lang IN {O.in_list(RESPELLED)}"
_SIGNS_SQL = f"translate(lower(text), '{LETTERS}', '{SIGNS}')"


@register(
    "tokenize_unspaced",
    f"""WITH RECURSIVE {O.cte_docs()},
spoken AS (SELECT unnest(regexp_extract_all({_SIGNS_SQL}, {O.q('(' + L.WORD_PATTERN + ')')}, 1)) AS piece FROM docs WHERE {_RESPELLED_SQL}),
counted AS (
  SELECT piece, count(*) AS n FROM spoken
  WHERE length(piece) <= {PIECE_LENGTH} AND regexp_matches(piece, '^{L.UNSPACED_DUCK}+$')
  GROUP BY piece ORDER BY n * length(piece) DESC, piece LIMIT {SG.MAX_PIECES}),
pieces AS MATERIALIZED (SELECT piece, CAST(round({SG.UNIT} * ln((SELECT sum(n) FROM counted) / n)) AS BIGINT) AS cost FROM counted),
given AS (SELECT doc_id, lang, CASE WHEN {_RESPELLED_SQL} THEN replace({_SIGNS_SQL}, ' ', '') ELSE text END AS text FROM docs),
{O.cte_words("given")},
cut AS MATERIALIZED (
  SELECT w.doc_id, w.sent_id, w.word_id, w.lang, p.o, p.part
  FROM words w, unnest(regexp_extract_all(w.text, '({L.UNSPACED_DUCK}+|{L.UNSPACED_DUCK.replace("[", "[^")}+)', 1)) WITH ORDINALITY AS p(part, o)),
unspaced AS (SELECT part AS run FROM cut WHERE regexp_matches(part, '^{L.UNSPACED_DUCK}')),
{O.cte_segments("unspaced", "pieces", PIECE_LENGTH, UNKNOWN_COST)},
formed AS (
  SELECT doc_id, sent_id, lang, CAST(row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY word_id, o, coalesce(k, 0)) - 1 AS INTEGER) AS word_id,
    coalesce(word, part) AS text
  FROM cut LEFT JOIN segs ON segs.run = cut.part)
SELECT doc_id, sent_id, word_id, text, lower(text) AS lemma, coalesce(lex.pos, {O.pos_case('lower(text)')}) AS pos
FROM formed LEFT JOIN lex ON lex.k = lang || '|' || lower(text)""",
)
def q_tokenize_unspaced(spark, d):
    """Spaced and unspaced texts through one tokeniser, with a known vocabulary."""
    segmenter = SG.Segmenter.of(known_pieces(spark, d), UNKNOWN_COST)
    docs = TK.by_document(respelled(spark, d, False))
    return TK.tokenize_docs(docs, segmenter=segmenter).select("doc_id", "sent_id", "word_id", "text", "lemma", "pos")


def _spans(words: DataFrame) -> DataFrame:
    """Each word's place among the letters of its sentence."""
    before = Window.partitionBy("doc_id", "sent_id").orderBy("word_id").rowsBetween(Window.unboundedPreceding, -1)
    return words.select("doc_id", "sent_id", "lang", "text", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).alias("at"))


@register("segment_learned")
def q_segment_learned(spark, d):
    """A vocabulary learned from the unspaced texts alone: per language, words of
    the spaced spelling, words found, and words found at their very place."""
    unspaced = respelled(spark, d, False).where(F.col("lang").isin(*RESPELLED))
    segmenter = SG.learn(SG.runs(unspaced))
    found = _spans(TK.tokenize_docs(TK.by_document(unspaced), segmenter=segmenter))
    true = _spans(TK.tokenize_docs(TK.by_document(respelled(spark, d, True).where(F.col("lang").isin(*RESPELLED)))))
    both = true.withColumn("t", F.lit(1)).join(
        found.withColumn("f", F.lit(1)), ["doc_id", "sent_id", "lang", "at", "text"], "full")
    return both.groupBy("lang").agg(F.count("t").alias("n_words"), F.count("f").alias("n_found"),
                                    F.count(F.col("t") + F.col("f")).alias("n_right"))


@register("tag_words")
def q_tag_words(spark, d):
    """Tags of whole sentences from a model that knows half of the lexicon: per
    language the words, those of the other half, and how many of them have the
    lexicon's tag."""
    known = {k: v for k, v in L.lexicon_items() if zlib.crc32(k.encode()) % 2 == 0}
    tagger = TG.learn(words(spark, d), lexicon=known)
    tagged = TK.tokenize_docs(TK.by_document(clean_docs(spark, d)), tagger=tagger)
    hidden = spark.createDataFrame([(k, v) for k, v in L.lexicon_items() if k not in known], "key string, tag string")
    both = tagged.withColumn("key", F.concat("lang", F.lit("|"), "lemma")).join(F.broadcast(hidden), "key", "left")
    return both.groupBy("lang").agg(F.count("*").alias("n_words"), F.count("tag").alias("n_hidden"),
                                    F.count_if(F.col("pos") == F.col("tag")).alias("n_right"))


# ---------------------------------------------------------------------------
# E. word statistics
# ---------------------------------------------------------------------------


@register(
    "word_pos_majority",
    O.with_(*O.words_base())
    + """, c AS (SELECT lemma, pos, count(*) AS n FROM words GROUP BY lemma, pos)
SELECT lemma, arg_min(pos, (-n, pos)) AS pos FROM c GROUP BY lemma""",
)
def q_word_pos_majority(spark, d):
    return WS.word_pos_majority(words(spark, d))


@register(
    "filter_relevant",
    O.with_(*O.words_base()) + f"SELECT {WORD_COLS} FROM words WHERE {O.relevant_sql()}",
)
def q_filter_relevant(spark, d):
    return WS.filter_relevant(words(spark, d)).select(*WORD_COLS.split(", "))


@register(
    "pad_empty_sentences",
    O.with_(*O.words_base(), O.cte_relevant()) + f"SELECT {WORD_COLS} FROM padded",
)
def q_pad_empty_sentences(spark, d):
    return padded(spark, d).select(*WORD_COLS.split(", "))


@register(
    "doc_term",
    O.with_(*O.words_base(), O.cte_relevant()) + "SELECT DISTINCT doc_id, lemma FROM padded WHERE lemma <> ''",
)
def q_doc_term(spark, d):
    return WS.doc_term(padded(spark, d))


@register(
    "doc_term_vectors",
    O.with_(*O.words_base(), O.cte_relevant()) + f""", dt AS (SELECT DISTINCT doc_id, lemma FROM padded WHERE lemma <> ''),
vocab AS (SELECT lemma FROM dt GROUP BY lemma HAVING count(*) >= 1 ORDER BY count(*) DESC, lemma LIMIT {L.MAX_VOCAB_SIZE})
SELECT doc_id, lemma FROM dt JOIN vocab USING (lemma)""",
)
def q_doc_term_vectors(spark, d):
    """The fitted vocabulary, saved and loaded, gives sparse vectors; their long form."""
    docs = table(spark, d, "documents").select("doc_id")
    model = IO.persist_model(SR.fit_doc_term(padded(spark, d), docs), scratch_path(spark, "vocabulary_model"))
    return SR.vectors_to_doc_term(SR.doc_term_vectors(padded(spark, d), docs, model), model)


@register("doc_frequency", O.with_(*O.stats_base()) + "SELECT lemma, df FROM dfreq")
def q_doc_frequency(spark, d):
    return WS.doc_frequency(padded(spark, d), table(spark, d, "documents"))


@register(
    "frequent_words",
    O.with_(*O.stats_base(), O.cte_top("top", N_WORDS_TOP)) + "SELECT lemma, df, rank FROM top",
)
def q_frequent_words(spark, d):
    return WS.frequent_words(dfreq(spark, d), N_WORDS_TOP)


def tfidf(spark: SparkSession, d: str) -> DataFrame:
    return WS.tfidf_by_label(padded(spark, d), dfreq(spark, d), table(spark, d, "documents"), label_col="lang")


LANG_LABELS = "dl AS (SELECT doc_id, lang AS label FROM documents)"
CLUSTER_LABELS = "dl AS (SELECT vec_id AS doc_id, label FROM embeddings)"


def tfidf_sql(doc_labels: str = LANG_LABELS) -> list[str]:
    return [
        *O.stats_base(),
        doc_labels,
        """tfc AS (
  SELECT p.label, p.lemma, count(*) AS tf FROM (
    SELECT w.*, dl.label FROM padded w JOIN dl USING (doc_id)) p
  WHERE p.lemma IN (SELECT lemma FROM dfreq) AND p.label IS NOT NULL
  GROUP BY p.label, p.lemma
),
nl AS (SELECT count(DISTINCT label) AS n FROM dl),
lf AS (SELECT lemma, count(*) AS lf FROM tfc GROUP BY lemma),
tw AS (
  SELECT t.label, t.lemma, t.tf, t.tf * (ln((1 + (SELECT n FROM nl)) / (1 + lf.lf)) + 1) AS w
  FROM tfc t JOIN lf USING (lemma)
),
tfidf AS (
  SELECT label, lemma, tf, w / sqrt(sum(w * w) OVER (PARTITION BY label)) AS weight FROM tw
)""",
    ]


@register(
    "tfidf_by_label",
    O.with_(*tfidf_sql()) + "SELECT label, lemma, tf, round(weight, 6) AS weight FROM tfidf",
)
def q_tfidf_by_label(spark, d):
    t = tfidf(spark, d)
    return t.select("label", "lemma", "tf", round6("weight").alias("weight"))


@register(
    "label_vectors",
    O.with_(*tfidf_sql())
    + """SELECT label, CAST(count(*) OVER (PARTITION BY label) AS INTEGER) AS n_terms,
  CAST(row_number() OVER (PARTITION BY label ORDER BY lemma) - 1 AS INTEGER) AS place, lemma, round(weight, 6) AS weight
FROM tfidf WHERE weight > 0""",
)
def q_label_vectors(spark, d):
    v = WS.label_vectors(tfidf(spark, d))
    return v.select("label", F.size("vector").alias("n_terms"), F.posexplode("vector").alias("place", "term")).select(
        "label", "n_terms", "place", "term.lemma", round6("term.weight").alias("weight"))


@register(
    "top_words_by_label",
    O.with_(*tfidf_sql())
    + f"""SELECT label, lemma, round(weight, 6) AS weight, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY weight DESC, lemma) AS INTEGER) AS rank
  FROM tfidf) WHERE rank <= {N_TOP_PER_LABEL}""",
)
def q_top_words_by_label(spark, d):
    top = WS.top_words_by_label(tfidf(spark, d), N_TOP_PER_LABEL)
    return top.select("label", "lemma", round6("weight").alias("weight"), "rank")


# --- delimiter pair --------------------------------------------------------

def merged_docs(spark: SparkSession, d: str) -> DataFrame:
    return WS.merge_by_delimiter(padded(spark, d), table(spark, d, "documents"))


MERGED_SQL = """merged AS (
  SELECT d.doc_id, coalesce(string_agg(p.lemma, chr(29) ORDER BY p.sent_id, p.word_id), '') || chr(29) AS merged
  FROM documents d LEFT JOIN padded p USING (doc_id) GROUP BY d.doc_id
)"""


@register(
    "merge_by_delimiter",
    O.with_(*O.words_base(), O.cte_relevant(), MERGED_SQL) + "SELECT doc_id, merged FROM merged",
)
def q_merge_by_delimiter(spark, d):
    return merged_docs(spark, d)


@register(
    "split_by_delimiter",
    O.with_(*O.words_base(), O.cte_relevant(), MERGED_SQL)
    + """SELECT doc_id, CAST(t.o - 1 AS INTEGER) AS token_id, t.lemma
FROM merged, unnest(regexp_extract_all(merged, '([^' || chr(29) || ']+?)' || chr(29), 1)) WITH ORDINALITY AS t(lemma, o)""",
)
def q_split_by_delimiter(spark, d):
    return WS.split_merged(merged_docs(spark, d))


# --- wide table, frequencies for given words ---------------------------------


@register(
    "doc_term_wide",
    O.with_(*O.stats_base(), O.cte_top("top", N_COLUMNS))
    + """SELECT d.doc_id, t.lemma, CAST(x.doc_id IS NOT NULL AS INTEGER) AS present
FROM documents d CROSS JOIN top t LEFT JOIN dterm x ON x.doc_id = d.doc_id AND x.lemma = t.lemma""",
)
def q_doc_term_wide(spark, d):
    # The wide table, unpivoted again: its column names depend on the data.
    wide = WS.doc_term_wide(padded(spark, d), table(spark, d, "documents"), dfreq(spark, d), N_COLUMNS)
    return wide.unpivot("doc_id", [F.col(f"`{c}`") for c in wide.columns[1:]], "lemma", "present")


@register(
    "word_frequencies_for",
    O.with_(*O.stats_base(), O.cte_top("top", N_WORDS_WIDE))
    + """SELECT CAST(row_number() OVER (ORDER BY df DESC, lemma) AS INTEGER) AS position, lemma,
  CAST(df AS BIGINT) AS freq FROM top""",
)
def q_word_frequencies_for(spark, d):
    df_ = dfreq(spark, d)
    # The words asked for: the top words, listed alphabetically (input order).
    wanted = WS.frequent_words(df_, N_WORDS_WIDE).select(
        F.row_number().over(Window.orderBy("lemma")).alias("pos"), "lemma"
    )
    return WS.word_frequencies_for(df_, wanted, order="desc")


# --- co-occurrence -------------------------------------------------------------

def co_pairs(spark: SparkSession, d: str) -> DataFrame:
    return NW.sentence_pairs(padded(spark, d), dfreq(spark, d))


def co_sql() -> list[str]:
    return [
        *O.stats_base(),
        """sw AS (SELECT DISTINCT doc_id, sent_id, lemma FROM padded WHERE lemma IN (SELECT lemma FROM dfreq)),
und AS (
  SELECT l.lemma AS lemma1, r.lemma AS lemma2, count(*) AS n
  FROM sw l JOIN sw r ON l.doc_id = r.doc_id AND l.sent_id = r.sent_id AND l.lemma < r.lemma
  GROUP BY 1, 2
)""",
        f"""edges AS (
  SELECT lemma1, lemma2, n, n / max(n) OVER () AS weight FROM (
    SELECT * FROM und ORDER BY n DESC, lemma1, lemma2 LIMIT {L.N_EDGE})
  WHERE n >= {float(L.MIN_CO_OCCURRENCE)!r} * (SELECT n FROM ndocs)
)""",
    ]


@register(
    "co_occurrence",
    O.with_(*co_sql()) + "SELECT lemma1, lemma2, n FROM und UNION ALL SELECT lemma2, lemma1, n FROM und",
)
def q_co_occurrence(spark, d):
    return NW.mirror_pairs(co_pairs(spark, d))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return NW.co_occurrence_edges(co_pairs(spark, d), table(spark, d, "documents"), L.N_EDGE, L.MIN_CO_OCCURRENCE)


@register(
    "co_occurrence_edges",
    O.with_(*co_sql())
    + "SELECT lemma1, lemma2, n, round(weight, 6) AS weight, round(weight * 12, 6) AS width FROM edges",
)
def q_co_occurrence_edges(spark, d):
    e = edges(spark, d)
    return e.select("lemma1", "lemma2", "n", round6("weight").alias("weight"), round6("width").alias("width"))


def pos_color_sql(col: str) -> str:
    whens = " ".join(f"WHEN {col} = {O.q(k)} THEN {O.q(v)}" for k, v in L.POS_COLORS.items())
    return f"CASE {whens} ELSE {O.q(L.OTHER_POS_COLOR)} END"


@register(
    "co_occurrence_nodes",
    O.with_(*co_sql())
    + f""", pv AS (
  SELECT lemma, arg_min(pos, (-n, pos)) AS pos FROM (
    SELECT lemma, pos, count(*) AS n FROM words GROUP BY lemma, pos) GROUP BY lemma
),
mx AS (SELECT max(df) AS m FROM dfreq)
SELECT v.lemma, round(v.df / (SELECT m FROM mx), 6) AS size,
  round(v.df / (SELECT m FROM mx) * {L.NODE_SIZE_SCALE}, 6) AS display_size, {pos_color_sql('pv.pos')} AS color
FROM dfreq v LEFT JOIN pv USING (lemma)
WHERE v.lemma IN (SELECT lemma1 FROM edges UNION SELECT lemma2 FROM edges)
UNION ALL
SELECT {O.q(L.EMPTY_NETWORK_LABEL)}, NULL, NULL, {O.q(L.EMPTY_NETWORK_COLOR)} WHERE NOT EXISTS (SELECT 1 FROM edges)""",
)
def q_co_occurrence_nodes(spark, d):
    # At most n_edge rows, read twice (nodes and the empty check).
    kept = IO.persist_result(edges(spark, d), scratch_path(spark, "edges"))
    n = NW.co_occurrence_nodes(kept, dfreq(spark, d), WS.word_pos_majority(words(spark, d)))
    return n.select("lemma", round6("size").alias("size"), round6("display_size").alias("display_size"), "color")


# --- compare selected vs overall ---------------------------------------------


@register(
    "compare_frequencies",
    O.with_(*O.stats_base())
    + """, sel AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
agg AS (
  SELECT t.lemma, count(*) AS overall, CAST(count(s.doc_id) AS BIGINT) AS selected
  FROM dterm t LEFT JOIN sel s USING (doc_id)
  WHERE t.lemma IN (SELECT lemma FROM dfreq) GROUP BY t.lemma
)
SELECT lemma, overall, selected,
  CAST(row_number() OVER (ORDER BY selected DESC, overall DESC, lemma) AS INTEGER) AS rank FROM agg""",
)
def q_compare_frequencies(spark, d):
    selected = table(spark, d, "labels").filter(F.col("quality") == 1).select("doc_id")
    agg = WS.compare_frequencies(padded(spark, d), selected, dfreq(spark, d))
    # Words that a share of all documents holds: their number depends on the
    # length of documents, not on how many there are, so a global rank is cheap.
    w = Window.orderBy(F.desc("selected"), F.desc("overall"), F.asc("lemma"))
    return agg.withColumn("rank", F.row_number().over(w))


# --- compounds ---------------------------------------------------------------

SEG_SQL = """p1 AS (
  SELECT *, coalesce(lag(dep) OVER (PARTITION BY doc_id, sent_id ORDER BY word_id) = 'compound', false) AS prevc
  FROM words
),
seg AS (
  SELECT *, sum(CASE WHEN prevc THEN 0 ELSE 1 END)
    OVER (PARTITION BY doc_id, sent_id ORDER BY word_id ROWS UNBOUNDED PRECEDING) AS chain
  FROM p1
)"""


@register(
    "merge_compounds",
    O.with_(*O.words_base(), SEG_SQL)
    + """SELECT doc_id, sent_id, CAST(min(word_id) AS INTEGER) AS word_id,
  string_agg(text, ' ' ORDER BY word_id) AS text, string_agg(lemma, ' ' ORDER BY word_id) AS lemma,
  CASE WHEN arg_min(dep, word_id) = 'compound' THEN false ELSE arg_min(is_stop, word_id) END AS is_stop,
  arg_max(pos, word_id) AS pos, arg_max_null(ent_type, word_id) AS ent_type, CAST(count(*) AS INTEGER) AS n_tokens
FROM seg GROUP BY doc_id, sent_id, chain""",
)
def q_merge_compounds(spark, d):
    return TK.merge_compounds(words(spark, d), mode="merged")


@register(
    "merge_compounds_overlapping",
    O.with_(*O.words_base(), SEG_SQL)
    + """SELECT a.doc_id, a.sent_id, a.word_id,
  string_agg(b.text, ' ' ORDER BY b.word_id) AS text, string_agg(b.lemma, ' ' ORDER BY b.word_id) AS lemma,
  CASE WHEN a.dep = 'compound' THEN false ELSE a.is_stop END AS is_stop,
  arg_max(b.pos, b.word_id) AS pos, arg_max_null(b.ent_type, b.word_id) AS ent_type,
  CAST(count(*) AS INTEGER) AS n_tokens
FROM seg a JOIN seg b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND a.chain = b.chain AND b.word_id >= a.word_id
GROUP BY a.doc_id, a.sent_id, a.word_id, a.dep, a.is_stop""",
)
def q_merge_compounds_overlapping(spark, d):
    return TK.merge_compounds(words(spark, d), mode="overlapping")


# ---------------------------------------------------------------------------
# D. vectors (embeddings table: vec_id, embedding FLOAT[64], label)
# ---------------------------------------------------------------------------

def emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def emb_dim(spark: SparkSession, d: str) -> int:
    return int(emb(spark, d).select(F.max(F.size("embedding"))).first()[0])


def long_vec(df: DataFrame, id_col: str, vec_col: str, id_name: str = "id") -> DataFrame:
    return df.select(F.col(id_col).alias(id_name), F.posexplode(vec_col).alias("dim", "value")).select(
        id_name, "dim", round6(F.col("value").cast("double")).alias("value")
    )


UNNEST_EMB = """e AS (
  SELECT vec_id, label, CAST(u.o - 1 AS INTEGER) AS dim, CAST(u.x AS DOUBLE) AS x
  FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(x, o)
)"""


@register(
    "subtoken_pool",
    O.with_(UNNEST_EMB)
    + """, pooled AS (SELECT vec_id // 2 AS word_id, dim, avg(x) AS v FROM e GROUP BY 1, 2),
width AS (SELECT max(len(embedding)) AS w FROM embeddings),
dims AS (SELECT CAST(range AS INTEGER) AS dim FROM range((SELECT w FROM width)))
SELECT d.doc_id AS word_id, dims.dim, round(coalesce(p.v, 0.0), 6) AS value
FROM documents d CROSS JOIN dims LEFT JOIN pooled p ON p.word_id = d.doc_id AND p.dim = dims.dim""",
)
def q_subtoken_pool(spark, d):
    # Every embeddings row is a sub-token of word vec_id div 2; words are the
    # document ids, so most words have no sub-token and get the zero vector.
    sub = emb(spark, d).select(F.expr("vec_id div 2").alias("word_id"), F.col("embedding").alias("vector"))
    wordset = table(spark, d, "documents").select(F.col("doc_id").alias("word_id"))
    pooled = VC.subtoken_pool(wordset, sub, emb_dim(spark, d))
    return long_vec(pooled, "word_id", "vector", "word_id")


SUB_CHARS, SUB_DIM = 4, 4


@register(
    "subtoken_pool_aligned",
    f"""WITH {O.cte_docs()}, parts AS (
  SELECT doc_id, CAST(u.o - 1 AS INTEGER) AS word_id, u.t AS text FROM docs, unnest(string_split(text, ' ')) WITH ORDINALITY AS u(t, o)),
placed AS (
  SELECT doc_id, word_id, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY word_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM parts),
w AS (SELECT doc_id, word_id, CAST(start AS BIGINT) AS start, CAST(start + length(text) AS BIGINT) AS stop FROM placed WHERE text <> ''),
sub AS (
  SELECT doc_id, k, md5(substring(text, {SUB_CHARS} * k + 1, {SUB_CHARS})) AS h
  FROM docs, unnest(range((length(text) + {SUB_CHARS - 1}) // {SUB_CHARS})) AS r(k) WHERE k % 5 <> 4),
reach AS (
  SELECT doc_id, word_id, start, stop, unnest(range(start // {SUB_CHARS}, (stop - 1) // {SUB_CHARS} + 1)) AS k FROM w)
SELECT doc_id, word_id, start, stop, {", ".join(
    f"round(coalesce(avg(('0x' || substr(h, {i + 1}, 1))::INTEGER - 7.5::DOUBLE), 0.0), 6) AS v{i}" for i in range(SUB_DIM))}
FROM reach LEFT JOIN sub USING (doc_id, k) GROUP BY doc_id, word_id, start, stop""",
)
def q_subtoken_pool_aligned(spark, d):
    """Words between spaces and a model's sub-tokens, here pieces of four
    characters of which every fifth is missing, aligned by their places."""
    docs = TK.by_document(clean_docs(spark, d), n_partitions=n_buckets(spark, d))
    # Cut in one pass: a substring by its place would read the text up to there for every piece.
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{SUB_CHARS}}}"), F.lit(0))
    pieces = docs.select("doc_id", F.posexplode(parts).alias("k", "part")).where(F.col("k") % 5 != 4)
    start = F.col("k").cast("long") * SUB_CHARS
    sub = pieces.select("doc_id", start.alias("start"), (start + F.length("part")).alias("stop"), F.md5("part").alias("h"))
    digits = [F.instr(F.lit("0123456789abcdef"), F.substring("h", i + 1, 1)).cast("double") - 8.5 for i in range(SUB_DIM)]
    sub = sub.select("doc_id", "start", "stop", F.array(*digits).alias("vector"))
    pooled = SP.subtoken_pool_aligned(SP.word_spans(docs).drop("text"), sub, SUB_DIM)
    return pooled.select("doc_id", "word_id", "start", "stop", *[round6(F.col("vector")[i]).alias(f"v{i}") for i in range(SUB_DIM)])


@register(
    "pool_vectors",
    O.with_(UNNEST_EMB)
    + """, s AS (SELECT vec_id // 50 AS doc_id, vec_id // 10 AS sent_id, dim, avg(x) AS x FROM e GROUP BY 1, 2, 3)
SELECT doc_id, dim, round(avg(x), 6) AS value FROM s GROUP BY doc_id, dim""",
)
def q_pool_vectors(spark, d):
    w = emb(spark, d).select(
        F.expr("vec_id div 50").alias("doc_id"), F.expr("vec_id div 10").alias("sent_id"),
        F.col("embedding").alias("vector"),
    )
    return long_vec(VC.pool_vectors(w), "doc_id", "vector", "doc_id")


PROJ_K = 8


@register(
    "random_projection",
    O.with_(UNNEST_EMB)
    + f""", j AS (SELECT CAST(range AS INTEGER) AS j FROM range({PROJ_K}))
SELECT e.vec_id AS id, j.j AS dim,
  round(sum(e.x * CASE WHEN substr(md5(e.dim || '|' || j.j), 1, 1) < '8' THEN 1 ELSE -1 END) / sqrt({PROJ_K}), 6) AS value
FROM e CROSS JOIN j GROUP BY e.vec_id, j.j""",
)
def q_random_projection(spark, d):
    p = VC.random_projection(emb(spark, d), "embedding", PROJ_K, emb_dim(spark, d), method="sign", out_col="proj")
    return long_vec(p, "vec_id", "proj")


EMB_DIM = 64  # of the given table, for the matrix in the SQL below
GAUSS_VALUES = ", ".join(
    f"({i}, {j}, {float(x)!r}::DOUBLE)" for (i, j), x in np.ndenumerate(VC.gaussian_matrix(EMB_DIM, PROJ_K, 0))
)


@register(
    "random_projection_gaussian",
    O.with_(UNNEST_EMB, f"g(i, j, r) AS (VALUES {GAUSS_VALUES})")
    + """SELECT e.vec_id AS id, CAST(g.j AS INTEGER) AS dim, round(sum(e.x * g.r), 6) AS value
FROM e JOIN g ON g.i = e.dim GROUP BY e.vec_id, g.j""",
)
def q_random_projection_gaussian(spark, d):
    p = VC.random_projection(emb(spark, d), "embedding", PROJ_K, emb_dim(spark, d), method="gaussian", seed=0,
                             out_col="proj")
    return long_vec(p, "vec_id", "proj")


EMBED_DIM = 64


@register(
    "embed_docs",
    O.with_(*O.words_base(), O.cte_relevant())
    + f""", c AS (
  SELECT doc_id, CAST((('0x' || substr(md5(lemma), 1, 8))::BIGINT) % {EMBED_DIM} AS INTEGER) AS dim, count(*) AS n
  FROM padded WHERE lemma <> '' GROUP BY 1, 2
)
SELECT doc_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM c""",
)
def q_embed_docs(spark, d):
    e = VC.hashed_embedding(padded(spark, d), EMBED_DIM)
    return e.select("doc_id", "dim", round6("value").alias("value"))


@register("embed_docs_svd")
def q_embed_docs_svd(spark, d):
    """Document embeddings by truncated SVD of TF-IDF, placed by the saved model."""
    docs = table(spark, d, "documents").select("doc_id")
    path = scratch_path(spark, "svd_model")
    SR.fit_text_svd(padded(spark, d), docs).save(spark, path)
    placed = SR.place_docs(padded(spark, d), docs, SR.TextSvd.load(spark, path))
    return placed.select("doc_id", F.posexplode("embedding").alias("dim", "value"))


@register(
    "cosine_similarity",
    """WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT x.vec_id, round(list_dot_product(x.v, y.v)
  / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))), 6) AS cosine
FROM a x JOIN a y ON y.vec_id = x.vec_id + 1""",
)
def q_cosine_similarity(spark, d):
    e = emb(spark, d)
    left = e.select(F.col("vec_id"), F.col("embedding").alias("l_vec"))
    right = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("r_vec"))
    return left.join(right, "vec_id").select("vec_id", round6(V.cosine(F.col("l_vec"), F.col("r_vec"))).alias("cosine"))


SIM_K = 5

CENTROIDS_SQL = """nrm AS (SELECT vec_id, sqrt(sum(x * x)) AS nn FROM e GROUP BY vec_id),
u AS (SELECT e.vec_id, e.label, e.dim, e.x / nrm.nn AS x FROM e JOIN nrm USING (vec_id)),
c AS (SELECT label AS c_label, dim, avg(x) AS cx FROM u GROUP BY label, dim)"""


@register(
    "similar_docs",
    O.with_(UNNEST_EMB, CENTROIDS_SQL)
    + f""", tm AS (SELECT label AS target_id, dim, avg(x) AS tx FROM e GROUP BY label, dim),
dots AS (
  SELECT tm.target_id, e.vec_id AS id, sum(tm.tx * e.x) AS dp FROM tm JOIN e USING (dim) GROUP BY 1, 2
),
tn AS (SELECT target_id, sqrt(sum(tx * tx)) AS n FROM tm GROUP BY target_id),
s AS (
  SELECT dots.target_id, dots.id, dp / (tn.n * nrm.nn) AS score
  FROM dots JOIN tn USING (target_id) JOIN nrm ON nrm.vec_id = dots.id
)
SELECT CAST(target_id AS BIGINT) AS target_id, id, round(score, 6) AS score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY target_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s)
WHERE rank <= {SIM_K}""",
)
def q_similar_docs(spark, d):
    # Targets: the mean vector of every label (a handful of rows derived
    # from the table); corpus: every vector.
    e = emb(spark, d)
    targets = VC.mean_vectors(e.select(F.col("label").cast("long").alias("vec_id"), "embedding"), "vec_id", "embedding")
    top = VC.similar_docs(e, targets, SIM_K, exclude_self=False)
    return top.select("target_id", "id", round6("score").alias("score"), "rank")


# Noisy copies of all vectors: many targets whose nearest rows are known.
NOISE, COPY_ID, LINK_AT = 0.01, 1_000_000_000, 0.9
NOISY_SQL = f"""noisy AS (SELECT {COPY_ID} + vec_id AS vec_id, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE)
  + CASE WHEN md5(vec_id || '|' || (i - 1)) < '8' THEN {NOISE} ELSE -{NOISE} END) AS embedding FROM embeddings)"""
UNIT_SQL = "list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))"


def noisy_copies(spark: SparkSession, d: str) -> DataFrame:
    def moved(x, i):
        key = F.concat(F.col("vec_id").cast("string"), F.lit("|"), i.cast("string"))
        return x.cast("double") + F.when(F.md5(key) < "8", F.lit(NOISE)).otherwise(F.lit(-NOISE))

    noisy = emb(spark, d).select("vec_id", F.transform("embedding", moved).alias("embedding"))
    return noisy.withColumn("vec_id", F.col("vec_id") + COPY_ID)


@register(
    "similar_docs_many",
    f"""WITH {NOISY_SQL}, a AS (SELECT vec_id, {UNIT_SQL} AS u FROM (SELECT vec_id, embedding AS v FROM noisy)),
b AS (SELECT vec_id, {UNIT_SQL} AS u FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)),
s AS (SELECT a.vec_id AS target_id, b.vec_id AS id, list_dot_product(a.u, b.u) AS score FROM a, b)
SELECT target_id, id, round(score, 6) AS score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY target_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s WHERE score >= {LINK_AT})
WHERE rank <= {SIM_K}""",
)
def q_similar_docs_many(spark, d):
    """As many targets as corpus rows, by hyperplane buckets."""
    top = SI.similar_docs_many(emb(spark, d), noisy_copies(spark, d), SIM_K, LINK_AT, exclude_self=False)
    return top.select("target_id", "id", round6("score").alias("score"), "rank")


@register(
    "similar_links",
    f"""WITH {NOISY_SQL}, r AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings UNION ALL SELECT * FROM noisy
  UNION ALL SELECT 2 * {COPY_ID} + vec_id, CAST(embedding AS DOUBLE[]) FROM embeddings WHERE label = 1),
a AS (SELECT vec_id, v, {UNIT_SQL} AS u FROM r)
SELECT x.vec_id AS id, min(CASE WHEN x.v = y.v THEN y.vec_id END) AS class_id,
  count(*) FILTER (WHERE x.vec_id <> y.vec_id AND (x.v = y.v OR list_dot_product(x.u, y.u) >= {LINK_AT})) AS n_links
FROM a x, a y GROUP BY x.vec_id""",
)
def q_similar_links(spark, d):
    """All vectors, a noisy copy of each and an exact one of those of a label: links of every row."""
    copies = emb(spark, d).where("label = 1").select((F.col("vec_id") + 2 * COPY_ID).alias("vec_id"), "embedding")
    e = emb(spark, d).select("vec_id", "embedding").unionByName(copies)
    e = e.withColumn("embedding", V.as_double(F.col("embedding"))).unionByName(noisy_copies(spark, d))
    return SI.similar_links(e, LINK_AT)


# ---------------------------------------------------------------------------
# F. document map and clusters
# ---------------------------------------------------------------------------


@register(
    "l2_normalize",
    O.with_(UNNEST_EMB, CENTROIDS_SQL) + "SELECT vec_id, dim, round(x, 6) AS value FROM u",
)
def q_l2_normalize(spark, d):
    n = DM.l2_normalize(emb(spark, d), "embedding")
    return long_vec(n, "vec_id", "embedding", "vec_id")


@register(
    "kmeans_all_k",
    f"""SELECT CAST(k.range AS INTEGER) AS k, count(*) AS n_rows, 0::BIGINT AS n_out_of_range, 0::BIGINT AS n_not_closest
FROM embeddings, range(2, {L.MAX_CLUSTER + 1}) AS k GROUP BY k.range""",
)
def q_kmeans_all_k(spark, d):
    # What SQL can check of every k: a label for each row, labels from 0 to
    # k - 1, and each row in the group of its closest centre.
    e = emb(spark, d)
    models = DM.kmeans_fits(e, max_cluster=L.MAX_CLUSTER)
    found = IO.persist_result(DM.kmeans_labels(e, models), scratch_path(spark, "clusters"), ["k"])
    near = DM.nearest_of_all(e, models)
    own = F.col("label").isNotNull()
    return found.join(near, ["vec_id", "k"]).groupBy(F.col("k").cast("int").alias("k")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(own & ((F.col("label") < 0) | (F.col("label") >= F.col("k")))).alias("n_out_of_range"),
        F.count_if(own & ~F.array_contains("closest", F.col("label"))).alias("n_not_closest"))


def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    n = DM.l2_normalize(emb(spark, d), "embedding")
    return VC.mean_vectors(n, "label", "embedding").withColumnRenamed("embedding", "vector")


@register(
    "nearest_centroid",
    O.with_(UNNEST_EMB, CENTROIDS_SQL)
    + """, dist AS (
  SELECT u.vec_id, c.c_label, sum((u.x - c.cx) * (u.x - c.cx)) AS d2 FROM u JOIN c USING (dim) GROUP BY 1, 2
)
SELECT vec_id, arg_min(c_label, (d2, c_label)) AS label FROM dist GROUP BY vec_id""",
)
def q_nearest_centroid(spark, d):
    n = DM.l2_normalize(emb(spark, d), "embedding")
    return DM.nearest_centroid(n, label_centroids(spark, d))


K_SHOWN = 7


@register("labels_for_k", f"SELECT vec_id, CAST(label % {K_SHOWN} AS INTEGER) AS label, {K_SHOWN} AS k FROM embeddings")
def q_labels_for_k(spark, d):
    # A labelling for every k, made from the table's own labels, stored once
    # and partitioned by k; reading one k prunes to a single directory
    # (PartitionFilters on the scan).
    each = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("label") % k).cast("int").alias("label"))
                     for k in range(2, L.MAX_CLUSTER + 1)])
    stored = emb(spark, d).select("vec_id", F.explode(each).alias("c")).select("vec_id", "c.k", "c.label")
    return DM.labels_for_k(IO.persist_result(stored, scratch_path(spark, "clusters"), ["k"]), K_SHOWN)


@register(
    "document_map_2d",
    """SELECT count(*) AS n_rows, count(*) AS n_placed, 0.0::DOUBLE AS correlation, true AS ordered FROM embeddings""",
)
def q_document_map_2d(spark, d):
    # What SQL can check: every row is placed, the axes are uncorrelated, and
    # the first one spreads more.
    m = DM.document_map_2d(emb(spark, d))
    return m.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("x").alias("n_placed"),
        F.abs(F.round(F.corr("x", "y"), 6)).alias("correlation"),
        (F.var_pop("x") >= F.var_pop("y")).alias("ordered"),
    )


# ---------------------------------------------------------------------------
# G. chart-ready tables
#    points: documents with a vector; x, y = embedding[0], embedding[1];
#    label = embeddings.label; display names 0→"a", 1→"", 2→"2".
# ---------------------------------------------------------------------------

GROUP_NAMES = [(0, "a"), (1, ""), (2, "2")]
TAPPED_LABEL = 3
N_CLOUD_WORDS = 20


def points(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d).select(
        F.col("vec_id").alias("doc_id"),
        F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"),
        "label",
    )
    return e.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def names_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GROUP_NAMES, "label int, name string")


def label_set(spark: SparkSession, d: str) -> DataFrame:
    # From the vector table alone: no join with the texts to list labels.
    return emb(spark, d).select("label").distinct()


def labels_of(spark: SparkSession, d: str) -> DataFrame:
    """The table of labels, a handful of rows, made once: its size is known, so joins broadcast it."""
    return shared_table(spark, d, "labels", lambda: CH.label_table(label_set(spark, d), names_df(spark)))


def chart_rows(spark: SparkSession, d: str) -> DataFrame:
    return CH.scatter_table(points(spark, d), labels_of(spark, d))


def palette_sql(n: str, rank: str) -> str:
    p10 = "[" + ", ".join(O.q(c) for c in L.PALETTE_10) + "]"
    p20 = "[" + ", ".join(O.q(c) for c in L.PALETTE_20) + "]"
    return f"CASE WHEN {n} <= 10 THEN {p10}[{rank}] ELSE {p20}[({rank} - 1) % 20 + 1] END"


G_SQL = [
    """pts AS (
  SELECT e.vec_id AS doc_id, CAST(e.embedding[1] AS DOUBLE) AS x, CAST(e.embedding[2] AS DOUBLE) AS y, e.label, d.text
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id
)""",
    "names(label, name) AS (VALUES " + ", ".join(f"({k}, {O.q(v)})" for k, v in GROUP_NAMES) + ")",
    """labs AS (SELECT DISTINCT label FROM embeddings),
disp AS (
  SELECT l.label, CAST(l.label AS VARCHAR) || ':' || coalesce(n.name, '') AS display_name
  FROM labs l LEFT JOIN (SELECT * FROM names WHERE name <> '' AND name <> CAST(label AS VARCHAR)) n USING (label)
)""",
    "ranks AS (SELECT label, row_number() OVER (ORDER BY label) AS r FROM labs)",
    f"cols AS (SELECT label, {palette_sql('(SELECT count(*) FROM labs)', 'r')} AS color FROM ranks)",
    """rowsg AS (
  SELECT p.doc_id, p.x, p.y, p.text, p.label, c.color, n.display_name
  FROM pts p LEFT JOIN disp n USING (label) LEFT JOIN cols c USING (label)
)""",
    """agg AS (SELECT label, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM pts GROUP BY label),
sh AS (SELECT *, n / sum(n) OVER () AS share FROM agg),
posn AS (
  SELECT label,
    (mx - min(mx) OVER ()) / (max(mx) OVER () - min(mx) OVER ()) AS x,
    (my - min(my) OVER ()) / (max(my) OVER () - min(my) OVER ()) AS y,
    share / max(share) OVER () AS size
  FROM sh
)""",
]


@register("cluster_positions", O.with_(*G_SQL) + """SELECT label, round(x, 6) AS x, round(y, 6) AS y,
  round(size, 6) AS size FROM posn""")
def q_cluster_positions(spark, d):
    p = CH.cluster_positions(points(spark, d))
    return p.select("label", *[round6(c).alias(c) for c in ("x", "y", "size")])


@register("group_display_names", O.with_(*G_SQL) + "SELECT label, display_name FROM disp")
def q_group_display_names(spark, d):
    return CH.group_display_names(label_set(spark, d), names_df(spark))


@register("label_colors", O.with_(*G_SQL) + "SELECT label, color FROM cols")
def q_label_colors(spark, d):
    return CH.label_colors(label_set(spark, d))


@register("scatter_table", O.with_(*G_SQL) + """SELECT doc_id, round(x, 6) AS x, round(y, 6) AS y, text, label,
  color, display_name FROM rowsg""")
def q_scatter_table(spark, d):
    t = chart_rows(spark, d)
    return t.select("doc_id", round6("x").alias("x"), round6("y").alias("y"), "text", "label", "color", "display_name")


@register("axis_ranges", O.with_(*G_SQL) + """SELECT round(min(x) - 0.1, 6) AS x_start, round(max(x) + 0.1, 6) AS x_end,
  round(min(y) - 0.1, 6) AS y_start, round(max(y) + 0.1, 6) AS y_end FROM pts""")
def q_axis_ranges(spark, d):
    a = CH.axis_ranges(points(spark, d))
    return a.select(*[round6(c).alias(c) for c in a.columns])


@register("label_texts", O.with_(*G_SQL) + "SELECT label, doc_id, text FROM pts")
def q_label_texts(spark, d):
    return CH.label_texts(points(spark, d))


@register("document_table", O.with_(*G_SQL) + "SELECT CAST(label AS VARCHAR) AS label, display_name, text FROM rowsg")
def q_document_table(spark, d):
    return CH.document_table(chart_rows(spark, d))


SELECT_SQL = """SELECT s.position, s.doc_id, CAST(r.label AS VARCHAR) AS label,
  r.display_name, r.text FROM sel s JOIN rowsg r USING (doc_id)"""
PH_SQL = (
    f"SELECT NULL::BIGINT, NULL::BIGINT, {O.q(L.EMPTY_TABLE_LABEL)}, {O.q(L.EMPTY_TABLE_LABEL)}, "
    f"{O.q(L.EMPTY_TABLE_TEXT)} FROM range({L.N_EMPTY_ROWS}) WHERE NOT EXISTS (SELECT 1 FROM picked)"
)


@register(
    "select_by_index",
    O.with_(*G_SQL, "sel AS (SELECT 1000000 - 7 * doc_id AS position, doc_id FROM labels WHERE toxic = 1)", f"picked AS ({SELECT_SQL})")
    + "SELECT * FROM picked UNION ALL " + PH_SQL,
)
def q_select_by_index(spark, d):
    # Selected: documents flagged toxic, the last one first.
    sel = table(spark, d, "labels").filter(F.col("toxic") == 1).select(
        (F.lit(1000000) - 7 * F.col("doc_id")).alias("position"), "doc_id"
    )
    return CH.select_by_index(chart_rows(spark, d), sel)


@register(
    "select_by_label",
    O.with_(*G_SQL, f"""picked AS (SELECT CAST(doc_id AS BIGINT) AS position, doc_id, CAST(label AS VARCHAR) AS label,
  display_name, text FROM rowsg WHERE label = {TAPPED_LABEL})""")
    + "SELECT * FROM picked UNION ALL " + PH_SQL,
)
def q_select_by_label(spark, d):
    return CH.select_by_label(chart_rows(spark, d), TAPPED_LABEL)


# --- word clouds: TF-IDF by cluster label → layout lines → canvas -----------

def cluster_tfidf(spark: SparkSession, d: str) -> DataFrame:
    labels = emb(spark, d).select(F.col("vec_id").alias("doc_id"), "label")
    return WS.tfidf_by_label(padded(spark, d), dfreq(spark, d), labels)


SVG_HEADER = '<svg xmlns="http://www.w3.org/2000/svg" width="900" height="900">'


def layout_lines(spark: SparkSession, d: str) -> DataFrame:
    """Rendered lines per group, written once as text files partitioned by
    label (one directory per word cloud) and read back as a text source."""
    def write() -> str:
        top = WS.top_words_by_label(cluster_tfidf(spark, d), N_CLOUD_WORDS)
        r, lab = F.col("rank"), F.col("label")
        line = F.format_string(
            '<text transform="translate(%d,%d)%s" font-size="%d" style="fill:rgb(%d, %d, %d)">%s</text>',
            F.lit(50) + F.pmod(r * 137, F.lit(800)), F.lit(50) + F.pmod(r * 71, F.lit(800)),
            F.when(r % 4 == 0, F.lit(" rotate(-90)")).otherwise(F.lit("")),
            F.lit(8) + F.lit(4) * (F.lit(21) - r),
            F.pmod(r * 50, F.lit(256)), F.pmod(lab * 25, F.lit(256)), F.pmod(r * 13 + lab * 7, F.lit(256)),
            F.col("lemma"),
        )
        # Of every label the first word's row also gives the header line.
        both = F.when(r == 1, F.array(F.lit(SVG_HEADER), line)).otherwise(F.array(line))
        path = scratch_path(spark, "layout")
        top.select("label", F.explode(both).alias("value")).write.partitionBy("label").text(path)
        return path

    return spark.read.text(shared(spark, d, "layout", write))


def cloud_sql() -> list[str]:
    def g(name, i=1):
        return f"regexp_extract(value, {O.q(CH.LAYOUT_PARTS[name])}, {i})"

    return [
        *tfidf_sql(CLUSTER_LABELS),
        f"""topw AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY weight DESC, lemma) AS rank FROM tfidf)
  WHERE rank <= {N_CLOUD_WORDS}
),
lines AS (
  SELECT label, '<text transform="translate(' || (50 + (rank * 137) % 800) || ',' || (50 + (rank * 71) % 800) || ')'
    || CASE WHEN rank % 4 = 0 THEN ' rotate(-90)' ELSE '' END || '" font-size="' || (8 + 4 * (21 - rank))
    || '" style="fill:rgb(' || ((rank * 50) % 256) || ', ' || ((label * 25) % 256) || ', '
    || ((rank * 13 + label * 7) % 256) || ')">' || lemma || '</text>' AS value FROM topw
  UNION ALL SELECT DISTINCT label, {O.q(SVG_HEADER)} FROM topw
),
parsed AS (
  SELECT label, CAST({g('place')} AS INTEGER) AS x, CAST({g('place', 2)} AS INTEGER) AS y,
    CAST({g('font')} AS INTEGER) AS font_size, CAST({g('fill')} AS INTEGER) AS red,
    CAST({g('fill', 2)} AS INTEGER) AS green, CAST({g('fill', 3)} AS INTEGER) AS blue,
    {g('text')} AS text, coalesce(TRY_CAST({g('turn')} AS INTEGER), 0) AS angle
  FROM lines WHERE {g('place')} <> '' AND {g('font')} <> '' AND {g('fill')} <> '' AND {g('text')} <> ''
),
parsedc AS (SELECT *, printf('#%02x%02x%02x', red, green, blue) AS color FROM parsed),
maxfont AS (SELECT max(font_size) AS m FROM parsed)""",
        *G_SQL,
        f"""canvas AS (
  SELECT label,
    (x - 0.5) * {L.CANVAS_WIDTH - 2 * L.CANVAS_MARGIN} * {L.CANVAS_SPREAD} + {(L.CANVAS_WIDTH - 2 * L.CANVAS_MARGIN) / 2} AS cx,
    (y - 0.5) * {L.CANVAS_HEIGHT - 2 * L.CANVAS_MARGIN} * {L.CANVAS_SPREAD} + {(L.CANVAS_HEIGHT - 2 * L.CANVAS_MARGIN) / 2} AS cy,
    {L.CANVAS_HEIGHT} * (size * {L.CANVAS_WIDTH} * {L.CLOUD_SIZE_FACTOR} / (SELECT m FROM maxfont)) / 2 AS radius
  FROM posn
)""",
    ]


@register(
    "parse_layout_lines",
    O.with_(*cloud_sql()) + "SELECT label, x, y, font_size, red, green, blue, text, angle, color FROM parsedc",
)
def q_parse_layout_lines(spark, d):
    return CH.parse_layout_lines(layout_lines(spark, d))


@register(
    "place_words_on_canvas",
    O.with_(*cloud_sql())
    + f"""SELECT w.label, round((w.x - {L.CLOUD_OFFSET}) * (c.radius / {L.CLOUD_DIAMETER / 2}) + c.cx, 6) AS x,
  round((({L.CLOUD_CANVAS} - w.y) - {L.CLOUD_OFFSET}) * (c.radius / {L.CLOUD_DIAMETER / 2}) + c.cy, 6) AS y,
  w.text, round(w.angle / 180 * pi() * -1, 6) AS angle, w.color,
  printf('%.1fpx', w.font_size * ((c.radius / {L.CLOUD_DIAMETER / 2}) * {L.FONT_SCALE})) AS font_size
FROM parsedc w JOIN canvas c USING (label)""",
)
def q_place_words_on_canvas(spark, d):
    words_ = CH.parse_layout_lines(layout_lines(spark, d))
    max_font = words_.select(F.max("font_size")).scalar()
    placed = CH.place_words_on_canvas(words_, CH.cluster_positions(points(spark, d)), max_font)
    return placed.select("label", round6("x").alias("x"), round6("y").alias("y"), "text",
                         round6("angle").alias("angle"), "color", "font_size")


@register(
    "cluster_bubbles",
    O.with_(*cloud_sql())
    + f"""SELECT c.label, round(c.cx, 6) AS x, round(c.cy, 6) AS y, round(c.radius * 2 * {L.BUBBLE_SCALE}, 6) AS diameter,
  k.color, n.display_name FROM canvas c LEFT JOIN disp n USING (label) LEFT JOIN cols k USING (label)""",
)
def q_cluster_bubbles(spark, d):
    words_ = CH.parse_layout_lines(layout_lines(spark, d))
    max_font = words_.select(F.max("font_size")).scalar()
    b = CH.cluster_bubbles(CH.cluster_positions(points(spark, d)), labels_of(spark, d), max_font)
    return b.select("label", round6("x").alias("x"), round6("y").alias("y"), round6("diameter").alias("diameter"),
                    "color", "display_name")


# ---------------------------------------------------------------------------
# H. worker status over the events feed (worker = user_id; now = max(ts))
# ---------------------------------------------------------------------------

def status_ev(spark: SparkSession, d: str) -> DataFrame:
    return MON.status_events(table(spark, d, "events"))


def now_col(spark: SparkSession, d: str):
    return table(spark, d, "events").select(F.max("ts")).scalar()


def stale(spark: SparkSession, d: str) -> DataFrame:
    latest = MON.worker_latest_status(status_ev(spark, d))
    return MON.worker_stale_status(latest, now_col(spark, d))


STATUS_CASE = "CASE event_type " + " ".join(
    f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in MON.EVENT_STATUS.items()) + " ELSE 'not initiated' END"
H_SQL = [
    f"ev AS (SELECT user_id AS worker, ts, {STATUS_CASE} AS status, props AS message, event_id, event_type FROM events)",
    """latest AS (
  SELECT worker, arg_max_null(status, (ts, event_id)) AS last_status, arg_max_null(message, (ts, event_id)) AS message,
    min(ts) AS created_at, max(ts) AS updated_at FROM ev GROUP BY worker
)""",
    f"""stale AS (
  SELECT *, CASE WHEN (epoch_us((SELECT max(ts) FROM events)) - epoch_us(updated_at)) / 1e6 > {L.STALE_AFTER_SECONDS}
      AND last_status NOT IN {O.in_list(L.FINAL_STATUSES)} THEN {O.q(L.STALE_STATUS)} ELSE last_status END AS status
  FROM latest
)""",
]


@register("worker_latest_status", O.with_(*H_SQL) + "SELECT worker, last_status, message, created_at, updated_at FROM latest")
def q_worker_latest_status(spark, d):
    return MON.worker_latest_status(status_ev(spark, d))


@register("worker_stale_status", O.with_(*H_SQL) + "SELECT worker, last_status, updated_at, status FROM stale")
def q_worker_stale_status(spark, d):
    return stale(spark, d).select("worker", "last_status", "updated_at", "status")


@register(
    "status_info_age",
    O.with_(*H_SQL)
    + f"""SELECT event_id, coalesce((epoch_us((SELECT max(ts) FROM events))
    - epoch_us(try_strptime(CASE WHEN event_type = 'error' THEN message ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END,
                            '%Y-%m-%d %H:%M:%S'))) / 1e6 > {L.INFO_TTL_SECONDS}, true) AS is_old
FROM ev""",
)
def q_status_info_age(spark, d):
    # The fetched copy's time: the event time as text; error events carry
    # their payload instead, which does not parse.
    ev = table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", F.col("props"))
        .otherwise(F.date_format("ts", L.TIME_FORMAT)).alias("fetched_at"),
    )
    return MON.status_info_age(ev, now_col(spark, d)).select("event_id", "is_old")


@register(
    "running_workers",
    O.with_(*H_SQL)
    + f"""SELECT CAST(count(*) FILTER (WHERE status IN ('ready', 'running')) AS BIGINT) AS n_running,
  count(*) FILTER (WHERE status IN ('ready', 'running')) < {L.MAX_N_WORKERS} AS can_start FROM stale""",
)
def q_running_workers(spark, d):
    return MON.running_workers(stale(spark, d))


@register(
    "pulse_gaps",
    O.with_(*H_SQL)
    + """SELECT worker, event_id, ts, row_number() OVER w - 1 AS pulse_no,
  round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 6) AS gap_seconds
FROM ev WINDOW w AS (PARTITION BY worker ORDER BY ts, event_id)""",
)
def q_pulse_gaps(spark, d):
    g = MON.pulse_gaps(status_ev(spark, d))
    return g.withColumn("gap_seconds", round6("gap_seconds"))


@register(
    "worker_board",
    O.with_(*H_SQL)
    + f"""SELECT CAST(worker AS VARCHAR) AS name, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at, last_status,
  CASE WHEN status IN ('ready', 'running') THEN {O.q(L.ALIVE_SYMBOL)} ELSE {O.q(L.NOT_ALIVE_SYMBOL)} END AS is_alive,
  last_status = 'error at app' AS cancel FROM stale""",
)
def q_worker_board(spark, d):
    # Workers whose last event failed are marked for cancelling.
    return MON.worker_board(stale(spark, d), F.col("last_status") == "error at app")


@register(
    "worker_latest_status_stream",
    O.with_(*H_SQL) + "SELECT worker, last_status, message, created_at, updated_at FROM latest",
)
def q_worker_latest_status_stream(spark, d):
    schema = table(spark, d, "events").schema
    return MON.worker_latest_status_stream(spark, f"{d}/events.parquet", schema)


SESSION_GAP_H = 6
WATERMARK_DELAY_H = 1


@register(
    "pulse_sessions_stream",
    O.with_(*H_SQL)
    + f""", g AS (
  SELECT worker, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL {SESSION_GAP_H} HOUR
    THEN 1 ELSE 0 END AS brk
  FROM ev WINDOW w AS (PARTITION BY worker ORDER BY ts, event_id)
),
s AS (SELECT *, sum(brk) OVER (PARTITION BY worker ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
sess AS (
  SELECT worker, min(ts) AS session_start, max(ts) + INTERVAL {SESSION_GAP_H} HOUR AS session_end, count(*) AS n_pulses
  FROM s GROUP BY worker, sid
)
SELECT worker, session_start, session_end, n_pulses FROM sess
WHERE session_end <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL {WATERMARK_DELAY_H} HOUR""",
)
def q_pulse_sessions_stream(spark, d):
    schema = table(spark, d, "events").schema
    return MON.pulse_sessions_stream(spark, f"{d}/events.parquet", schema,
                                     gap=f"{SESSION_GAP_H} hours", delay=f"{WATERMARK_DELAY_H} hour")


# ---------------------------------------------------------------------------
# I. hierarchies: region → nation → customer as one adjacency table
# ---------------------------------------------------------------------------

def tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region").select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"),
        F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("label"),
        F.col("r_regionkey").cast("long").alias("key"), F.lit(False).alias("checked"), F.lit(False).alias("disabled"),
    )
    n = table(spark, d, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"),
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"), F.col("n_name").alias("label"),
        F.col("n_nationkey").cast("long").alias("key"), F.lit(False).alias("checked"), F.lit(False).alias("disabled"),
    )
    c = table(spark, d, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent_id"), F.col("c_name").alias("label"),
        F.col("c_custkey").cast("long").alias("key"),
        F.coalesce(F.col("c_acctbal") < 0, F.lit(False)).alias("checked"),
        F.coalesce(F.col("c_mktsegment") == "AUTOMOBILE", F.lit(False)).alias("disabled"),
    )
    return r.unionByName(n).unionByName(c)


def walk(spark: SparkSession, d: str) -> DataFrame:
    return HI.tree_walk(tree_nodes(spark, d))


TREE_SQL = """WITH RECURSIVE nodes AS (
  SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent_id, r_name AS label, CAST(r_regionkey AS BIGINT) AS key,
    false AS checked, false AS disabled FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, CAST(n_nationkey AS BIGINT), false, false FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, CAST(c_custkey AS BIGINT),
    coalesce(c_acctbal < 0, false), coalesce(c_mktsegment = 'AUTOMOBILE', false) FROM customer
),
walk AS (
  SELECT id, label AS path, 0 AS depth, lpad(CAST(key AS VARCHAR), 19, '0') AS preorder_key, checked, disabled,
    [id] AS lineage, checked AS own_checked
  FROM nodes WHERE parent_id IS NULL
  UNION ALL
  SELECT n.id, w.path || '/' || n.label, w.depth + 1, w.preorder_key || '.' || lpad(CAST(n.key AS VARCHAR), 19, '0'),
    w.checked OR n.checked, w.disabled OR n.disabled, list_append(w.lineage, n.id), n.checked
  FROM walk w JOIN nodes n ON n.parent_id = w.id
),
opened AS (SELECT DISTINCT unnest(lineage) AS id FROM walk WHERE own_checked)
"""


@register("tree_paths", TREE_SQL + "SELECT id, path, depth, preorder_key FROM walk")
def q_tree_paths(spark, d):
    return HI.tree_paths(walk(spark, d))


@register("tree_inherit_flags", TREE_SQL + "SELECT id, checked, disabled FROM walk")
def q_tree_inherit_flags(spark, d):
    return HI.tree_inherit_flags(walk(spark, d))


@register(
    "tree_open_nodes",
    TREE_SQL + """SELECT w.id, w.preorder_key, w.checked, (w.checked OR o.id IS NOT NULL) AS open
FROM walk w LEFT JOIN opened o USING (id)""",
)
def q_tree_open_nodes(spark, d):
    return HI.tree_open_nodes(walk(spark, d), HI.tree_marks(tree_nodes(spark, d)))


FLAT_SQL = TREE_SQL + """, flat AS (
  SELECT w.id, row_number() OVER (ORDER BY w.preorder_key) - 1 AS position, w.depth, w.checked, w.disabled,
    (w.checked OR o.id IS NOT NULL) AS open FROM walk w LEFT JOIN opened o USING (id)),
sizes AS (SELECT unnest(lineage) AS id, own_checked FROM walk),
held AS (SELECT id, count(*) AS n_nodes, count(*) FILTER (WHERE own_checked) AS n_checked FROM sizes GROUP BY id)
"""


@register("tree_positions", FLAT_SQL + "SELECT * FROM flat JOIN held USING (id)")
def q_tree_positions(spark, d):
    """Every node's place in the flattened tree and what its subtree holds."""
    return HI.tree_positions(tree_nodes(spark, d)).drop("own_checked")


@register(
    "tree_flat_marks",
    FLAT_SQL + """SELECT 'checked' AS mark, position, id FROM flat WHERE checked
UNION ALL SELECT 'open', position, id FROM flat WHERE open""",
)
def q_tree_flat_marks(spark, d):
    """Checked and open places in the flattened tree."""
    places = HI.tree_positions(tree_nodes(spark, d))
    checked, opened = (HI.flat_positions(places, m).select(F.lit(m).alias("mark"), "position", "id") for m in ("checked", "open"))
    return checked.unionByName(opened)


@register(
    "tree_leaves",
    TREE_SQL + """, parents AS (SELECT DISTINCT parent_id AS id FROM nodes WHERE parent_id IS NOT NULL)
SELECT w.id, p.id IS NULL AS is_leaf, CASE WHEN p.id IS NULL THEN 'table' ELSE 'folder' END AS icon,
  CASE WHEN p.id IS NULL AND w.checked THEN string_split(w.path, '/')[-1] END AS selected_leaf
FROM walk w LEFT JOIN parents p USING (id)""",
)
def q_tree_leaves(spark, d):
    return HI.tree_leaves(walk(spark, d), tree_nodes(spark, d))


# ---------------------------------------------------------------------------
# C. auxiliary columns
# ---------------------------------------------------------------------------

AUX_COLS = ["lang", "source", "n_chars"]
AUX_ROLES = {"lang": {"is_label"}, "source": {"is_train_data"}, "n_chars": {"is_generated"}}


@register(
    "unique_column_names",
    "SELECT doc_id, text, lang AS lang_02, source, lang AS lang_04, n_chars FROM documents",
)
def q_unique_column_names(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", F.col("lang"), "n_chars")
    return COL.with_unique_columns(docs)


@register(
    "column_roles",
    "SELECT * FROM (VALUES "
    + ", ".join(
        "(" + ", ".join([O.q(c)] + [str(r in AUX_ROLES.get(c, set())).lower() for r in COL.ROLES]) + ")"
        for c in AUX_COLS
    )
    + ") AS t(column_name, " + ", ".join(COL.ROLES) + ") JOIN ("
    + " UNION ALL ".join(f"SELECT {O.q(c)} AS column_name, count({c}) AS n_values FROM documents" for c in AUX_COLS)
    + ") USING (column_name)",
)
def q_column_roles(spark, d):
    docs = COL.column_roles(table(spark, d, "documents"), AUX_ROLES)
    return COL.column_info(docs, AUX_COLS)


@register(
    "aux_column",
    """SELECT doc_id, 'source' AS column_name, source AS value FROM documents
UNION ALL SELECT doc_id, 'lang', lang FROM documents
UNION ALL SELECT doc_id, 'source', source FROM documents
UNION ALL SELECT doc_id, 'n_chars', n_chars::VARCHAR FROM documents""",
)
def q_aux_column(spark, d):
    # One column by name, then all of them in turn.
    docs = table(spark, d, "documents")
    return COL.aux_column(docs, AUX_COLS, "source").unionByName(COL.aux_columns(docs, AUX_COLS))


@register("aux_select", f"SELECT {len(AUX_COLS)} AS n_columns, count(*) AS n_rows FROM documents")
def q_aux_select(spark, d):
    return COL.aux_shape(table(spark, d, "documents"), AUX_COLS)


# ---------------------------------------------------------------------------
# A. sources and sinks
# ---------------------------------------------------------------------------

DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars"]
DOC_SQL = "SELECT doc_id, text, lang, source, n_chars FROM documents"


@register("read_corpus_csv", DOC_SQL)
def q_read_corpus_csv(spark, d):
    # Round trip: documents written as CSV (quoted, multi-line), read back
    # with the explicit schema.
    docs = table(spark, d, "documents").select(*DOC_COLS)
    path = scratch_path(spark, "corpus_csv")
    IO.write_corpus_csv(docs, path)
    return IO.read_corpus_csv(spark, path, schema=docs.schema)


@register(
    "corpus_from_dataframe",
    """SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def q_corpus_from_dataframe(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return IO.corpus_from_dataframe(df, text_col="text", id_col="doc_id")


@register(
    "corpus_row_ids",
    f"""SELECT row_number() OVER (ORDER BY md5({" || ".join(
        f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("text", "lang", "source", "n_chars"))})) - 1 AS doc_id,
  text, lang, source, n_chars FROM (SELECT text, lang, source, n_chars FROM documents
  UNION ALL SELECT text, lang, source, n_chars FROM documents WHERE lang = 'fr')""",
)
def q_corpus_row_ids(spark, d):
    """A corpus whose rows have no id, those of one language twice: equal rows keep apart."""
    docs = table(spark, d, "documents").select("text", "lang", "source", "n_chars")
    return IO.corpus_from_dataframe(docs.unionByName(docs.where("lang = 'fr'")), text_col="text")


WORD_DIM = 8
# A word's vector, component k being digit k of the lemma's md5 less 7.5, is compared by its digits.
DIGITS_SQL = "concat_ws(',', " + ", ".join(f"('0x' || substr(md5(lemma), {k + 1}, 1))::INTEGER" for k in range(WORD_DIM)) + ")"
WORD_NO_SQL = "row_number() OVER (ORDER BY doc_id, sent_id, word_id) - 1"


def words_with_vectors(spark: SparkSession, d: str) -> DataFrame:
    return VC.hashed_word_vectors(words(spark, d), WORD_DIM)


def digits(vector) -> F.Column:
    return F.array_join(F.transform(vector, lambda x: (x + 7.5).cast("int").cast("string")), ",")


def dump_corpus(spark: SparkSession, d: str) -> str:
    path = scratch_path(spark, "corpus_dump")
    corpus = COL.column_roles(IO.corpus_from_dataframe(table(spark, d, "documents"), "text", "doc_id"), AUX_ROLES)
    vectors = emb(spark, d).select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    buckets = buckets_of(spark, words_table(spark, d))
    numbered, word_vectors = IO.split_vectors(words_with_vectors(spark, d).drop("lang"), buckets=buckets, follows="lemma")
    parts = {
        "docs": corpus.select("doc_id", "text"),
        "words": numbered,
        "word_vectors": word_vectors,
        "doc_vectors": vectors,
        "aux_info": COL.column_info(corpus, AUX_COLS),
        "aux_data": corpus.select("doc_id", *AUX_COLS),
        "text_info": corpus.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars")),
    }
    IO.corpus_dump(parts, path, {"words": buckets, "word_vectors": buckets})
    return path


@register(
    "corpus_dump",
    O.with_(*O.words_base())
    + """SELECT 'docs' AS part, count(*) AS n_rows FROM documents
UNION ALL SELECT 'words', count(*) FROM words
UNION ALL SELECT 'doc_vectors', count(*) FROM embeddings
UNION ALL SELECT 'word_vectors', count(*) FROM words
UNION ALL SELECT 'aux_info', count(*) FROM (SELECT unnest(['lang', 'source', 'n_chars']))
UNION ALL SELECT 'aux_data', count(*) FROM documents
UNION ALL SELECT 'text_info', count(*) FROM (SELECT count(*) FROM documents)
UNION ALL SELECT 'meta', count(*) FROM (SELECT count(*) FROM documents)""",
)
def q_corpus_dump(spark, d):
    out = None
    for name, df in IO.corpus_load(spark, dump_corpus(spark, d)).items():
        n = df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n_rows"))
        out = n if out is None else out.unionByName(n)
    return out


@register("corpus_load", DOC_SQL.replace(" FROM", ", 'is_label' AS lang_role FROM"))
def q_corpus_load(spark, d):
    # Texts and auxiliary columns of a reloaded corpus, with a role that came back.
    loaded = IO.corpus_load(spark, dump_corpus(spark, d))
    role = next(r for r in COL.ROLES if "lang" in COL.columns_with_role(loaded["aux_data"], r))
    return loaded["docs"].join(loaded["aux_data"], "doc_id").select(*DOC_COLS, F.lit(role).alias("lang_role"))


@register(
    "analysis_model",
    "SELECT count(*) AS n_rows, 0.0::DOUBLE AS largest_difference FROM embeddings",
)
def q_analysis_model(spark, d):
    # A map's model, saved and loaded, places every vector where it did before.
    model = DM.fit_map(emb(spark, d))
    again = IO.persist_model(model, scratch_path(spark, "map_model"))
    a = DM.document_map_2d(emb(spark, d), model=model)
    b = DM.document_map_2d(emb(spark, d), model=again).toDF("vec_id", "x2", "y2")
    return a.join(b, "vec_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.abs(F.col("x") - F.col("x2")) + F.abs(F.col("y") - F.col("y2"))).alias("largest_difference"),
    )


@register("analysis_persist", O.with_(*O.stats_base()) + "SELECT lemma, df FROM dfreq")
def q_analysis_persist(spark, d):
    return IO.persist_result(dfreq(spark, d), scratch_path(spark, "doc_frequency"))


@register(
    "docs_to_word_table",
    O.with_(*O.words_base())
    + """SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY sent_id) - 1 AS INTEGER) AS sent_id,
  word_id, text, lemma, is_stop, pos, dep, ent_type FROM words""",
)
def q_docs_to_word_table(spark, d):
    # The nested form has no sentence ids: flattening numbers the sentences
    # that hold words densely, in document order.
    nested = IO.word_table_to_docs(words(spark, d))
    return IO.docs_to_word_table(nested).select(*WORD_COLS.split(", "))


@register(
    "docs_to_words_and_vectors",
    O.with_(*O.words_base())
    + f"""SELECT {WORD_NO_SQL} AS word_no, doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY sent_id) - 1 AS INTEGER) AS sent_id,
  word_id, text, lemma, is_stop, pos, dep, ent_type, {DIGITS_SQL} AS digits FROM words""",
)
def q_docs_to_words_and_vectors(spark, d):
    """Nested documents with word vectors → numbered words and one table of
    vectors, put together again by position."""
    nested = IO.word_table_to_docs(words_with_vectors(spark, d))
    flat, vectors = IO.split_vectors(IO.docs_to_word_table(nested), buckets=buckets_of(spark, words_table(spark, d)))
    return join_by_position(flat, vectors, IO.WORD_NO).select("word_no", *WORD_COLS.split(", "), digits(F.col("vector")).alias("digits"))


@register(
    "words_and_vectors_to_docs",
    O.with_(*O.words_base())
    + f"""SELECT doc_id, string_agg(lemma, ' ' ORDER BY sent_id, word_id) AS lemmas,
  string_agg({DIGITS_SQL}, ';' ORDER BY sent_id, word_id) AS digits, string_agg(text, '' ORDER BY sent_id, word_id) AS text
FROM words GROUP BY doc_id""",
)
def q_words_and_vectors_to_docs(spark, d):
    """The words and word vectors of a loaded dump, two parts, as nested documents."""
    loaded = IO.corpus_load(spark, dump_corpus(spark, d))
    nested = IO.word_table_to_docs(loaded["words"], loaded["word_vectors"])
    flat = F.flatten("sentences")
    return nested.select("doc_id", F.array_join(F.transform(flat, lambda w: w["lemma"]), " ").alias("lemmas"),
                         F.array_join(F.transform(flat, lambda w: digits(w["vector"])), ";").alias("digits"), "text")


@register(
    "corpus_load_parts",
    O.with_(*O.words_base())
    + f"""SELECT 'words' AS part, {WORD_NO_SQL} AS id, text || '/' || lemma || '/' || pos || '/' || is_stop AS content,
  CAST(NULL AS DOUBLE) AS total FROM words
UNION ALL SELECT 'word_vectors', {WORD_NO_SQL}, {DIGITS_SQL}, NULL FROM words
UNION ALL SELECT 'doc_vectors', vec_id, CAST(len(embedding) AS VARCHAR), round(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i)), 6) FROM embeddings
UNION ALL SELECT 'text_info', 0, count(*) || '/' || sum(length(text)), NULL FROM documents
UNION ALL SELECT 'aux_info', 0, string_agg(c, '/' ORDER BY c), NULL FROM (SELECT unnest(['lang', 'source', 'n_chars']) AS c)""",
)
def q_corpus_load_parts(spark, d):
    """The parts of a loaded dump by value (those that ``corpus_load`` leaves);
    of a document's vector its length and the sum of component times place."""
    loaded = IO.corpus_load(spark, dump_corpus(spark, d))
    no = F.lit(None).cast("double")
    placed = F.aggregate(F.transform("vector", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    shown = [
        loaded["words"].select(F.lit("words").alias("part"), F.col("word_no").alias("id"),
                               F.concat_ws("/", "text", "lemma", "pos", F.col("is_stop").cast("string")).alias("content"), no.alias("total")),
        loaded["word_vectors"].select(F.lit("word_vectors"), "word_no", digits(F.col("vector")), no),
        loaded["doc_vectors"].select(F.lit("doc_vectors"), "doc_id", F.size("vector").cast("string"), F.round(placed, 6)),
        loaded["text_info"].select(F.lit("text_info"), F.lit(0), F.concat_ws("/", "n_docs", "n_chars"), no),
        loaded["aux_info"].agg(F.array_join(F.sort_array(F.collect_list("column_name")), "/").alias("c")).select(F.lit("aux_info"), F.lit(0), "c", no),
    ]
    out = shown[0]
    for df in shown[1:]:
        out = out.union(df)
    return out


@register(
    "word_table_to_docs",
    O.with_(*O.words_base())
    + """SELECT doc_id, CAST(count(DISTINCT sent_id) AS INTEGER) AS n_sentences, CAST(count(*) AS INTEGER) AS n_words,
  string_agg(text, '' ORDER BY sent_id, word_id) AS text FROM words GROUP BY doc_id""",
)
def q_word_table_to_docs(spark, d):
    nested = IO.word_table_to_docs(words(spark, d))
    return nested.select(
        "doc_id", F.size("sentences").alias("n_sentences"),
        F.aggregate(F.transform("sentences", lambda s: F.size(s)), F.lit(0), lambda a, b: a + b).alias("n_words"),
        "text",
    )


PULSE_SLICE_S = 3600


@register(
    "pulse_gaps_stream",
    O.with_(*H_SQL, """g AS (SELECT worker, event_id, ts, row_number() OVER w - 1 AS pulse_no,
  round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 6) AS gap_seconds
FROM ev WINDOW w AS (PARTITION BY worker ORDER BY ts, event_id))""")
    + f"""SELECT * FROM g WHERE (epoch_us(ts) // {PULSE_SLICE_S * 1_000_000} + 1) * {PULSE_SLICE_S * 1_000_000}
  <= epoch_us((SELECT max(ts) FROM events)) - {WATERMARK_DELAY_H} * 3600000000""",
)
def q_pulse_gaps_stream(spark, d):
    """Equal to ``pulse_gaps`` on the pulses of the slices that the watermark has passed."""
    schema = table(spark, d, "events").schema
    g = MON.pulse_gaps_stream(spark, f"{d}/events.parquet", schema, f"{WATERMARK_DELAY_H} hour", PULSE_SLICE_S)
    return g.withColumn("gap_seconds", round6("gap_seconds"))


@register(
    "worker_stale_status_stream",
    O.with_(*H_SQL) + f"SELECT worker, last_status, updated_at, status FROM stale WHERE status = {O.q(L.STALE_STATUS)}",
)
def q_worker_stale_status_stream(spark, d):
    schema = table(spark, d, "events").schema
    return MON.worker_stale_status_stream(spark, f"{d}/events.parquet", schema)
