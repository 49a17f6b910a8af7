"""Sources and sinks (group A): CSV in, corpus from a DataFrame, a
versioned multi-part dump with the meta part written last, result
persistence, and the nested ⇄ flat word-table conversions."""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvox.operators.columns import ROLES, column_roles, unique_column_names
from sparkvox.operators.numbering import dense_numbers, join_by_position, numbers_in_groups
from sparkvox.session import PACKED, bucketed, in_buckets

FORMAT_VERSION = "0.1.0"
# Parts of a whole corpus; those in REQUIRED must be in every dump.
PARTS = ("docs", "words", "word_vectors", "doc_vectors", "aux_info", "aux_data", "text_info")
REQUIRED = ("docs", "aux_info", "aux_data", "text_info")
META = "version string, saved_at string, folder string, parts array<string>, number long, buckets map<string,int>"
# Rows of a CSV file: quoted line ends make a file the work of one task.
CSV_FILE_ROWS = 200_000

_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_corpus_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV with a header and quoted multi-line text ("" escapes a quote).
    A quoted empty field is an empty string, an unquoted empty field is
    NULL; white space at the ends of a field is kept. Pass ``schema`` at
    scale; without it the types are inferred (one extra pass over the data).
    Quoted line ends mean that a file cannot be split."""
    reader = (
        spark.read.options(**_CSV).option("multiLine", True)
        .option("nullValue", "\u0000")  # a value that never occurs: only unquoted empties are NULL
    )
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def write_corpus_csv(df: DataFrame, path: str, file_rows: int = CSV_FILE_ROWS) -> None:
    """Files of at most ``file_rows`` rows, all white space kept."""
    df.write.options(**_CSV).option("maxRecordsPerFile", file_rows).mode("overwrite").csv(path)


def content_key(columns: list[str]) -> Column:
    """A short key of a row's content: the same for equal rows only, whatever
    the columns hold (null and empty differ)."""
    field = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
             for c in (F.col(f"`{n}`") for n in columns)]
    return F.md5(F.concat(*field))


def corpus_from_dataframe(df: DataFrame, text_col: str, id_col: str | None = None) -> DataFrame:
    """One text column becomes ``text``; every other column is an auxiliary
    column (names made unique).

    Without ``id_col`` the rows are numbered densely from 0 in the order of a
    key of their content. Equal rows get ids of their own, and the same table
    gets the same ids whatever its partitioning. Columns must be castable to
    strings then."""
    names = list(df.columns)
    aux_idx = [i for i, c in enumerate(names) if c not in (text_col, id_col)]
    new_aux = unique_column_names([names[i] for i in aux_idx])
    for i, n in zip(aux_idx, new_aux):
        names[i] = n
    df = df.toDF(*names)  # positional rename: duplicates are resolvable after it
    rest = [F.col(text_col).cast("string").alias("text"), *[F.col(f"`{n}`") for n in new_aux]]
    if id_col:
        return df.select(F.col(id_col).alias("doc_id"), *rest)
    numbered = dense_numbers(df, [content_key(names)], "_doc_no")
    return numbered.select(F.col("_doc_no").alias("doc_id"), *rest)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def corpus_dump(parts: dict[str, DataFrame], path: str, buckets: dict[str, int] | None = None) -> None:
    """Write each part as its own Parquet dataset into a new folder of this
    dump, then a one-row ``meta`` dataset (version, time, folder, part names,
    a number one above that of the last dump, and the parts in buckets). Meta is
    replaced last and names the folder, so a dump that was cut short leaves the
    one before it whole, and no load mixes the two.

    Parts named in ``buckets`` are dealt to so many partitions by ``doc_id``
    already and stay so when they are loaded."""
    missing = [p for p in REQUIRED if p not in parts]
    unknown = [p for p in parts if p not in PARTS]
    if missing or unknown:
        raise ValueError(f"a dump needs {missing or 'no more parts'}; unknown parts: {unknown or 'none'}")
    spark = next(iter(parts.values())).sparkSession
    folder, buckets = f"dump-{uuid.uuid4().hex}", buckets or {}
    for name, df in parts.items():
        if name in buckets:
            table = f"sparkvox_{uuid.uuid4().hex[:12]}"
            bucketed(df, buckets[name], "doc_id", table, os.path.join(path, folder, name))
            spark.sql(f"DROP TABLE {table}")  # the files stay, their folder was given
        else:
            df.write.options(**PACKED).parquet(os.path.join(path, folder, name))
    saved_at = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    last = read_meta(spark, path).agg(F.max("number")).first()[0] if _exists(spark, os.path.join(path, "meta")) else None
    meta = spark.createDataFrame([(FORMAT_VERSION, saved_at, folder, sorted(parts), (last or 0) + 1, buckets)], META)
    meta.coalesce(1).write.parquet(os.path.join(path, "meta", folder))


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """One row per complete dump below ``path``: version, time, folder, parts,
    number (null where a dump has none)."""
    meta_path = os.path.join(path, "meta")
    if not _exists(spark, meta_path):
        raise FileNotFoundError(f"no complete dump below {path}")
    return spark.read.schema(META).option("recursiveFileLookup", True).parquet(meta_path)


def corpus_load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts of the newest complete dump, read lazily, and ``meta``. The
    version must agree in its first three characters, the required parts must
    be there, and every part must have been written to its end. The columns of
    ``aux_data`` carry the roles of ``aux_info`` again."""
    metas = read_meta(spark, path)
    newest = metas.orderBy(F.desc_nulls_last("number"), F.desc("saved_at"), F.desc("folder")).first()
    if newest is None:
        raise FileNotFoundError(f"no complete dump below {path}")
    if newest["version"][:3] != FORMAT_VERSION[:3]:
        raise ValueError(f"this dump has format {newest['version']}, which needs another release than {FORMAT_VERSION}")
    out = {"meta": metas.filter(F.col("folder") == newest["folder"])}
    for name in dict.fromkeys((*REQUIRED, *newest["parts"])):
        p = os.path.join(path, newest["folder"], name)
        if not _exists(spark, os.path.join(p, "_SUCCESS")):
            raise FileNotFoundError(f"the dump below {path} lacks its part {name}")
        n = (newest["buckets"] or {}).get(name)
        out[name] = in_buckets(spark, p, n, "doc_id", f"sparkvox_{newest['folder']}_{name}".replace("-", "_")) if n else spark.read.parquet(p)
    roles = {
        r["column_name"]: {role for role in ROLES if r[role]}
        for r in out["aux_info"].select("column_name", *ROLES).collect()  # one row per auxiliary column
    }
    out["aux_data"] = column_roles(out["aux_data"], roles)
    return out


def persist_result(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Save a computed table and return it read back from storage."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


def persist_model(model, path: str):
    """Save a fitted model (the map's PCA, a k-means) and return it read
    back, to place documents that come later."""
    model.write().overwrite().save(path)
    return type(model).load(path)


WORD_FIELDS = ("word_id", "text", "lemma", "is_stop", "pos", "dep", "ent_type")
# Number of a word among all words of a corpus, in document order.
WORD_NO = "word_no"


def word_table_to_docs(words: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Flat words → ``docs(doc_id, sentences ARRAY<ARRAY<word>>, text)`` in
    document order; the text is rebuilt by concatenating word texts.
    One group is one document, bounded by its input row.

    With ``vectors(word_no, vector)`` every word gets the vector of its number
    (``words`` must be numbered, see ``split_vectors``); a ``vector`` column of
    ``words`` goes into the nested words as well. Words and vectors in buckets by
    ``doc_id`` are not shuffled."""
    if vectors is not None:
        words = join_by_position(words, vectors, WORD_NO)
    fields = [*WORD_FIELDS, *(c for c in ("vector",) if c in words.columns)]
    sents = words.groupBy("doc_id", "sent_id").agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("words")
    )
    docs = sents.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sent_id", "words"))).alias("s"))
    return docs.select(
        "doc_id",
        F.transform("s", lambda x: x["words"]).alias("sentences"),
        F.array_join(F.flatten(F.transform("s", lambda x: F.transform(x["words"], lambda w: w["text"]))), "")
        .alias("text"),
    )


def docs_to_word_table(docs: DataFrame) -> DataFrame:
    """Nested documents → flat words in document order (two posexplodes), with
    their ``vector`` where the nested words have one."""
    s = docs.select("doc_id", F.posexplode("sentences").alias("sent_id", "words"))
    w = s.select("doc_id", "sent_id", F.explode("words").alias("w"))
    fields = [f for f in (*WORD_FIELDS, "vector") if f in w.schema["w"].dataType.names]
    return w.select("doc_id", "sent_id", *[F.col(f"w.{f}").alias(f) for f in fields])


def split_vectors(words: DataFrame, *, buckets: int | None = None, follows: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A word table with vectors → the words without them and one table
    ``(word_no, vector)`` of all vectors. Both have the words' numbers in
    document order; the split is undone by ``join_by_position`` on these.

    Words that lie in so many ``buckets`` by ``doc_id`` stay there, and the
    vectors have their word's ``doc_id`` too, so nothing is shuffled to undo the
    split. Where the vector ``follows`` from a column, rows that are equal in it
    and in their place may change numbers: nothing is stored then, and each of
    the two tables is made when it is read."""
    numbered = numbers_in_groups(words, "doc_id", ["sent_id", "word_id", *([follows] if follows else [])], WORD_NO,
                                 buckets=buckets, stored=follows is None)
    return numbered.drop("vector"), numbered.select(*(["doc_id"] if buckets else []), WORD_NO, "vector")
