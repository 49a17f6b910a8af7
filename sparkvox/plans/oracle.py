"""DuckDB SQL equivalents of the registered queries.

The driver runs these on the same parquet tables (views ``documents``,
``embeddings``, ``labels``, ``events``, ``conversations``, ``region``,
``nation``, ``customer`` …) and compares them with the Spark results. The
shared pieces (cleaning, rule tokeniser, content-word filter, vocabulary)
are CTE builders fed by the same fixed tables as the Spark operators.
"""

from __future__ import annotations

from sparkvox.functions import lexicon as L


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


STRIP = L.STRIP_CLASS
REPLACED = "'　' || chr(29) || chr(9) || chr(13)"


def norm_expr(col: str = "text") -> str:
    t = f"translate({col}, {REPLACED}, '    ')"
    t = f"regexp_replace({t}, ' +', ' ', 'g')"
    t = f"regexp_replace({t}, {q('^' + STRIP + '+|' + STRIP + '+$')}, '', 'g')"
    return f"coalesce({t}, '')"


def cap_expr(col: str) -> str:
    return f"coalesce(regexp_matches({col}, {q(L.CAPITALISED)}), false)"


def pos_case(lemma: str) -> str:
    parts = [
        f"WHEN suffix({lemma}, {q(s)}) AND length({lemma}) >= {len(s) + 2} THEN {q(p)}"
        for s, p in L.SUFFIX_RULES
    ]
    parts.append(f"WHEN regexp_matches({lemma}, {q(L.DIGITS_ONLY)}) THEN {q(L.NUM_POS)}")
    return "CASE " + " ".join(parts) + f" ELSE {q(L.DEFAULT_POS)} END"


def cte_docs() -> str:
    return f"docs AS (SELECT doc_id, lang, {norm_expr('text')} AS text FROM documents)"


def cte_words(docs: str = "docs") -> str:
    lex_rows = ", ".join(f"({q(k)}, {q(p)})" for k, p in L.lexicon_items())
    return f"""lex(k, pos) AS (VALUES {lex_rows}),
sents AS (
  SELECT d.doc_id, d.lang, CAST(s.o - 1 AS INTEGER) AS sent_id, s.sent
  FROM {docs} d, unnest(regexp_split_to_array(d.text, {q(L.SENTENCE_SPLIT)})) WITH ORDINALITY AS s(sent, o)
),
wtok AS (
  SELECT s.doc_id, s.lang, s.sent_id, CAST(w.o - 1 AS INTEGER) AS word_id, w.text AS text
  FROM sents s, unnest(regexp_extract_all(s.sent, {q('(' + L.WORD_PATTERN + ')')}, 1)) WITH ORDINALITY AS w(text, o)
),
words AS (
  SELECT t.doc_id, t.sent_id, t.word_id, t.text, lower(t.text) AS lemma,
    coalesce((t.lang || '|' || lower(t.text)) IN {in_list(L.stop_keys())}, false) AS is_stop,
    coalesce(lex.pos, {pos_case('lower(t.text)')}) AS pos,
    CASE WHEN {cap_expr('t.text')}
          AND {cap_expr('lead(t.text) OVER (PARTITION BY t.doc_id, t.sent_id ORDER BY t.word_id)')}
         THEN {q(L.COMPOUND_DEP)} ELSE {q(L.OTHER_DEP)} END AS dep,
    CASE WHEN {cap_expr('t.text')} AND t.word_id > 0 THEN {q(L.ENTITY_TYPE)} END AS ent_type,
    t.lang
  FROM wtok t LEFT JOIN lex ON lex.k = t.lang || '|' || lower(t.text)
)"""


def relevant_sql(alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    pos_ok = f"{a}pos IN {in_list(L.RELEVANT_POS)} AND NOT coalesce({a}is_stop, false)"
    return (
        f"(NOT coalesce({a}lemma IN {in_list(L.ALWAYS_DROPPED_LEMMAS)}, false)) AND coalesce("
        f"CASE WHEN {pos_ok} THEN ({a}pos <> 'AUX' OR {a}lemma = {q(L.KEPT_AUX_LEMMA)}) "
        f"ELSE coalesce({a}ent_type, '') <> '' END, false)"
    )


def cte_relevant() -> str:
    return f"""rel AS (SELECT * FROM words WHERE {relevant_sql()}),
empty_sents AS (
  SELECT doc_id, sent_id FROM words GROUP BY doc_id, sent_id
  HAVING NOT bool_or({relevant_sql()})
),
padded AS (
  SELECT doc_id, sent_id, word_id, text, lemma, is_stop, pos, dep, ent_type FROM rel
  UNION ALL
  SELECT doc_id, sent_id, -1, '', '', true, 'NOUN', NULL, NULL FROM empty_sents
)"""


def num(x) -> str:
    return repr(float(x)) if isinstance(x, float) else str(int(x))


def threshold(value, n: str) -> str:
    return str(int(value)) if isinstance(value, int) else f"{float(value)!r} * {n}"


def cte_vocab(min_df=L.MIN_DOCUMENT_FREQUENCY, max_df=L.MAX_DOCUMENT_FREQUENCY,
              max_vocab: int | None = None, source: str = "padded") -> str:
    cut = "" if max_vocab is None else f"\n  ORDER BY df DESC, lemma LIMIT {int(max_vocab)}"
    return f"""ndocs AS (SELECT count(*) AS n FROM documents),
dterm AS (SELECT DISTINCT doc_id, lemma FROM {source} WHERE lemma <> ''),
dfreq AS (
  SELECT lemma, count(*) AS df FROM dterm GROUP BY lemma
  HAVING count(*) >= {threshold(min_df, '(SELECT n FROM ndocs)')}
     AND count(*) <= {threshold(max_df, '(SELECT n FROM ndocs)')}{cut}
)"""


def cte_top(name: str, n: int) -> str:  # the n most frequent words
    return f"""{name} AS (
  SELECT lemma, df, CAST(row_number() OVER (ORDER BY df DESC, lemma) AS INTEGER) AS rank
  FROM dfreq ORDER BY df DESC, lemma LIMIT {int(n)}
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def words_base() -> list[str]:
    return [cte_docs(), cte_words()]


def stats_base(**kw) -> list[str]:
    return [cte_docs(), cte_words(), cte_relevant(), cte_vocab(**kw)]


def cte_segments(runs: str, pieces: str, max_length: int, unknown: int) -> str:
    """The cheapest words of each run (table ``runs(run)``) by pieces (table
    ``pieces(piece, cost)``): ``segs(run, k, word)``. A recursion over the end
    position keeps the best cost and number of words of the last positions;
    a second one walks back."""
    return f"""rid AS MATERIALIZED (SELECT row_number() OVER () AS r, run FROM (SELECT DISTINCT run FROM {runs})),
spans AS (
  SELECT r, CAST(j AS BIGINT) AS j, CAST(l AS BIGINT) AS l, substring(run, j - l + 1, l) AS piece
  FROM rid, range(1, length(run) + 1) AS js(j), range(1, least({max_length}, j) + 1) AS ls(l)),
arcs AS MATERIALIZED (
  SELECT r, list(ends ORDER BY j) AS es FROM (
    SELECT r, j, list(struct_pack(l := l, c := CAST(coalesce(cost, {unknown}) AS BIGINT))) AS ends
    FROM spans LEFT JOIN {pieces} USING (piece) WHERE cost IS NOT NULL OR l = 1 GROUP BY r, j) GROUP BY r),
walk(r, j, win, b) AS (
  SELECT r, 0, [struct_pack(c := CAST(0 AS BIGINT), w := CAST(0 AS BIGINT))], CAST(0 AS BIGINT) FROM arcs
  UNION ALL
  SELECT r, j + 1, list_append(win, struct_pack(c := m.c, w := m.w))[-{max_length}:], m.b FROM (
    SELECT walk.r, j, win, list_sort(list_transform(es[j + 1], lambda e: struct_pack(
      c := win[-e.l].c + e.c, w := win[-e.l].w + 1, b := CAST(j + 1 - e.l AS BIGINT))))[1] AS m
    FROM walk JOIN arcs ON walk.r = arcs.r WHERE j < len(es))),
backs AS MATERIALIZED (SELECT r, list(b ORDER BY j) AS bs FROM walk WHERE j > 0 GROUP BY r),
steps(r, j, b) AS (
  SELECT r, CAST(len(bs) AS BIGINT), bs[len(bs)] FROM backs
  UNION ALL
  SELECT steps.r, steps.b, bs[steps.b] FROM steps JOIN backs ON steps.r = backs.r WHERE steps.b > 0),
segs AS MATERIALIZED (SELECT run, b AS k, substring(run, b + 1, j - b) AS word FROM steps JOIN rid USING (r))"""
