"""A query for each operator of the search engine, over whole tables, and its SQL for DuckDB.

The SQL works on ``n``: a line's lower-cased words, a space around each.  Stems are told by the
words of the test tables that have them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import highlight
from siftline.operators.database import SearchDatabase
from siftline.plans.tree import And, Keywords, Or, Phrase, QueryNode
from siftline.session import shared_path
from siftline.sources import index as tables

_built: dict[tuple[str, str], str] = {}


def database(spark: SparkSession, sf_dir: str) -> SearchDatabase:
    """The indexed documents of ``sf_dir``; built once in a session, as an index is for many queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        path = shared_path(spark)
        _builder(spark, sf_dir).build(path)
        _built[key] = path
    return SearchDatabase.load(spark, _built[key])


def _builder(spark: SparkSession, sf_dir: str):  # noqa: ANN202
    docs = _table(spark, sf_dir, "documents")
    made = SearchDatabase.builder(spark).sentence_metadata(lambda t: F.struct(F.char_length(t).alias("n_chars")))
    return made.add_documents(docs, "doc_id", "text", ["lang", "source", "n_chars"], ["lang", "source"])


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

_WORDS = r"list_filter(regexp_extract_all(lower(text), '(?:\p{L}(?:[.:·''’]\p{L})*|\p{Nd}(?:[.,;''’]\p{Nd})*|[\p{M}\p{Nl}\p{No}_])+'), lambda w: regexp_matches(w, '[\p{L}\p{N}]'))"


def _lines_sql(table: str = "documents", id: str = "doc_id") -> str:
    return rf"""line AS (SELECT doc_id, CAST(i - 1 AS INT) AS sentence_idx, l[i] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM
 (SELECT {id} AS doc_id, string_split(replace(regexp_replace(text, '\r?\n$', ''), chr(13) || chr(10), chr(10)), chr(10)) AS l FROM {table} WHERE text <> ''))),
s AS (SELECT doc_id, sentence_idx, text, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS n FROM line)"""


def _register(name: str, query: Query, sql: str | None) -> None:
    _queries[name] = query
    if sql is not None:
        _sql[name] = sql


def _search(name: str, make: Callable[[SearchDatabase], QueryNode | None], where: str, plan: str = "auto") -> None:
    """A query whose rows are the matching sentences' ids and texts."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = database(spark, sf_dir)
        return db.query(make(db), plan, highlights=False).select("doc_id", "sentence_idx", "text")

    _register(name, query, f"WITH {_lines_sql()} SELECT s.doc_id, sentence_idx, s.text FROM s WHERE {where}")


def _has(phrase: str) -> str:
    return f"contains(n, ' {phrase} ')"


_HAND = "regexp_matches(n, ' (hand|handed|handes|handing|handly) ')"
_IN = "(in|inly|inlyed|inlying)"
_TEXTS = {
    "phrase_two": ("of the", _has("of the")),
    "phrase_stemmed": ("in the", f"regexp_matches(n, ' {_IN} the ')"),
    "phrase_one_term": ("hand", _HAND),
    "phrase_french": ("de la", _has("de la")),
    "and_two": ("of the AND de la", _has("of the") + " AND " + _has("de la")),
    "and_three": ("of AND by AND for", " AND ".join(map(_has, ["of", "by", "for"]))),
    "or_two": ("of the OR de la", f"({_has('of the')} OR {_has('de la')})"),
    "or_three": ("of the || de la || with the", f"({_has('of the')} OR {_has('de la')} OR {_has('with the')})"),
    "nested_precedence": ("of AND by OR with the", f"{_has('of')} AND ({_has('by')} OR {_has('with the')})"),
    "parens_override": ("(of && by) OR with the", f"({_has('of')} AND {_has('by')}) OR {_has('with the')}"),
    "unknown_term": ("qqqqzzzz", "false"),
    "empty_literal": ('"!!!"', "false"),
}
for _name, (_query, _where) in _TEXTS.items():
    _search(_name, lambda db, q=_query: db.parse_query(q, strict=True), _where)
_search("phrase_three", lambda db: db.phrase_query("of the and"), "regexp_matches(n, ' of the (and|andlyedly) ')")
_search("phrase_cross_punct", lambda db: db.phrase_query("of, the"), _has("of the"))
_search("phrase_repeated", lambda db: db.phrase_query("the the"), _has("the the"))
_search("keywords_two", lambda db: Keywords("by", "with"), f"({_has('by')} OR {_has('with')})")
_search("keywords_many", lambda db: db.terms("of by for with de").keywords(), "(" + " OR ".join(map(_has, "of by for with de".split())) + ")")
_search("builder_tree", lambda db: And(Or(Phrase("of", "the"), Phrase("de", "la")), Keywords("by", "les")), f"({_has('of the')} OR {_has('de la')}) AND ({_has('by')} OR {_has('les')})")
_search("scan_and_two", lambda db: db.parse_query("of the AND by"), f"{_has('of the')} AND {_has('by')}", "scan")
_search("filter_lang", lambda db: db.parse_query("de", document_filter="lang = 'es'"), f"{_has('de')} AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'es')")
_search("filter_source_and_len", lambda db: db.parse_query("of OR de", document_filter=(F.col("source") == "src0") & (F.col("n_chars") > 1000)), f"({_has('of')} OR {_has('de')}) AND doc_id IN (SELECT doc_id FROM documents WHERE source = 'src0' AND n_chars > 1000)")
_search("filter_branch", lambda db: Phrase("of", "the").filter_documents("n_chars > 3000") | Phrase("de", "la"), f"({_has('of the')} AND doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 3000)) OR {_has('de la')}")
_search("sentence_filter_len", lambda db: db.phrase_query("of the").filter_sentences("metadata.n_chars > 200"), f"{_has('of the')} AND length(s.text) > 200")


def filter_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as metadata: documents without one aren't matched."""
    docs = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    db = SearchDatabase.builder(spark).add_documents(docs, "doc_id", "text", ["quality"]).build(on_duplicate="any")
    return db.query(db.parse_query("of", document_filter="quality = 1"), highlights=False).select("doc_id", "sentence_idx")


_register("filter_labels", filter_labels, f"WITH {_lines_sql()} SELECT doc_id, sentence_idx FROM s WHERE {_has('of')} AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")


def lines_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir).index.sentences.select("doc_id", "sentence_idx", "text")


_register("lines_documents", lines_documents, f"WITH {_lines_sql()} SELECT doc_id, sentence_idx, text FROM line")


def lines_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as documents, numbered by conversation and turn."""
    turns = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return tables.sentences(turns).select("doc_id", "sentence_idx", "text")


_register("lines_conversations", lines_conversations, f"WITH {_lines_sql('conversations', 'conv_id * 1000 + turn')} SELECT doc_id, sentence_idx, text FROM line")


def tokens_count_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir).index.sentences.groupBy("doc_id").agg(F.sum(F.size("tokens")).alias("n_tokens"))


_register("tokens_count_per_doc", tokens_count_per_doc, f"WITH {_lines_sql()} SELECT doc_id, CAST(sum(len({_WORDS})) AS BIGINT) AS n_tokens FROM line GROUP BY doc_id")


def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ranges of the words of the test items."""
    found = tables.sentences(_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))
    each = found.select("doc_id", "sentence_idx", "text", F.posexplode("tokens").alias("pos", "t"))
    word = F.expr("decode(substring(CAST(text AS BINARY), t.start + 1, t.end - t.start), 'UTF-8')")
    return each.select("doc_id", "sentence_idx", "pos", F.col("t.start").alias("start_byte"), F.col("t.end").alias("end_byte"), word.alias("word"))


_register(
    "token_offsets",
    token_offsets,
    rf"""WITH {_lines_sql("benchmark", "item_id")},
p AS (SELECT doc_id, sentence_idx, w, g, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, sentence_idx, regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_]+') AS w, string_split_regex(text, '[\p{{L}}\p{{M}}\p{{N}}_]+') AS g FROM line))
SELECT doc_id, sentence_idx, CAST(i - 1 AS INT) AS pos, w[i] AS word, CAST(b AS INT) AS start_byte, CAST(b + strlen(w[i]) AS INT) AS end_byte
FROM (SELECT *, strlen(array_to_string(w[1:i - 1], '')) + strlen(array_to_string(g[1:i], '')) AS b FROM p)""",
)


def lowered_vocab_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as written but lower-cased, and in how many sentences each occurs."""
    docs = _table(spark, sf_dir, "documents")
    found = tables.sentences(docs, "lower").select(F.explode(F.array_distinct("stems")).alias("word"))
    return found.groupBy("word").agg(F.count("*").alias("df"))


_register("lowered_vocab_df", lowered_vocab_df, rf"WITH {_lines_sql()} SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(list_filter(string_split(n, ' '), lambda x: x <> ''))) AS word FROM s) GROUP BY word")


def stem_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms with their number and document frequency; SQL can't stem."""
    index = database(spark, sf_dir).index
    return tables.numbered(index.postings).join(index.vocabulary, "stem")


_register("stem_vocab", stem_vocab, None)


def postings_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir).postings("of").select("doc_id", "sentence_idx", F.size("positions").alias("n"), F.element_at("positions", 1).alias("first_pos"))


_register("postings_term", postings_term, rf"WITH {_lines_sql()}, w AS (SELECT doc_id, sentence_idx, list_filter(string_split(n, ' '), lambda x: x <> '') AS w FROM s) SELECT doc_id, sentence_idx, CAST(len(list_filter(w, lambda x: x = 'of')) AS INT) AS n, CAST(list_position(w, 'of') - 1 AS INT) AS first_pos FROM w WHERE list_contains(w, 'of')")


def _shown(query: str) -> Query:
    def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = database(spark, sf_dir)
        found = db.query(db.parse_query(query, strict=True), parts=True)
        return found.select("doc_id", "sentence_idx", highlight.marked("parts").alias("marked"))

    return shown


def _mark_sql(pattern: str) -> str:
    one = rf"regexp_replace({{0}}, '(?i)(^|[^\pL\pM\pN_\x{{{{E000}}}}\x{{{{E001}}}}])({pattern})($|[^\pL\pM\pN_])', '\1' || chr(57344) || '\2' || chr(57345) || '\3', 'g')"
    return f"replace(replace({one.format(one.format('text'))}, chr(57344), '['), chr(57345), ']')"


_GAP = r"[^\pL\pM\pN_]+"
_register("highlight_marked", _shown("of the"), f"WITH {_lines_sql()} SELECT doc_id, sentence_idx, {_mark_sql('of' + _GAP + 'the')} AS marked FROM s WHERE {_has('of the')}")
_register("highlight_keywords", _shown("by OR with"), f"WITH {_lines_sql()} SELECT doc_id, sentence_idx, {_mark_sql('by|with')} AS marked FROM s WHERE {_has('by')} OR {_has('with')}")
_register("highlight_branch_rule", _shown("(of AND qqqqzzzz) OR by"), f"WITH {_lines_sql()} SELECT doc_id, sentence_idx, {_mark_sql('by')} AS marked FROM s WHERE {_has('by')}")


def highlight_spans_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    return db.query(db.phrase_query("of the")).select("doc_id", "sentence_idx", F.size("highlights").alias("n_spans"))


_register("highlight_spans_count", highlight_spans_count, rf"WITH {_lines_sql()} SELECT doc_id, sentence_idx, CAST(len(regexp_extract_all(replace(n, ' ', '  '), ' of  the ')) AS INT) AS n_spans FROM s WHERE {_has('of the')}")


def get_doc_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    found = db.with_payload(db.query(db.phrase_query("with the"), highlights=False))
    return found.select("doc_id", "sentence_idx", F.col("data.lang").alias("lang"), F.col("data.source").alias("source"))


_register("get_doc_payload", get_doc_payload, f"WITH {_lines_sql()} SELECT s.doc_id, sentence_idx, lang, source FROM s JOIN documents d ON s.doc_id = d.doc_id WHERE {_has('with the')}")


def result_order_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten results in order."""
    db = database(spark, sf_dir)
    return db.query(db.phrase_query("of the"), ordered=True, highlights=False).select("doc_id", "sentence_idx").limit(10)


_register("result_order_topn", result_order_topn, f"WITH {_lines_sql()} SELECT doc_id, sentence_idx FROM s WHERE {_has('of the')} ORDER BY doc_id, sentence_idx LIMIT 10")


def roundtrip_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lazy database, persisted and loaded."""
    path = shared_path(spark)
    _builder(spark, sf_dir).build().persist(path)
    db = SearchDatabase.load(spark, path)
    return db.query(db.parse_query("of the AND by"), highlights=False).select("doc_id", "sentence_idx", "text")


_register("roundtrip_saved", roundtrip_saved, _sql["scan_and_two"])


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
