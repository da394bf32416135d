"""Queries of the core operators over the test tables, by name, and SQL for those that SQL can express.

Groups of documents are their languages or sources; the control is the source ``human_control``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import stats as S
from glyphmill.functions import text as T
from glyphmill.functions.chartables import HIDDEN_RATE_BUCKETS, RATE_BUCKETS, SUSPICIOUS
from glyphmill.operators import compare, ledger, lexical, records, resample, routes, scan, sequence
from glyphmill.plans import dialect as D
from glyphmill.storage import materialise, read_table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

def _lang():
    return F.coalesce("lang", F.lit("none"))


def _source():
    return F.coalesce("source", F.lit("none"))


def _control():
    return F.col("source") == "human_control"


def _prose():
    return F.col("prompt_category").isNull() | ~F.col("prompt_category").isin(*lexical.NOT_PROSE)


PROSE_SQL = f"(prompt_category is null or prompt_category not in ({', '.join(map(D.q, lexical.NOT_PROSE))}))"
ODD = r"[^\x20-\x7E\t\n\r]"
HIDDEN = r"[\x{AD}\x{61C}\x{180E}\x{200B}-\x{200D}\x{2060}-\x{2064}\x{FEFF}]"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


def _spread(table: DataFrame, key: str) -> DataFrame:
    """A table that is read in fewer partitions than there are cores is spread over these; a larger one stays as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores, key) if table.rdd.getNumPartitions() < cores else table


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return _spread(read_table(spark, folder, "documents"), "doc_id")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return _spread(read_table(spark, folder, "manifest"), "sample_id")


# --- character scanner -------------------------------------------------------------------------------

_CHARS = f"chars as (select coalesce(lang, 'none') as grp, unnest({D.chars('text')}) as ch from documents where text is not null)"
_RATES = f"""with {_CHARS}, totals as (select coalesce(lang, 'none') as grp, sum(length(text))::bigint as total_chars from documents where text is not null group by 1),
found as (select grp, {D.rate_bucket('ch')} as category, count(*) as n from chars group by 1, 2),
grid as (select grp, total_chars, unnest([{', '.join(map(D.q, RATE_BUCKETS))}]) as category from totals),
rates as (select grp, category, coalesce(n, 0)::bigint as n, total_chars from grid left join found using (grp, category))"""


@query(f"{_RATES} select grp, category, n, total_chars, round(1000.0 * n / nullif(total_chars, 0), 6) as per_1k, round(1000 * {D.wilson_upper('n', 'total_chars')}, 6) as wilson_upper_per_1k from rates")
def bucket_rates(spark, folder):
    return scan.group_rates(docs(spark, folder), _lang(), "text")


@query(f"{_RATES}, one as (select sum(n)::bigint as hidden, (select sum(total_chars) from totals)::bigint as total_chars from rates where category in ({', '.join(map(D.q, HIDDEN_RATE_BUCKETS))})) select hidden, total_chars, round(1000.0 * hidden / total_chars, 8) as observed_rate_per_1k, round(1000 * {D.wilson_upper('hidden', 'total_chars')}, 8) as wilson_upper_per_1k_chars from one")
def pooled_hidden(spark, folder):
    return scan.pooled_hidden(docs(spark, folder), "text")


_PLACED = f"placed as (select doc_id, unnest({D.chars('text')}) as ch, generate_subscripts({D.chars('text')}, 1) - 1 as pos from documents where text <> '')"


@query(f"with {_PLACED} select doc_id, format('U+{{:04X}}', unicode(ch)) as codepoint, unicode(ch) as cp, regexp_replace(hex(encode(ch)), '(..)', '\\1 ', 'g')[:-2] as utf8_hex, count(*) as n, array_to_string(list(pos order by pos)[1:200], ',') as positions, count(*) > 200 as positions_capped from placed group by doc_id, ch")
def codepoint_inventory(spark, folder):
    seen = scan.inventory(docs(spark, folder), "doc_id", "text")
    return seen.select(F.col("id").alias("doc_id"), T.label(T.code_point(F.col("ch"))).alias("codepoint"), T.code_point(F.col("ch")).alias("cp"), T.utf8_hex(F.col("ch")).alias("utf8_hex"), "n", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"), "positions_capped")


_MIXED = f"""words as (select doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}]+')) as word from documents where text is not null),
wchars as (select doc_id, word, unnest({D.chars('word')}) as ch from (select doc_id, word, row_number() over () as k from words where regexp_matches(word, '[{''.join(D.HOMOGLYPHS)}]')) where list_bool_or(list_transform({D.chars('word')}, lambda c: {D.latin('c')}))),
mixed as (select doc_id, ch, count(*) as mixed from wchars where {D.is_homoglyph('ch')} group by 1, 2)"""
_ENTRIES = f"""{_PLACED}, {_MIXED}, seen as (select doc_id, ch, count(*) as n from placed where regexp_matches(ch, '[^\\x20-\\x7E\\t\\n\\r]') group by 1, 2),
entries as (select doc_id, ch, n, mixed, case when mixed is not null and {D.scanner_bucket('ch')} in ('typographic', 'other_non_ascii') then 'confusable_homoglyph' else {D.scanner_bucket('ch')} end as bucket from seen left join mixed using (doc_id, ch))"""


@query(f"with {_ENTRIES} select doc_id, bucket, count(*) as distinct_codepoints, sum(n)::bigint as occurrences from entries where bucket is not null group by 1, 2")
def bucket_totals(spark, folder):
    return scan.bucket_totals(docs(spark, folder), "doc_id", "text").select(F.col("id").alias("doc_id"), "bucket", F.col("distinct").alias("distinct_codepoints"), "occurrences")


@query(f"with {_PLACED}, {_MIXED} select doc_id, ch, mixed, (select count(*) from placed p where p.doc_id = mixed.doc_id and p.ch = mixed.ch) as total from mixed")
def mixed_script(spark, folder):
    return scan.mixed_script(docs(spark, folder), "doc_id", "text").select(F.col("id").alias("doc_id"), "ch", "mixed", F.col("n").alias("total"))


_FLAG_SQL = ", ".join(f"coalesce(list_contains(b, {D.q(v)}), false) as {k}" for k, v in scan.FLAGS.items())


@query(f"with {_ENTRIES}, by_doc as (select doc_id, list(distinct bucket) as b from entries where bucket is not null group by 1) select doc_id, not regexp_matches(text, '[^\\x00-\\x7F]') as is_pure_ascii, not regexp_matches(text, '[^\\x20-\\x7E\\t\\n\\r]') as is_printable_ascii_plus_newline_tab, {_FLAG_SQL}, coalesce(list_has_any(b, [{', '.join(map(D.q, sorted(SUSPICIOUS)))}]), false) as any_suspicious from documents left join by_doc using (doc_id) where text is not null")
def doc_flags(spark, folder):
    return scan.document_flags(docs(spark, folder), "doc_id", "text").withColumnRenamed("id", "doc_id")


@query("with c as (select coalesce(model_id, 'none') as grp, unnest(regexp_extract_all(text, '[^\\x0A\\x20-\\x7E]')) as ch from documents where prompt_category = 'ascii_only') select grp, format('U+{:04X}', unicode(ch)) as codepoint, count(*) as n from c group by grp, ch")
def ascii_violations(spark, folder):
    return scan.ascii_violations(docs(spark, folder).where("prompt_category = 'ascii_only'"), F.coalesce("model_id", F.lit("none")), "text")


def _escape_sql(c: str) -> str:
    return f"case when {c} = '\\' then '\\\\' when unicode({c}) between 32 and 126 then {c} when unicode({c}) > 65535 then format('\\U{{:08X}}', unicode({c})) else format('\\u{{:04X}}', unicode({c})) end"


def _escaped_sql(t: str) -> str:
    return f"coalesce(array_to_string(list_transform({t}, lambda c: {_escape_sql('c')}), ''), '')"


@query(f"with {_PLACED}, hits as (select doc_id, ch, pos, row_number() over (partition by doc_id, ch order by pos) as k from placed where regexp_matches(ch, {D.q(HIDDEN)})), c as (select doc_id, {D.chars('text')} as cs from documents) select doc_id, pos, {_escaped_sql('cs[greatest(pos - 29, 1):pos]')} || '[[' || format('U+{{:04X}}', unicode(ch)) || ']]' || {_escaped_sql('cs[pos + 2:pos + 31]')} as context from hits join c using (doc_id) where k <= 20")
def contexts(spark, folder):
    return scan.contexts(docs(spark, folder), "doc_id", "text", HIDDEN).select(F.col("id").alias("doc_id"), "pos", "context")


@query(f"select doc_id, {_escaped_sql(D.chars('text'))} as escaped from documents where text is not null")
def escaped_texts(spark, folder):
    return docs(spark, folder).where("text is not null").select("doc_id", T.escaped(F.col("text")).alias("escaped"))


#: Hidden payloads are put into every text, for the tables have none: ZWJ-free tag characters spelling its id.
_TAGGED = "text || chr(917505) || array_to_string(list_transform(regexp_extract_all(doc_id::varchar, '.'), lambda c: chr(917504 + unicode(c))), '') || chr(917631)"


@query("select doc_id, '[TAG-LANG]' || doc_id || '[TAG-END]' as payload from documents where text is not null")
def tag_payloads(spark, folder):
    tag = F.array_join(F.transform(F.split(F.col("doc_id").cast("string"), ""), lambda c: F.element_at(F.create_map(*(x for k in range(10) for x in (F.lit(str(k)), F.lit(chr(0xE0030 + k))))), c)), "")
    tagged = docs(spark, folder).where("text is not null").withColumn("text", F.concat("text", F.lit("\U000e0001"), tag, F.lit("\U000e007f")))
    return tagged.select("doc_id", F.array_join(T.tag_payloads(F.col("text")), "|").alias("payload"))


@query("with t as (select doc_id, text, nfc_normalize(text) as n from documents where text is not null) select doc_id, n = text as is_nfc, length(n) as chars, octet_length(encode(n)) as bytes, sha256(n) as sha256 from t")
def nfc_report(spark, folder):
    n = docs(spark, folder).where("text is not null").select("doc_id", scan.normal_forms("text").alias("n"))
    return n.select("doc_id", F.col("n.nfc_is").alias("is_nfc"), F.col("n.nfc_chars").alias("chars"), F.col("n.nfc_bytes").alias("bytes"), F.col("n.nfc_sha256").alias("sha256"))


@query()
def normal_forms(spark, folder):
    return docs(spark, folder).where("text is not null").select("doc_id", scan.normal_forms("text").alias("n")).select("doc_id", "n.*")


@query()
def scan_reports(spark, folder):
    m = manifest(spark, folder).select("sample_id", F.try_to_binary("content_b64", F.lit("base64")).alias("content")).dropDuplicates(["sample_id"])
    return scan.reports(m, "sample_id", "content").select("id", "sha256", "utf8_bytes", "char_count", "utf8_valid", F.to_json("summary").alias("summary"), F.to_json("buckets").alias("buckets"), F.to_json("decode_error").alias("decode_error"), F.to_json("notes").alias("notes"))


@query("select sample_id, octet_length(from_base64(content_b64)) as bytes_len, decodes_as_utf8 as utf8_valid, (case when decodes_as_utf8 then length(text) end)::double as chars from (select distinct sample_id, content_b64, decodes_as_utf8, text from manifest where content_b64 is not null)")
def utf8_validation(spark, folder):
    m = manifest(spark, folder).where("content_b64 is not null").select("sample_id", "content_b64").distinct()
    d = scan.decoded(m.select("sample_id", F.unbase64("content_b64").alias("content")), "content")
    return d.select("sample_id", F.octet_length("content").alias("bytes_len"), "utf8_valid", F.when(F.col("utf8_valid"), F.length("text")).cast("double").alias("chars"))


# --- words, sentences, punctuation ---------------------------------------------------------------------

_BASE = "base as (select doc_id as doc, coalesce(lang, 'none') as grp, text, prompt_category from documents where text is not null)"


@query(f"with {_BASE} select grp, count(*) as files, sum(length(text))::bigint as chars, sum(len({D.words('text')}))::bigint as words, sum({PROSE_SQL}::int)::bigint as prose_files, coalesce(sum(case when {PROSE_SQL} then length(text) end), 0)::bigint as prose_chars, coalesce(sum(case when {PROSE_SQL} then len({D.sentences('text')}) end), 0)::bigint as prose_sentences from base group by 1")
def sample_sizes(spark, folder):
    return lexical.sample_sizes(docs(spark, folder), _lang(), _prose())


_WORDS = f"each as (select grp, doc, lower(unnest({D.words('text')})) as word, generate_subscripts({D.words('text')}, 1) as k, unnest({D.words('text')}) as w from base where len({D.words('text')}) > 0)"


@query(f"with {_BASE}, {_WORDS}, c as (select grp, word, count(*) as n, min((doc, k)) as first from each group by 1, 2), t as (select grp, sum(n)::bigint as total_words, count(*) as vocab_size from c group by 1), r as (select *, row_number() over (partition by grp order by n desc, first) as place from c) select grp, place, word, n, total_words, vocab_size, round(n / total_words * 1000, 6) as rate_per_1000 from r join t using (grp) where place <= 25")
def top_words(spark, folder):
    return lexical.top_words(docs(spark, folder), _lang(), "doc_id")


def _distinctive_sql(grams: str, least: int) -> str:
    return f"""{grams}, c as (select grp, gram, count(*) as n, min(idx) as first from grams group by 1, 2), t as (select grp, sum(n)::bigint as total, count(*) as distinct_ngrams from c group by 1),
    rated as (select c.*, total, distinct_ngrams, n / total as rate from c join t using (grp)), s as (select gram, sum(rate) as all_rates from rated group by 1),
    x as (select rated.*, round(rate - coalesce((all_rates - rate) / nullif((select count(*) from t) - 1, 0), 0.0), 12) as excess from rated join s using (gram) where n >= {least}),
    r as (select *, row_number() over (partition by grp order by excess desc, first) as place from x)
    select grp, place, gram, n, total as total_ngrams, distinct_ngrams, round(rate * 1000, 6) as rate_per_1000, round(excess * 1000, 6) as excess_per_1000 from r where place <= 12"""


def _ngram_queries() -> None:
    for n in (1, 2, 3):
        gram = " || ' ' || ".join(["word", *(f"lead(word, {k}) over w" for k in range(1, n))])
        sql = f"with {_BASE}, {_WORDS}, seq as (select grp, word, row_number() over (partition by grp order by doc, k) as idx from each), all_ as (select grp, idx, {gram} as gram from seq window w as (partition by grp order by idx)), grams as (select * from all_ where gram is not null)"
        query(_distinctive_sql(sql, 3 if n <= 2 else 2), f"word_ngrams_{n}")(lambda spark, folder, n=n: lexical.distinctive_words(docs(spark, folder), _lang(), "doc_id", n))
    for n in (1, 2, 3, 4):
        joined = f"joined as (select grp, regexp_replace({D.strip('lower(string_agg(text, chr(0) order by doc))').replace('chr(0)', D.q(''))}, {D.q(D.SPACE + '+')}, ' ', 'g') as t from base group by 1)"
        gram = " || ".join(["ch", *(f"lead(ch, {k}) over w" for k in range(1, n))])
        sql = f"with {_BASE}, {joined}, seq as (select grp, unnest({D.chars('t')}) as ch, generate_subscripts({D.chars('t')}, 1) as idx from joined where t <> ''), all_ as (select grp, idx, {gram} as gram from seq window w as (partition by grp order by idx)), grams as (select * from all_ where gram is not null)"
        query(_distinctive_sql(sql, 5), f"char_ngrams_{n}")(lambda spark, folder, n=n: lexical.distinctive_characters(docs(spark, folder), _lang(), "doc_id", n))


_ngram_queries()
_PUNCT = f"counted as ({D.punctuation_union("select {keys}, '{{name}}' as category, sum({{count}})::bigint as n, sum(length(text))::bigint as chars from base group by all".format(keys='grp'))})"


@query(f"with {_BASE}, {_PUNCT} select grp, category, n, chars, {D.rates('n', 'chars')} from counted")
def punct_rates(spark, folder):
    return lexical.punctuation_rates(docs(spark, folder), {"grp": _lang()})


@query(f"with {_BASE}, {_PUNCT.replace('select grp,', "select grp, coalesce(prompt_category, 'none') as prompt_category,")} select grp, prompt_category, category, n, chars, {D.rates('n', 'chars')} from counted")
def punct_by_category(spark, folder):
    return lexical.punctuation_rates(docs(spark, folder), {"grp": _lang(), "prompt_category": F.coalesce("prompt_category", F.lit("none"))})


_BY_SOURCE = "base as (select doc_id as doc, coalesce(source, 'none') as grp, text, prompt_category from documents where text is not null)"
_Z = "case when chars = 0 or control_chars = 0 then null when {se} = 0 then 0.0 else (n::double / chars - control_n::double / control_chars) / {se} end".format(se="sqrt(((n + control_n)::double / (chars + control_chars)) * (1 - (n + control_n)::double / (chars + control_chars)) * (1.0 / nullif(chars, 0) + 1.0 / nullif(control_chars, 0)))")


@query(f"with {_BY_SOURCE}, {_PUNCT}, h as (select category, n as control_n, chars as control_chars from counted where grp = 'human_control') select grp, category, n, chars, control_n, control_chars, round({_Z}, 6) as z from counted join h using (category) where grp <> 'human_control' and category in ('comma', 'period', 'curly_quote', 'em_dash', 'semicolon')")
def punct_z(spark, folder):
    return lexical.punctuation_z(docs(spark, folder), _source(), _control())


@query()
def punct_p(spark, folder):
    return punct_z(spark, folder).withColumn("p_value", S.normal_p("z"))


@query(f"with {_BASE}, s as (select grp, unnest({D.sentences('text')}) as s from base where {PROSE_SQL}), l as (select grp, len({D.words('s')}) as x from s) select grp, {D.describe('x')} from l group by 1")
def sentence_stats(spark, folder):
    return lexical.sentence_statistics(docs(spark, folder).where(_prose()), _lang(), "doc_id")


_EDGES = [0, 5, 10, 20, 40, 1000]
_BIN_SQL = "case " + " ".join(f"when x >= {a} and x {'<=' if k == len(_EDGES) - 2 else '<'} {b} then {k}" for k, (a, b) in enumerate(zip(_EDGES, _EDGES[1:]))) + " end"


@query(f"with {_BASE}, s as (select grp, unnest({D.sentences('text')}) as s from base), l as (select grp, len({D.words('s')}) as x from s) select grp, {_BIN_SQL} as bin, count(*) as n from l group by 1, 2")
def sentence_histogram(spark, folder):
    x = lexical.sentence_lengths(docs(spark, folder), _lang(), "doc_id")
    return x.groupBy("grp", S.histogram_bin(F.col("words"), _EDGES).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_BASE}, c as (select grp, unnest({D.chars('text')}) as ch from base), n as (select grp, ch, count(*) as n from c group by 1, 2), b as (select grp, sum(n)::bigint as chars, sum(n * log2(n)) as s from n group by 1), g as (select distinct grp from base) select grp, coalesce(chars, 0) as chars, round(coalesce(log2(chars) - s / chars, 0.0), 6) as bits_per_char from g left join b using (grp)")
def entropy(spark, folder):
    return lexical.entropy(docs(spark, folder), _lang())


@query(f"with {_BASE}, {_WORDS} select grp, count(*) as n_words, count(distinct word) as vocab_size, round(avg(length(w)), 6) as mean_word_length, round(count(distinct word) / count(*), 6) as ttr from each group by 1")
def vocabulary(spark, folder):
    return lexical.vocabulary(docs(spark, folder), _lang())


@query(f"with {_BY_SOURCE}, {_WORDS}, p as (select grp, word, row_number() over (partition by grp order by doc, k) as idx from each), m as (select min(n) as n from (select count(*) as n from each where grp <> 'human_control' group by grp)) select grp, count(*) as n_words_used, count(distinct word) as vocab_size, round(count(distinct word) / count(*), 6) as ttr from p where idx <= (select n from m) group by 1")
def vocabulary_matched(spark, folder):
    return lexical.matched_vocabulary(docs(spark, folder), _source(), "doc_id", ~F.coalesce(_control(), F.lit(False)))


_TERMS = lexical.MARKER_TERMS


@query(f"with {_BASE}, {_WORDS}, t as (select grp, count(*) as words from each group by 1), f as (select grp, word as term, count(*) as n from each where word in ({', '.join(map(D.q, _TERMS))}) group by 1, 2), f2 as (select * from f union all select grp, 'COMBINED', sum(n)::bigint from f group by 1), g as (select grp, words, unnest([{', '.join(map(D.q, [*_TERMS, 'COMBINED']))}]) as term from t), r as (select grp, term, coalesce(n, 0)::bigint as n, words from g left join f2 using (grp, term)) select grp, term, n, words, {D.rates('n', 'words')} from r")
def marker_terms(spark, folder):
    return lexical.marker_rates(docs(spark, folder), _lang(), _TERMS)


@query(f"with p as (select prompt_id as prompt, coalesce(model_id, 'none') as grp, avg(len({D.words('text')})) as n from documents where text is not null and prompt_id is not null and not starts_with(coalesce(prompt_category, ''), 'repeat_of') group by 1, 2) select prompt, count(*) as groups, round(avg(n), 6) as mean, round(stddev_pop(n), 6) as sd from p group by 1")
def spread_across(spark, folder):
    d = docs(spark, folder).where(~F.coalesce("prompt_category", F.lit("")).startswith("repeat_of"))
    return lexical.spread_across(d, F.coalesce("model_id", F.lit("none")), F.col("prompt_id"))


@query(f"with p as (select coalesce(model_id, 'none') as grp, length_band as band, len({D.words('text')}) as x from documents where text is not null and length_band is not null) select grp, band, {D.describe('x')} from p group by 1, 2".replace(" as n, round", " as texts, round", 1))
def spread_within(spark, folder):
    return lexical.spread_within(docs(spark, folder), F.coalesce("model_id", F.lit("none")), F.col("length_band"))


_TYPO = D.count_of("text", "".join(chr(c) for c in [*range(0x2010, 0x2016), *range(0x2018, 0x2020), 0x2026, 0x2032, 0x2033]))


@query(f"with {_BY_SOURCE}, s as (select grp, 'all' as scope, text from base union all select grp, 'dialogue_only', text from base where prompt_category = 'quoted_speech') select grp, scope, count(*) as files, sum(length(text))::bigint as chars, sum({_TYPO})::bigint as typographic, round(1000.0 * sum({_TYPO}) / nullif(sum(length(text)), 0), 4) as per_1k from s group by 1, 2")
def typography_by_genre(spark, folder):
    return lexical.typography(docs(spark, folder), _source(), F.col("prompt_category") == "quoted_speech")


# --- ordered sequences ----------------------------------------------------------------------------------

_LAGS = ", ".join(map(str, sequence.LAGS))


_SENTENCE_PAIRS = f"s as (select doc_id as id, coalesce(lang, 'none') as grp, prompt_category, list_transform({D.sentences('text')}, lambda s: len({D.words('s')})) as x from documents where text is not null), e as (select id, grp, prompt_category, len(x) as n, x, unnest([{_LAGS}]) as lag from s), p as (select id, grp, prompt_category, n, lag, unnest(x[1:n - lag])::double as a, unnest(x[lag + 1:n])::double as b from e where n > lag + 5)"


@query(f"with {_SENTENCE_PAIRS} select id as doc_id, n, lag, round({D.pearson('a', 'b')}, 6) as r from p group by id, n, lag")
def autocorr_sentences(spark, folder):
    return sequence.lag_correlation(sequence.sentence_sequences(docs(spark, folder), "doc_id")).withColumnRenamed("id", "doc_id")


@query(f"with {_SENTENCE_PAIRS}, r as (select grp, id, lag, round({D.pearson('a', 'b')}, 6) as r from p where {PROSE_SQL} group by grp, id, lag) select grp, lag, count(r) as texts, round(avg(r), 5) as mean_r from r where r is not null group by grp, lag")
def autocorr_pooled(spark, folder):
    """Per group and lag: texts tested and their mean correlation."""
    seqs = sequence.sentence_sequences(docs(spark, folder).where(_prose()), "doc_id", "text", _lang().alias("grp"))
    each = sequence.lag_correlation(seqs.select(F.struct("id", "grp").alias("id"), "x")).where("r is not null")
    return each.groupBy("id.grp", "lag").agg(F.count("r").alias("texts"), F.round(F.avg("r"), 5).alias("mean_r"))


_JOINED_WORDS = f"w as (select grp, {D.words("string_agg(text, '' order by doc)")} as w from base group by grp), p as (select grp, list_transform(w, lambda x: length(x))::double[] as x, len(w) as n, unnest([{_LAGS}]) as lag from w)"


@query(f"with {_BASE}, {_JOINED_WORDS}, l as (select grp, n, lag, unnest(x[1:n - lag]) as a, unnest(x[lag + 1:n]) as b from p where n > lag + 20) select grp, n, lag, round({D.pearson('a', 'b')}, 6) as r from l group by 1, 2, 3")
def autocorr_words(spark, folder):
    return sequence.word_lag_correlation(docs(spark, folder), _lang(), "doc_id")


_GAPS = f"""with {_BASE}, off as (select grp, doc, text, coalesce(sum(length(text)) over (partition by grp order by doc rows between unbounded preceding and 1 preceding), 0) as off from base where text <> ''),
pos as (select grp, off + generate_subscripts({D.chars('text')}, 1) - 1 as idx, unnest({D.chars('text')}) as ch from off),
marks as (select 'comma' as marker, grp, idx from pos where ch = ',' union all select 'period', grp, idx from pos where ch = '.' union all select 'all_terminal_punct', grp, idx from pos where ch in ('.', '!', '?')),
gaps as (select * from (select marker, grp, idx, idx - lag(idx) over (partition by marker, grp order by idx) as gap from marks) where gap is not null)"""


@query(f"{_GAPS} select marker, grp, idx::bigint as place, gap::bigint as gap from gaps")
def marker_gaps(spark, folder):
    return sequence.marker_gaps(docs(spark, folder), _lang(), "doc_id")


@query(f"{_GAPS}, e as (select marker, grp, gap, unnest([{', '.join(map(str, sequence.PERIODS))}]) as k from gaps), o as (select marker, grp, k, gap % k as r, count(*) as o from e group by all), s as (select marker, grp, k, sum(o)::bigint as n_gaps, sum(o * o) as oo from o group by all) select marker, grp, k, n_gaps, case when n_gaps >= 5 * k then round(oo::double * k / n_gaps - n_gaps, 6) end as chi2 from s")
def gap_chi2(spark, folder):
    return sequence.gap_chi2(marker_gaps(spark, folder))


# --- resampling: rows only --------------------------------------------------------------------------------

def _sentence_values(rows: DataFrame) -> DataFrame:
    return lexical.sentence_lengths(rows, _source(), "doc_id").select("grp", F.struct("doc", "k").alias("at"), F.col("words").alias("x"))


@query()
def bootstrap_means(spark, folder):
    return resample.bootstrap_groups(_sentence_values(docs(spark, folder).where(_prose())))


@query()
def difference_tests(spark, folder):
    return resample.difference_tests(_sentence_values(docs(spark, folder).where(_prose())), "human_control")


def _dialogue_values(spark, folder) -> DataFrame:
    """Sentences of dialogue prompts of each source, and all of the control's."""
    quoted = (F.col("prompt_category") == "quoted_speech") & ~F.coalesce(_control(), F.lit(False))
    return _sentence_values(docs(spark, folder).where(quoted | _control()))


@query(f"with s as (select coalesce(source, 'none') as grp, unnest({D.sentences('text')}) as s from documents where text is not null and (source = 'human_control' or prompt_category = 'quoted_speech')), l as (select grp, avg(len({D.words('s')})) as m, count(*) as n from s group by 1), c as (select m from l where grp = 'human_control') select grp, n, round(l.m, 6) as mean, round(l.m - c.m, 6) as diff from l, c where grp <> 'human_control'")
def dialogue_means(spark, folder):
    """Mean sentence length of dialogue against the control's, of the counts that ``dialogue_tests`` tests."""
    means = _dialogue_values(spark, folder).groupBy("grp").agg(F.count("x").alias("n"), F.avg("x").alias("m"))
    control = means.where("grp = 'human_control'").select(F.col("m").alias("c"))
    return means.where("grp <> 'human_control'").crossJoin(F.broadcast(control)).select("grp", "n", F.round("m", 6).alias("mean"), F.round(F.col("m") - F.col("c"), 6).alias("diff"))


@query()
def dialogue_tests(spark, folder):
    return resample.difference_tests(_dialogue_values(spark, folder), "human_control")


@query()
def permutation_autocorr(spark, folder):
    seqs = sequence.sentence_sequences(docs(spark, folder).where(_prose()), "doc_id", "text", _lang().alias("grp"))
    return resample.lag_battery(seqs.withColumnRenamed("id", "doc_id"), sequence.LAGS)


@query()
def permutation_words(spark, folder):
    """The lag tests of each group's word lengths, over all of its words."""
    return resample.pair_battery(sequence.word_pairs(docs(spark, folder), _lang(), "doc_id"))


@query()
def gap_periodicity(spark, folder):
    return resample.gap_battery(marker_gaps(spark, folder), sequence.PERIODS)


def _batteries(spark, folder) -> DataFrame:
    """Every test of every battery as ledger rows, written once: the tests aren't run again for each figure of the ledger."""
    name = F.format_string
    tests = [
        ledger.log("autocorr", permutation_autocorr(spark, folder), name("autocorr_sentlen:%s:lag%s:%s", "grp", "lag", "doc_id")),
        ledger.log("words", permutation_words(spark, folder), name("autocorr_wordlen:%s:lag%s", "grp", "lag")),
        ledger.log("gaps", gap_periodicity(spark, folder), name("gap_mod:%s:%s:k%s", "marker", "grp", "k")),
        ledger.log("punctuation", punct_p(spark, folder), name("punct:%s:%s", "category", "grp")),
        ledger.log("dialogue", dialogue_tests(spark, folder), name("sentlen_dialogue:%s", "grp")),
    ]
    return materialise(functools.reduce(DataFrame.unionByName, tests), "ledger")


@query()
def battery_ledger(spark, folder):
    return ledger.summary(_batteries(spark, folder))


@query()
def battery_prefixes(spark, folder):
    """Tests, nominal hits and least p of each battery and group."""
    return ledger.by_prefix(_batteries(spark, folder))


# --- ledger -------------------------------------------------------------------------------------------------

def _ledger(spark, folder):
    return read_table(spark, folder, "test_ledger").select("name", "p_value", "min_attainable_p").distinct()


_LEDGER = "with l as (select distinct name, p_value, min_attainable_p from test_ledger), t as (select *, 0.05 / (select count(*) from l where p_value is not null) as b from l where p_value is not null)"


@query(f"{_LEDGER} select count(*) as n_tests, round(count(*) * 0.05::double, 6) as expected_false_positives, sum((p_value < 0.05)::int)::bigint as nominal, round(0.05::double / count(*), 12) as bonferroni_alpha, sum((p_value < b)::int)::bigint as survivors, sum((not coalesce(min_attainable_p < b, true))::int)::bigint as unresolvable from t")
def ledger_summary(spark, folder):
    return ledger.summary(_ledger(spark, folder))


@query(f"{_LEDGER} select regexp_extract(name, '^[^:]*(:[^:]*)?') as prefix, count(*) as n, sum((p_value < 0.05)::int)::bigint as nominal, min(p_value) as least_p from t group by 1")
def ledger_by_prefix(spark, folder):
    return ledger.by_prefix(_ledger(spark, folder))


@query(f"{_LEDGER} select name, p_value from t where p_value < 0.05")
def ledger_hits(spark, folder):
    return ledger.names(_ledger(spark, folder), "nominal")


# --- pairs of documents ----------------------------------------------------------------------------------------

_REPEATS = [("S01", "S10"), ("M01", "M10"), ("L01", "L10"), ("S11", "S20"), ("S21", "S30"), ("M11", "M20"), ("M21", "M30")]
_SET = f"list_distinct(list_transform({{words}}, lambda w: lower(w)))"


def _repeat_pairs(spark, folder):
    """A model's answers to prompts that repeat one another. A cell holds one text, as the published comparison has it: that of the least id with one."""
    m = manifest(spark, folder).where("kind = 'model_output'").select("sample_id", "model_slug", "prompt_id", "text")
    first = m.withColumn("item", records.clean_id(F.col("prompt_id"))).groupBy("model_slug", "item").agg(F.min(F.when(F.col("text").isNotNull(), F.struct("sample_id", "text"))).alias("x")).select("model_slug", "item", "x.text")
    pairs = spark.createDataFrame(_REPEATS, "item_a string, item_b string")
    return compare.repeat_pairs(first, pairs, ["model_slug"], "item")


_FLAGGED_SQL = "length(regexp_replace({t}, '[\\t\\n\\r\\x20-\\x7F]', '', 'g'))"
_REPEAT_SQL = f"""with m as (select model_slug, upper(trim(prompt_id)) as item, sample_id, any_value(text) as text from manifest where kind = 'model_output' group by 1, 2, 3), f as (select model_slug, item, arg_min(text, sample_id) filter (where text is not null) as text from m group by 1, 2),
pr as (select unnest([{', '.join(f"{{'a': '{a}', 'b': '{b}'}}" for a, b in _REPEATS)}], recursive := true)), fa as (select model_slug, a, b, text from f join pr on item = a), fb as (select model_slug, a, b, text from f join pr on item = b),
j as (select coalesce(fa.model_slug, fb.model_slug) as model_slug, coalesce(fa.a, fb.a) as item_a, coalesce(fa.b, fb.b) as item_b, fa.text as ta, fb.text as tb from fa full join fb on fa.model_slug = fb.model_slug and fa.a = fb.a and fa.b = fb.b),
w as (select *, coalesce(ta, '') as a, coalesce(tb, '') as b, {_SET.format(words=D.words("coalesce(ta, '')"))} as wa, {_SET.format(words=D.words("coalesce(tb, '')"))} as wb from j)"""


@query(f"{_REPEAT_SQL} select model_slug, item_a, item_b, case when ta is null or tb is null then 'incomplete' else 'complete' end as status, a = b as identical, length(a) as chars_a, length(b) as chars_b, {_FLAGGED_SQL.format(t='a')} as flagged_a, {_FLAGGED_SQL.format(t='b')} as flagged_b, round(len(list_intersect(wa, wb))::double / nullif(len(list_distinct(list_concat(wa, wb))), 0), 6) as word_jaccard from w")
def repeat_similarity(spark, folder):
    return compare.repeat_similarity(_repeat_pairs(spark, folder), ["model_slug"])


@query()
def repeat_flags(spark, folder):
    """The flagged characters of both texts by bucket."""
    p = _repeat_pairs(spark, folder)
    of = lambda side: F.to_json(scan.rate_counts(F.regexp_extract_all(F.coalesce(f"text_{side}", F.lit("")), F.lit(ODD), F.lit(0))))
    return p.select("model_slug", "item_a", "item_b", of("a").alias("flagged_a"), of("b").alias("flagged_b"))


@query()
def repeat_ratio(spark, folder):
    p = _repeat_pairs(spark, folder)
    return p.select("model_slug", "item_a", "item_b", compare.similarity_ratio("text_a", "text_b").alias("ratio"))


def _route_pairs(spark, folder):
    """Route outputs beside their sources, each probe and route once."""
    r = read_table(spark, folder, "route_results").select("probe_id", "sample_id", "route", "content").dropDuplicates(["probe_id", "route"])
    m = manifest(spark, folder).select("sample_id", F.unbase64("content_b64").alias("source")).dropDuplicates(["sample_id"])
    return r.join(m, "sample_id").select(F.concat_ws(":", "probe_id", "route").alias("id"), F.col("source").alias("a"), F.col("content").alias("b"))


@query()
def char_differences(spark, folder):
    return compare.differences(_route_pairs(spark, folder), "char")


@query()
def byte_differences(spark, folder):
    return compare.differences(_route_pairs(spark, folder), "byte")


_PAIRS_SQL = "with m as (select sample_id, any_value(from_base64(content_b64)) as source from manifest group by 1), r as (select probe_id, route, any_value(sample_id) as sample_id, any_value(content) as content from route_results group by 1, 2), p as (select probe_id || ':' || route as id, source as a, content as b from r join m using (sample_id))"


@query(f"{_PAIRS_SQL} select id, sha256(a) as sha256_a, sha256(b) as sha256_b, octet_length(a) as bytes_a, octet_length(b)::double as bytes_b, (sha256(a) = sha256(b))::varchar as byte_identical from p")
def pair_hashes(spark, folder):
    """``pair_comparison`` without the kinds of difference."""
    c = pair_comparison(spark, folder)
    return c.select("id", "sha256_a", "sha256_b", "bytes_a", F.col("bytes_b").cast("double").alias("bytes_b"), F.col("byte_identical").cast("string").alias("byte_identical"))


@query()
def pair_comparison(spark, folder):
    return compare.comparison(_route_pairs(spark, folder))


# --- routes, records, dimensions ----------------------------------------------------------------------------------

@query("select distinct r.probe_id, r.route, sha256(r.content) as sha256, octet_length(r.content)::double as bytes_len, (octet_length(r.content) - m.n)::double as byte_delta, (sha256(r.content) = m.sha)::varchar as identical_to_source from route_results r left join (select sample_id, any_value(sha256(from_base64(content_b64))) as sha, any_value(octet_length(from_base64(content_b64))) as n from manifest group by 1) m using (sample_id)")
def route_evaluation(spark, folder):
    r = read_table(spark, folder, "route_results")
    m = manifest(spark, folder).select(F.col("sample_id").alias("id"), F.unbase64("content_b64").alias("source")).dropDuplicates(["id"])
    keyed = r.select(F.concat_ws("|", "sample_id", "probe_id").alias("id"), "sample_id", "probe_id", "route", "content").distinct()
    sources = keyed.select(F.col("id").alias("key"), F.col("sample_id").alias("id")).distinct().join(m, "id", "left").select(F.col("key").alias("id"), "source")
    return routes.evaluate(keyed.select("id", "route", "content"), sources).select(F.substring_index("id", "|", -1).alias("probe_id"), "route", "sha256", F.col("bytes_len").cast("double").alias("bytes_len"), F.col("byte_delta").cast("double").alias("byte_delta"), F.col("identical_to_source").cast("string").alias("identical_to_source"))


_ROUTE_SQL = {"binary_write": "c", "shell_redirect": "c", "clipboard": "null::blob", "pty": "encode(replace(decode(c), chr(10), chr(13) || chr(10)))", "text_rewrite": "encode(decode(c))", "json_raw": "encode(json_extract_string(json_object('t', decode(c)), '$.t'))", "json_escaped": "encode(decode(c))"}


@query("with p as (select sample_id as id, any_value(from_base64(content_b64)) as c from manifest where decodes_as_utf8 group by 1) " + " union all ".join(f"select id, '{n}' as route, sha256({x}) as sha256, (octet_length({x}) - octet_length(c))::double as byte_delta, (sha256({x}) = sha256(c))::varchar as identical_to_source from p" for n, x in _ROUTE_SQL.items()))
def route_transforms(spark, folder):
    m = manifest(spark, folder).where("decodes_as_utf8").select(F.col("sample_id").alias("id"), F.unbase64("content_b64").alias("source")).dropDuplicates(["id"])
    return routes.evaluate(routes.run_routes(m, "id", "source"), m).select("id", "route", "sha256", F.col("byte_delta").cast("double").alias("byte_delta"), F.col("identical_to_source").cast("string").alias("identical_to_source"))


@query()
def probe_routes(spark, folder):
    p = routes.probes(spark)
    return routes.evaluate(routes.run_routes(p, "id", "content"), p.withColumnRenamed("content", "source"))


@query("select doc_id::varchar as sample_id, coalesce(source, 'none') as kind, sha256(text) as sha256, octet_length(encode(text))::bigint as bytes_len, to_base64(encode(text)) as content_b64, text, true as decodes_as_utf8, lang from documents where text is not null")
def manifest_records(spark, folder):
    d = docs(spark, folder).where("text is not null").withColumn("content", F.encode("text", "UTF-8"))
    return records.make_records(d, "doc_id", "content", "x", F.col("lang"), _source().alias("own")).withColumn("kind", F.col("own")).drop("own")


@query("with m as (select distinct sample_id, sha256, bytes_len, content_b64, text, decodes_as_utf8 from manifest) select count(*) as records, sum((not coalesce(sha256(from_base64(content_b64)) = sha256, false))::int)::bigint as bad_sha, sum((not coalesce(octet_length(from_base64(content_b64)) = bytes_len, false))::int)::bigint as bad_length, sum((not coalesce(case when decodes_as_utf8 then text = decode(from_base64(content_b64)) else text is null end, false))::int)::bigint as bad_text from m")
def manifest_verify(spark, folder):
    return records.violations(manifest(spark, folder).select("sample_id", "sha256", "bytes_len", "content_b64", "text", "decodes_as_utf8").distinct())


@query("select kind, count(*) as rows, count(distinct sample_id) as records from manifest group by 1")
def manifest_counts(spark, folder):
    return manifest(spark, folder).groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("sample_id").alias("records"))


@query("select m.sample_id, m.ingested_at, p.prompt_id, p.length_band, p.category, p.target_words from (select distinct sample_id, ingested_at, prompt_id from manifest where kind = 'model_output') m left join prompts p on upper(trim(m.prompt_id)) = p.prompt_id")
def manifest_prompts(spark, folder):
    m = manifest(spark, folder).where("kind = 'model_output'").select("sample_id", "ingested_at", "prompt_id").distinct()
    p = read_table(spark, folder, "prompts")
    joined = records.with_prompts(m, p.withColumn("own", F.col("prompt_id")))
    return joined.select("sample_id", "ingested_at", F.when(F.col("prompt_category_of").isNotNull(), records.clean_id(F.col("prompt_id"))).alias("prompt_id"), F.col("prompt_band").alias("length_band"), F.col("prompt_category_of").alias("category"), "target_words")


@query("select m.sample_id, m.control_id, coalesce(p.class, 'unknown') as control_class, coalesce(p.source, '') as control_source, coalesce(p.description, '') as control_description from (select distinct sample_id, control_id from manifest where kind = 'control') m left join provenance p on m.control_id = p.control_id")
def manifest_provenance(spark, folder):
    m = manifest(spark, folder).where("kind = 'control'").select("sample_id", "control_id").distinct()
    return records.with_provenance(m, read_table(spark, folder, "provenance"), "control_id").select("sample_id", "control_id", "control_class", "control_source", "control_description")


@query(f"with t as (select doc_id, coalesce(source, 'none') as grp, text from documents where text is not null) select doc_id, grp, length(text) as chars, octet_length(encode(text)) as bytes, {_FLAGGED_SQL.format(t='text')} as flagged, not regexp_matches(text, '[^\\x00-\\x7F]') as pure_ascii from t")
def file_flags(spark, folder):
    """The per-file part of a group's load: sizes, and how many flagged characters; their buckets are in the operator's map."""
    f = scan.file_flags(docs(spark, folder), "doc_id", "text", _source().alias("grp"))
    total = F.aggregate(F.map_values("flagged"), F.lit(0), lambda a, v: a + v)
    return f.select(F.col("id").alias("doc_id"), "grp", "chars", "bytes", total.alias("flagged"), "pure_ascii")


def analysis(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of an analysis document, for ``sinks.write_analysis`` and ``sinks.summary_text``."""
    return {name: _QUERIES[name](spark, folder) for name in ("bucket_rates", "file_flags", "ascii_violations", "typography_by_genre", "repeat_similarity", "pooled_hidden")}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
