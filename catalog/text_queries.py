"""Text, source, chunking and index queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import SETTINGS as S, snapshot
from catalog.sql import (
    any_in, fold, isnum, keep, norm, ordered_distinct, q, root_list, root_set, sentences, sql, squash, term_id,
    tokens, unicode_word, words,
)
from quarry.functions import text as T
from quarry.functions.budgets import output_token_budget, prompt_token_budget, server_predict_budget, sigmoid
from quarry.functions.intents import answer_profile
from quarry.operators import chunking, indexing
from quarry.operators.gates import query_gates
from quarry.operators.passages import windows
from quarry.rules import russian as ru
from quarry.session import ship_package
from quarry.sources import articles, tables
from quarry.sources.tables import documents_from_tables, queries_from_conversations, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            SQL[name] = oracle
        return fn

    return add


def L(c):
    return c.cast("long")


def joined(c, sort=True):
    return F.md5(F.array_join(F.array_sort(c) if sort else c, ","))


def sjoined(c: str, sort: bool = True) -> str:
    return f"md5(array_to_string({'list_sort(' + c + ')' if sort else c},','))"


#: Questions derived from the user turns so that every gate and rewriting rule meets rows.
ASKED = (
    "{q}", "Привет!", "Как ты?", "Здравствуйте, как дела?", "Хорошо, спасибо!", "до свидания", "Что ты умеешь?", "помоги",
    "Какая погода: {q}", "Курс доллара, {q}", "Рецепт {q}", "Результат матча {q}", "Кто президент {q}",
    "Сколько будет 7 и 8 {q}", "{q} 7 * 8", "Как это оформить?", "Какой срок?", "Подскажите, пожалуйста, {q}",
    "Как выписать наряд на опасные работы {q}", "Наряд допуск на опасные работы", "Наряд  допуск и опасная работа: {q}",
    "Что нужно делать если увидел дым", "Возгорание {q}", "Возгорание и пожар",
)


def filled(templates, pick: str, text: str = "text") -> tuple[str, object]:
    """`text` put into the template that `pick` numbers: as SQL and as a function that makes the column."""
    def column():
        template = F.element_at(F.array(*[F.lit(t) for t in templates]), (F.expr(pick) + 1).cast("int"))
        return F.replace(template, F.lit("{q}"), F.col(text))

    return f"replace([{','.join(q(t) for t in templates)}][({pick})+1],'{{q}}',{text})", column


_asked, _asked_col = filled(ASKED, f"(conv_id*7+turn)%{len(ASKED)}")
ASKED_TURNS = f"(SELECT conv_id*1000+turn AS qid, {_asked} AS query FROM conversations WHERE role='user')"


def asked_turns(spark, d):
    turns = read(spark, d, "conversations").filter("role = 'user'")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), _asked_col().alias("query"))


TURNS = "(SELECT conv_id*1000+turn AS qid, text AS query FROM conversations WHERE role='user')"


@query("tok_counts", f"""
SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct
FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)""")
def _(spark, d):
    t = T.tokens(F.col("text"))
    return read(spark, d, "documents").select(
        "doc_id", L(F.size(t)).alias("n_tokens"), L(F.size(F.array_distinct(t))).alias("n_distinct"))


@query("lexical_roots", f"""
SELECT doc_id, len(r)::BIGINT AS n_roots, {sjoined('r', False)} AS roots_md5
FROM (SELECT doc_id, {root_list('text')} AS r FROM documents)""")
def _(spark, d):
    r = T.root_list(F.col("text"))
    return read(spark, d, "documents").select(
        "doc_id", L(F.size(r)).alias("n_roots"), joined(r, False).alias("roots_md5"))


@query("stem_document_frequency", f"""
SELECT root, count(*)::BIGINT AS df FROM (SELECT DISTINCT doc_id, unnest({root_list('text')}) AS root FROM documents)
GROUP BY 1""")
def _(spark, d):
    return read(spark, d, "documents").select(
        F.explode(F.array_distinct(T.root_list(F.col("text")))).alias("root")
    ).groupBy("root").agg(L(F.count("*")).alias("df"))


@query("context_root_sets", f"""
SELECT doc_id, len(r)::BIGINT AS n_roots, {sjoined('r')} AS roots_md5
FROM (SELECT doc_id, {root_set('text')} AS r FROM documents)""")
def _(spark, d):
    r = T.root_set(F.col("text"))
    return read(spark, d, "documents").select(
        "doc_id", L(F.size(r)).alias("n_roots"), joined(r).alias("roots_md5"))


_cr = root_list("query", ru.PLANNER_STOP)


@query("query_roots", f"""
SELECT qid, array_to_string(c,' ') AS content_roots,
       array_to_string(list_filter(c, lambda t: NOT list_contains({words(ru.GENERIC_ROOTS)},t)),' ') AS specific_roots
FROM (SELECT qid, {ordered_distinct('r')} AS c FROM (SELECT qid, {_cr} AS r FROM {TURNS}))""")
def _(spark, d):
    c = F.col("query")
    return queries_from_conversations(spark, d).select(
        "qid", F.array_join(T.content_roots(c), " ").alias("content_roots"),
        F.array_join(T.specific_roots(c), " ").alias("specific_roots"))


@query("gate_tokens", f"""
SELECT qid, len(t)::BIGINT AS n, {sjoined('t')} AS tokens_md5
FROM (SELECT qid, list_distinct({keep('query', ru.GATE_STOP)}) AS t FROM {TURNS})""")
def _(spark, d):
    t = T.gate_tokens(F.col("query"))
    return queries_from_conversations(spark, d).select(
        "qid", L(F.size(t)).alias("n"), joined(t).alias("tokens_md5"))


@query("rewrite_terms", f"""
SELECT qid, {sjoined('t')} AS terms_md5, len(t)::BIGINT AS n FROM (
  SELECT qid, list_distinct(list_transform(list_filter(regexp_extract_all(lower(query),'[0-9a-zа-яё]+'),
    lambda t: length(t)>=4 AND NOT list_contains({words(ru.REWRITE_STOP)},t)), lambda t: left(t,5))) AS t FROM {TURNS})""")
def _(spark, d):
    t = T.rewrite_terms(F.col("query"))
    return queries_from_conversations(spark, d).select(
        "qid", joined(t).alias("terms_md5"), L(F.size(t)).alias("n"))


def _sruns(n):
    return f"list_transform(range(1,length(s)-{n}+2), lambda i: substr(s,i,{n}))"


@query("acronym_candidates", f"""
SELECT qid, {sjoined('a')} AS acronyms_md5, len(a)::BIGINT AS n FROM (
  SELECT qid, list_distinct(list_concat({_sruns(3)},{_sruns(4)},{_sruns(5)})) AS a FROM (
    SELECT qid, array_to_string(list_transform(list_filter(regexp_extract_all(replace(lower(query),'ё','е'),'[0-9a-zа-я]+'),
      lambda t: length(t)>=3 AND NOT {isnum('t')} AND NOT list_contains({words(ru.CONTEXT_STOP)},t)),
      lambda t: left(t,1)),'') AS s FROM {TURNS}))""")
def _(spark, d):
    a = T.acronym_candidates(F.col("query"))
    return queries_from_conversations(spark, d).select(
        "qid", joined(a).alias("acronyms_md5"), L(F.size(a)).alias("n"))


def s_anchors(x: str) -> str:
    # `\\b` of RE2 is ASCII-only: non-ASCII letters are first mapped to a digit-free ASCII
    # word character that no pattern may contain ('_' doubled), see `mask`
    return f"""list_distinct(list_concat(
      list_transform(list_filter(string_split({mask(x)},' '), lambda t: regexp_full_match(t,'[A-Za-z][A-Za-z0-9_-]{{2,}}')), lambda t: {fold('t')}),
      list_transform(list_filter(string_split({runs(x)},' '), lambda t: regexp_full_match(t,'[А-ЯЁA-Z]{{2,8}}')), lambda t: {fold('t')}),
      list_filter(string_split({runs(x)},' '), lambda t: regexp_full_match(t,'[0-9]{{2,}}')),
      list_transform(list_filter(regexp_extract_all({x},'[A-Za-zА-Яа-яЁё0-9_-]+')[2:], lambda t: length(t)>=4
        AND regexp_matches(t,'^[A-ZА-ЯЁ]') AND regexp_matches(t,'[a-zа-яё]')), lambda t: {fold('t')})))"""


def runs(x: str) -> str:
    return rf"regexp_replace({x},'[^\p{{L}}\p{{N}}_]+',' ','g')"


def mask(x: str) -> str:
    """Maximal `[\\w-]` runs, hyphens trimmed from both ends."""
    return rf"regexp_replace(regexp_replace({x},'[^\p{{L}}\p{{N}}_-]+',' ','g'),'(^| )-+|-+( |$)',' ','g')"


@query("hard_anchors", f"SELECT qid, {sjoined('a')} AS anchors_md5, len(a)::BIGINT AS n FROM (SELECT qid, {s_anchors('query')} AS a FROM {TURNS})")
def _(spark, d):
    a = T.hard_anchors(F.col("query"))
    return queries_from_conversations(spark, d).select(
        "qid", joined(a).alias("anchors_md5"), L(F.size(a)).alias("n"))


@query("numbers", f"""
SELECT doc_id, len(n)::BIGINT AS n, {sjoined('n')} AS numbers_md5 FROM (
  SELECT doc_id, list_distinct(list_filter(string_split({runs('text')},' '), lambda t: regexp_full_match(t,'[0-9]{{2,}}'))) AS n
  FROM documents)""")
def _(spark, d):
    n = T.numbers(F.col("text"))
    return read(spark, d, "documents").select(
        "doc_id", L(F.size(n)).alias("n"), joined(n).alias("numbers_md5"))


@query("sentences", f"""
SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s,chr(30))) AS sentences_md5
FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)""")
def _(spark, d):
    s = T.sentences(F.col("text"))
    return read(spark, d, "documents").select(
        "doc_id", L(F.size(s)).alias("n"), F.md5(F.array_join(s, "\x1e")).alias("sentences_md5"))


@query("normalized_whitespace", f"SELECT doc_id, md5({norm('text')}) AS text_md5 FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.norm(F.col("text"))).alias("text_md5"))


_polite = "(?i)" + ru.POLITE_PREFIX
_n, _w = r"[^\p{L}\p{N}_]", r"[\p{L}\p{N}_]"


def edged(x: str, pattern: str, to: str, every: str = "'g'") -> str:
    """Replace whole words, Unicode word edges spelled out for RE2."""
    return f"regexp_replace({x},'(?i)(^|{_n})(?:{pattern})($|{_n})','\\1{to}\\2'{',' + every if every else ''})"


@query("normalized_queries", rf"""
SELECT qid, CASE WHEN {unicode_word(fold('d'), 'огонь|огня|дым|дыма')} AND regexp_matches({fold('d')},{q(ru.FIRE_ACTION)}) THEN {q(ru.FIRE_QUERY)}
    WHEN {unicode_word(fold('d'), 'возгоран' + _w + '*')} AND NOT ends_with({fold('d')},' пожар') THEN d||' пожар' ELSE d END AS normalized FROM (
  SELECT qid, CASE WHEN contains(lower(v),'наряд-допуск')
      THEN {edged('v', f'опасн{_w}*[ ]+работ{_w}*|работ{_w}*[ ]+опасн{_w}*', ru.DANGEROUS_WORK_CANONICAL)} ELSE v END AS d FROM (
  SELECT qid, {edged('w', 'выпис(?:ать|ывают|ывается)', ru.ISSUE_VERB_CANONICAL)} AS v FROM (
  SELECT qid, CASE WHEN NOT contains(lower(p),'наряд-допуск') AND regexp_matches(p,'(?i)(^|{_n})наряд({_n}|{_n}.*{_n})(?:опасн|повышенн)')
      THEN {edged('p', 'наряд', ru.WORK_PERMIT, '')} ELSE p END AS w FROM (
  SELECT qid, {edged("(CASE WHEN n='' THEN s ELSE n END)", 'наряд[ ]+допуск', ru.WORK_PERMIT)} AS p FROM (
    SELECT qid, s, trim(regexp_replace(s, {q(_polite)}, ''), ' ,') AS n
    FROM (SELECT qid, {squash('query')} AS s FROM {ASKED_TURNS}))))))""")
def _(spark, d):
    return asked_turns(spark, d).select("qid", T.normalize_query(F.col("query")).alias("normalized"))


@query("cache_keys", rf"""
SELECT qid, trim(regexp_replace(replace(lower(query),'ß','ss'),'[\s\p{{Z}}\x{{85}}]+',' ','g'),' .!?'||chr(9)||chr(10)||chr(13)) AS cache_key
FROM {TURNS}""")
def _(spark, d):
    return queries_from_conversations(spark, d).select("qid", T.cache_key(F.col("query")).alias("cache_key"))


@query("citation_ids", r"""
SELECT doc_id, array_to_string(list_transform(list_filter(x, lambda v,i: list_position(x,v)=i), lambda n: 'S'||n),',') AS ids,
       regexp_replace(a,'\[\s*[SsСс]\s*(\d+)\s*\]','[S\1]','g') AS canonical FROM (
  SELECT *, regexp_extract_all(a,'\[\s*[SsСс]\s*(\d+)\s*\]',1) AS x FROM (
    SELECT doc_id, text||' [S'||(doc_id%5+1)||'] and [ с '||(doc_id%3+1)||' ] [s2]' AS a FROM documents))""")
def _(spark, d):
    a = F.concat("text", F.lit(" [S"), F.col("doc_id") % 5 + 1, F.lit("] and [ с "), F.col("doc_id") % 3 + 1, F.lit(" ] [s2]"))
    return read(spark, d, "documents").select("doc_id", a.alias("a")).select(
        "doc_id", F.array_join(T.source_ids(F.col("a")), ",").alias("ids"), T.canonical_citations(F.col("a")).alias("canonical"))


@query("model_output_cleanup", "SELECT doc_id, md5(trim(text, ' '||chr(9)||chr(10)||chr(13))) AS clean_md5 FROM documents")
def _(spark, d):
    raw = F.concat(F.lit("<think>draft "), F.col("source"), F.lit("</think>\n```json\n"), F.col("text"), F.lit("\n```"))
    return read(spark, d, "documents").select("doc_id", F.md5(T.strip_model_markup(raw)).alias("clean_md5"))


@query("question_echo", rf"""
SELECT qid, trim(query, ' '||chr(9)||chr(10)||chr(13)) AS answer FROM {TURNS}""")
def _(spark, d):
    # the reply repeats the question, then answers with the same words
    c = F.col("query")
    echoed = F.concat(T.strip(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(": "), c)
    return queries_from_conversations(spark, d).select("qid", T.strip_question_echo(echoed, c).alias("answer"))


@query("abstentions", f"""
SELECT qid, contains(n,{q(ru.ABSTAIN_MARKER)}) OR regexp_matches(n,{q(ru.ABSTAIN_PATTERNS[0])}) OR regexp_matches(n,{q(ru.ABSTAIN_PATTERNS[1])}) AS abstained
FROM (SELECT qid, {norm("query || CASE WHEN length(query)%3=2 THEN ' Ответ найден.' WHEN length(query)%2=0 THEN ' Недостаточно данных.' ELSE ' В источниках нет информации' END")} AS n FROM {TURNS})""")
def _(spark, d):
    extra = F.when(F.length("query") % 3 == 2, " Ответ найден.").when(F.length("query") % 2 == 0, " Недостаточно данных.").otherwise(" В источниках нет информации")
    return queries_from_conversations(spark, d).select("qid", T.abstained(F.concat("query", extra)).alias("abstained"))


@query("stream_pieces", sql("""
SELECT doc_id, count(DISTINCT g)::BIGINT AS n_pieces, sum(n)::BIGINT AS chars FROM r_stream GROUP BY 1""", *[])
    .replace("SELECT doc_id, count", r"""WITH RECURSIVE p AS MATERIALIZED (
  SELECT doc_id, unnest(x) AS piece, generate_subscripts(x,1) AS i FROM
    (SELECT doc_id, regexp_extract_all(text,'[^\s\p{Z}\x{85}]+[\s\p{Z}\x{85}]*') AS x FROM documents)),
r_stream AS (
  SELECT doc_id, i, 1 AS g, length(piece) AS cur, length(piece) AS n FROM p WHERE i=1
  UNION ALL
  SELECT p.doc_id, p.i, CASE WHEN r.cur+length(p.piece)>48 THEN r.g+1 ELSE r.g END,
         CASE WHEN r.cur+length(p.piece)>48 THEN length(p.piece) ELSE r.cur+length(p.piece) END, length(p.piece)
  FROM r_stream r JOIN p ON p.doc_id=r.doc_id AND p.i=r.i+1)
SELECT doc_id, count""", 1))
def _(spark, d):
    pieces = T.split_stream_pieces(F.col("text"), S.token_chunk_chars)
    return read(spark, d, "documents").select("doc_id", F.posexplode(pieces).alias("seq", "piece")).groupBy("doc_id").agg(
        L(F.count("*")).alias("n_pieces"), L(F.sum(F.length("piece"))).alias("chars"))


@query("sigmoid", "SELECT event_id, round(1/(1+exp(-(value-10)/3)),6) AS p FROM events")
def _(spark, d):
    return read(spark, d, "events").select("event_id", F.round(sigmoid((F.col("value") - 10) / 3), 6).alias("p"))


@query("token_budgets", """
SELECT event_id,
  greatest(220, floor(p*greatest(2.0, 20.0-w/greatest(1.0,v)-1.5)*0.9))::BIGINT AS prompt_tokens,
  greatest(least(160,w), least(w, floor(v*greatest(1.0, 20.0-n/greatest(1.0,p)-1.5)*0.9)))::BIGINT AS output_tokens,
  least(17500, greatest(1000, trunc((v-0.75)*1000)))::BIGINT AS predict_ms
FROM (SELECT event_id, value AS v, value*6 AS p, (event_id%900+1) AS n, 60+event_id%841 AS w FROM events)""")
def _(spark, d):
    e = read(spark, d, "events").select("event_id", F.col("value").alias("v"), (F.col("value") * 6).alias("p"), (F.col("event_id") % 900 + 1).alias("n"), (F.col("event_id") % 841 + 60).alias("w"))
    want, t = F.col("w"), F.lit(20.0)
    return e.select(
        "event_id",
        prompt_token_budget(want, t, F.col("p"), F.col("v"), S).alias("prompt_tokens"),
        output_token_budget(want, t, F.col("n"), F.col("p"), F.col("v"), S).alias("output_tokens"),
        server_predict_budget(F.col("v"), S).alias("predict_ms"))


@query("throughput_medians", """
SELECT event_type, count(*)::BIGINT AS samples, round(median(value),6) AS median_tps,
  CASE WHEN median(value)>=10 THEN 'strong' WHEN median(value)>=6 THEN 'borderline' ELSE 'short-answer profile recommended' END AS guidance
FROM events GROUP BY 1""")
def _(spark, d):
    from quarry.operators.telemetry import throughput_medians
    return throughput_medians(read(spark, d, "events").select(F.col("event_type").alias("model"), F.col("value").alias("tps"))).withColumnRenamed("model", "event_type")


@query("ema_throughput", """
WITH RECURSIVE o AS MATERIALIZED (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE value>0),
r_e AS (SELECT user_id, i, 0.35*value+0.65*10.0::DOUBLE AS ema FROM o WHERE i=1
  UNION ALL SELECT o.user_id, o.i, 0.35*o.value+0.65*r.ema FROM r_e r JOIN o ON o.user_id=r.user_id AND o.i=r.i+1)
SELECT user_id, count(*)::BIGINT AS samples, round(arg_max(ema,i),6) AS decode_tps FROM r_e GROUP BY 1""")
def _(spark, d):
    from quarry.operators.telemetry import ema_throughput
    return ema_throughput(read(spark, d, "events").select(F.col("user_id").alias("model"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("tps")), S).select(
        F.col("model").alias("user_id"), "samples", F.round("tps", 6).alias("decode_tps"))


# --- sources --------------------------------------------------------------------------

_ent = "x"
for _k, _v in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _ent = f"replace({_ent},'{_k}','{_v}')"
_tags = "|".join(sorted(articles.BLOCK_TAGS))


@query("html_text", rf"""
SELECT page_id, length(t)::BIGINT AS n_chars, md5(t) AS text_md5 FROM (
  SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace({_ent.replace('x', 'x2')},'[ \t\r\f\v]+',' ','g'),' *\n *',chr(10),'g'),'\n{{3,}}',chr(10)||chr(10),'g'),' '||chr(10)) AS t FROM (
  SELECT page_id, {_ent} AS x2 FROM (
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,'(?is)<!--.*?-->|<!doctype[^>]*>','','g'),'(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>','','g'),
      '(?i)</?({_tags})(\s[^>]*)?/?>',chr(10),'g'),'</?[a-zA-Z][^>]*>','','g') AS x FROM pages)))""")
def _(spark, d):
    t = articles.markup_text(F.col("html"))
    return read(spark, d, "pages").select("page_id", t.alias("t")).select(
        "page_id", L(F.length("t")).alias("n_chars"), F.md5("t").alias("text_md5"))


_tidy = r"trim(regexp_replace(regexp_replace(regexp_replace({},'[ \t\r\f\v]+',' ','g'),' *\n *',chr(10),'g'),'\n{{3,}}',chr(10)||chr(10),'g'),' '||chr(10))"


@query("block_text", f"""
SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS text_md5 FROM (
  SELECT doc_id, {_tidy.format("'header'||chr(10)||source||' & '||lang||chr(10)||CASE WHEN x='' THEN '' ELSE x||chr(10) END||doc_id||chr(10)||chr(10)||'<i>'")} AS t
  FROM (SELECT doc_id, source, coalesce(lang,'-') AS lang, {_tidy.format('text')} AS x FROM documents))""")
def _(spark, d):
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;amp;")), F.lit("<"), F.lit("&lt;"))
    block = F.struct(F.lit("header").alias("type"), F.struct(
        F.array(F.concat("doc_id", F.lit("<br/> &lt;i&gt;"))).alias("items"),
        F.concat(F.lit("<b>"), "source", F.lit("</b> &amp; "), F.coalesce("lang", F.lit("-"))).alias("text"),
        F.concat(F.lit("<p>"), escaped, F.lit("</p><script>no</script>")).alias("caption")).alias("data"))
    raw = F.to_json(F.struct(F.lit(1).alias("version"), F.array(block).alias("blocks")))
    t = articles.content_text(F.col("raw"), F.lit("EditorJS"))
    return read(spark, d, "documents").select("doc_id", raw.alias("raw")).select("doc_id", t.alias("t")).select(
        "doc_id", L(F.length("t")).alias("n_chars"), F.md5("t").alias("text_md5"))


@query("kb_documents", sql("SELECT doc_seq, doc_id, title, section, section_id, md5(content) AS content_md5, url FROM docs_in", "docs_in"))
def _(spark, d):
    return tables.actual_documents(documents_from_tables(spark, d)).select(
        "doc_seq", "doc_id", "title", "section", "section_id", F.md5("content").alias("content_md5"), "url")


@query("article_merge", """
SELECT d.doc_id AS id, coalesce('kb-'||l.quality, source) AS section, lang AS name,
       CASE WHEN l.quality=0 THEN 'archive' ELSE 'public' END AS status
FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id=d.doc_id""")
def _(spark, d):
    summaries = read(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("section"), F.col("lang").alias("name"), F.lit("public").alias("status"))
    details = read(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("qy")).select(
        F.col("doc_id").alias("id"), F.concat(F.lit("kb-"), F.col("qy")).alias("section"),
        F.when(F.col("qy") == 0, "archive").otherwise("public").alias("status"))
    return articles.merge_articles(summaries, details).select("id", "section", "name", "status")


@query("timestamps", """
SELECT event_id, strftime(CASE WHEN event_type='error' THEN TIMESTAMP '1970-01-01' ELSE ts END,'%Y-%m-%d %H:%M:%S') AS updated_at FROM events""")
def _(spark, d):
    # error rows carry an unreadable timestamp text
    raw = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return read(spark, d, "events").select(
        "event_id", F.date_format(articles.parse_timestamp(raw), "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


_request, _request_col = filled(("{q}", " \t ", "{q}" + "x" * 16_001, "{q}", " {q} "), "(conv_id*7+turn)%5")
_trace = "CASE WHEN (conv_id*7+turn)%5=3 THEN repeat('я',65+turn) ELSE 't' END"


@query("request_limits", f"""
SELECT qid, greatest(1,least(CASE WHEN k=0 THEN 5 ELSE k END,5))::BIGINT AS top_k, greatest(0,section)::BIGINT AS section_id,
  CASE WHEN r='' THEN 'query must not be empty' WHEN length(r)>16000 THEN 'query must not exceed 16000 characters'
       WHEN strlen(trace)>128 THEN 'trace_id must not exceed 128 bytes' END AS error FROM (
  SELECT conv_id*1000+turn AS qid, turn*3-2 AS k, conv_id%7-3 AS section, {_trace} AS trace,
    trim({_request},' '||chr(9)||chr(10)||chr(13)) AS r FROM conversations)""")
def _(spark, d):
    from quarry.plans.service import validate_requests
    req = read(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), _request_col().alias("query"),
        (F.col("turn") * 3 - 2).cast("int").alias("top_k"), (F.col("conv_id") % 7 - 3).cast("int").alias("section_id"),
        F.expr(_trace).alias("trace_id"))
    return validate_requests(req, S).select("qid", L(F.col("top_k")).alias("top_k"), L(F.col("section_id")).alias("section_id"), "error")


# --- chunking ----------------------------------------------------------------------------


@query("chunks", sql("SELECT idx, doc_id, chunk_number::BIGINT AS chunk_number, chunk_id, length(text)::BIGINT AS n_chars, md5(text) AS text_md5 FROM chunks", "chunks"))
def _(spark, d):
    ship_package(spark)
    docs = tables.actual_documents(documents_from_tables(spark, d))
    return chunking.chunk_documents(docs, S).select(
        "idx", "doc_id", L(F.col("chunk_number")).alias("chunk_number"), "chunk_id",
        L(F.length("text")).alias("n_chars"), F.md5("text").alias("text_md5"))


@query("simple_chunks", r"""
WITH RECURSIVE l AS MATERIALIZED (
  SELECT doc_id, b, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM (
    SELECT doc_id, pos, trim(regexp_replace(line,'[ \t\r\f\v]+',' ','g')) AS b FROM (
      SELECT doc_id, unnest(string_split(text,chr(10))) AS line, generate_subscripts(string_split(text,chr(10)),1) AS pos FROM documents)) WHERE b<>''),
r_p AS (SELECT doc_id, i, 1 AS c, length(b) AS cur FROM l WHERE i=1
  UNION ALL SELECT l.doc_id, l.i, CASE WHEN r.cur+1+length(b)>700 THEN r.c+1 ELSE r.c END,
    CASE WHEN r.cur+1+length(b)>700 THEN length(b) ELSE r.cur+1+length(b) END
  FROM r_p r JOIN l ON l.doc_id=r.doc_id AND l.i=r.i+1)
SELECT doc_id::VARCHAR AS doc_id, c::BIGINT AS chunk_number, md5(string_agg(b,' ' ORDER BY i)) AS text_md5 FROM r_p JOIN l USING (doc_id,i) GROUP BY 1,2""")
def _(spark, d):
    docs = documents_from_tables(spark, d)
    return chunking.simple_chunks(docs, 700).select("doc_id", L(F.col("chunk_number")).alias("chunk_number"), F.md5("text").alias("text_md5"))


def window_sql(keys: str, text: str, source: str) -> str:
    """(keys, k, w_start, w_end, p): overlapping windows of `text`, cut at blanks."""
    count = "range(0,CASE WHEN length(t)<=500 THEN 1 ELSE CAST(ceil((length(t)-500)/350.0) AS BIGINT)+1 END)"
    return rf"""
SELECT {keys}, k::BIGINT AS k, s::BIGINT AS w_start, e::BIGINT AS w_end, trim(substr(t,s+1,e-s)) AS p FROM (
  SELECT *, CASE WHEN raw_end<n AND strpos(back,' ')>0 AND back_lo+length(back)-strpos(back,' ')>s THEN back_lo+length(back)-strpos(back,' ') ELSE raw_end END AS e FROM (
    SELECT *, reverse(substr(t,back_lo+1,raw_end-back_lo)) AS back FROM (
      SELECT *, greatest(s,raw_end-40) AS back_lo FROM (
        SELECT *, CASE WHEN raw>0 AND strpos(substr(t,raw+1,least(40,n-raw)),' ')>0 THEN raw+strpos(substr(t,raw+1,least(40,n-raw)),' ') ELSE raw END AS s, least(raw+500,n) AS raw_end FROM (
          SELECT {keys}, t, length(t) AS n, unnest({count}) AS k, unnest({count})*350 AS raw
          FROM (SELECT {keys}, {text} AS t FROM {source}) WHERE t<>'')))))
WHERE trim(substr(t,s+1,e-s))<>''"""


@query("passage_windows", f"SELECT doc_id, k, w_start, w_end, md5(p) AS text_md5 FROM ({window_sql('doc_id', squash('text'), 'documents')})")
def _(spark, d):
    w = windows(F.col("text"), S.passage_window_chars, S.passage_overlap_chars)
    return read(spark, d, "documents").select("doc_id", F.explode(w).alias("w")).select(
        "doc_id", L(F.col("w.k")).alias("k"), L(F.col("w.start")).alias("w_start"), L(F.col("w.end")).alias("w_end"),
        F.md5("w.text").alias("text_md5"))


# --- index -----------------------------------------------------------------------------------


@query("index_manifest", sql("""
SELECT (SELECT count(*) FROM docs_in)::BIGINT AS document_count, (SELECT count(*) FROM chunks)::BIGINT AS chunk_count,
  'hashing' AS embedding_backend, 768::BIGINT AS embedding_dimension""", "docs_in", "chunks"))
def _(spark, d):
    snap = snapshot(spark, d)
    m = snap.manifest
    counts = snap.table("chunks").agg(L(F.countDistinct("doc_id")).alias("document_count"), L(F.count("*")).alias("chunk_count"))
    return counts.withColumn("embedding_backend", F.lit(m["embedding_backend"])).withColumn(
        "embedding_dimension", F.lit(m["embedding_dimension"]).cast("long"))


@query("corpus_fingerprint", sql("""
SELECT count(*)::BIGINT AS rows, sha256(concat_ws(':',
""" + ",".join(f"sum(('0x'||substr(h,{1 + 8 * i},8))::UBIGINT)::DECIMAL(20,0)::VARCHAR" for i in range(4)) + """)) AS corpus_hash
FROM (SELECT sha256(chunk_id||chr(31)||text) AS h FROM chunks)""", "chunks"))
def _(spark, d):
    return indexing.corpus_hash(snapshot(spark, d).table("chunks")).withColumn("rows", L(F.col("rows")))


@query("term_vocabulary", sql("SELECT family, term_id, df::BIGINT AS df, total::BIGINT AS total, round(idf,6) AS idf FROM vocab", "vocab"))
def _(spark, d):
    return snapshot(spark, d).table("vocab").select("family", "term_id", "df", "total", F.round("idf", 6).alias("idf"))


@query("chunk_norms", sql("SELECT idx, round(word_norm,6) AS word_norm, round(char_norm,6) AS char_norm FROM norms", "norms"))
def _(spark, d):
    return snapshot(spark, d).table("norms").select(
        "idx", F.round("word_norm", 6).alias("word_norm"), F.round("char_norm", 6).alias("char_norm"))


@query("document_roots", sql("SELECT doc_id, root, n FROM doc_roots", "doc_roots"))
def _(spark, d):
    return snapshot(spark, d).table("doc_roots").select("doc_id", "root", L(F.col("n")).alias("n"))


@query("hashed_embedding", sql("SELECT idx, count(*)::BIGINT AS n, round(sum(w),6) AS total, round(sum(w*bucket),4) AS moment, round(sum(w*w),6) AS norm2 FROM dvec GROUP BY 1", "dvec"))
def _(spark, d):
    from quarry.operators.profiles import dense_entries
    w = F.col("weight")
    return dense_entries(snapshot(spark, d).table("profiles"), S.embedding_dimension).groupBy("idx").agg(
        L(F.count("*")).alias("n"), F.round(F.sum(w), 6).alias("total"),
        F.round(F.sum(w * F.col("bucket")), 4).alias("moment"), F.round(F.sum(w * w), 6).alias("norm2"))


# --- query gates and profiles ------------------------------------------------------------------

_spec = f"list_filter(c, lambda t: NOT list_contains({words(ru.GENERIC_ROOTS)},t))"


_direct = " ".join(f"WHEN regexp_full_match({squash('query')},{q('(?i)' + p)}) THEN {q(reason)}" for p, _, reason in ru.DIRECT_PATTERNS)
_outside = " ".join(f"WHEN {rule} THEN '{reason}'" for rule, reason in (
    (unicode_word("query", rf"(?i:погода|прогноз\s+погоды|температур{_w}*\s+(?:на\s+улице|снаружи))"), "external_weather"),
    (unicode_word("query", rf"(?i:курс\s+(?:доллар{_w}*|евро|валют{_w}*))"), "external_currency"),
    (unicode_word("query", r"(?i:рецепт|приготовить|как\s+готовить)"), "external_recipe"),
    (unicode_word("query", r"(?i:матч|счет\s+матча|результат\s+матча)"), "external_sports"),
    (rf"regexp_matches(query,'(?i)(^|{_n})(?:кто\s+президент|президент\s+[а-яa-z])')", "external_current_affairs"),
    (rf"regexp_matches(query,'(?i)(^|{_n})сколько\s+будет{_n}.*[0-9]|[0-9]\s*[+*/=]\s*[0-9]')", "external_arithmetic"),
))


@query("query_gates", f"""
SELECT qid, CASE {_direct} END AS gate_direct, CASE {_outside} END AS gate_external,
  CASE WHEN {unicode_word(norm('query'), 'их|это|эти|этого|такое|такие|ему|ей|им')} AND len({_spec})=0 THEN {q(ru.MSG_CLARIFY_ANAPHORA)}
       WHEN len(c)>0 AND len({_spec})=0 AND len({tokens('query')})<=7 THEN {q(ru.MSG_CLARIFY_GENERIC)} END AS gate_clarify
FROM (SELECT qid, query, {ordered_distinct('r')} AS c FROM (SELECT qid, query, {_cr} AS r FROM {ASKED_TURNS}))""")
def _(spark, d):
    return query_gates(asked_turns(spark, d), S).select("qid", "gate_direct", "gate_external", "gate_clarify")


@query("answer_profiles", f"""
SELECT qid, CASE WHEN {any_in('n', ru.MULTIPART_MARKERS)} OR {any_in('n', ru.PROCEDURE_MARKERS)} THEN 'procedure'
  WHEN len(regexp_extract_all(n,'[0-9a-zа-я]+'))<=10 OR {any_in('n', ru.FACT_MARKERS)} THEN 'fact' ELSE 'default' END AS profile
FROM (SELECT qid, {norm('query')} AS n FROM {TURNS})""")
def _(spark, d):
    return queries_from_conversations(spark, d).select("qid", answer_profile(F.col("query")).alias("profile"))
