"""Context, answer and guard queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import SETTINGS as S, hits, question_lists, snapshot, _once
from catalog.retrieval_queries import block
from catalog.sql import any_in, fold, inter, norm, ordered_distinct, q, root_list, root_set, sentences, sql, squash, unicode_word, words
from catalog.text_queries import L, SQL as TEXT_SQL, TURNS, filled, mask, runs, window_sql
from quarry.operators import answers, context, guards
from quarry.operators.contracts import check_answer, check_fast, check_grade
from quarry.operators.passages import select_passages
from quarry.operators.retrieval import cross_encode
from quarry.rules import russian as ru
from quarry.session import materialize
from quarry.sources.tables import queries_from_benchmark, read

QUERIES: dict = {}
SQL: dict[str, str] = {}
SQL_CACHE_KEYS = TEXT_SQL["cache_keys"]


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            SQL[name] = oracle
        return fn

    return add


def contexts(spark, d):
    return _once(
        spark, "contexts", d,
        make=lambda: materialize(
            context.prepare_context(question_lists(spark, d).filter("hits IS NOT NULL"), S), "contexts"
        ),
    )


def extracted(spark, d):
    """(qid, query, context, profile, answer, used_source_ids, confidence)."""
    def make():
        c = contexts(spark, d)
        e = answers.extractive_answer(c, F.when(F.col("profile.name") == "fact", 1).otherwise(2))
        return materialize(
            c.join(e, "qid").select("qid", "query", "context", "profile", "extractive.*"), "extracted"
        )

    return _once(spark, "extracted", d, make=make)


# --- sentence scores ------------------------------------------------------------------

_member = f"({unicode_word('qn', r'кто\s+(?:входит|состоит)')} OR contains(qn,{q(ru.MEMBERSHIP_MARKER)}))"
_who, _time, _act = any_in("qn", ru.SENTENCE_WHO_QUERY), any_in("qn", ru.SENTENCE_TIME_QUERY), any_in("qn", ru.SENTENCE_ACTION_QUERY)
_dur = r"[0-9]+[\s-]*(?:календарн[\p{L}\p{N}_]*\s+)?(?:дн|час|минут|месяц|год)[\p{L}\p{N}_]*"
_adj = f"""(CASE WHEN {_who} THEN -0.42 ELSE 0.0 END
  + CASE WHEN {_time} THEN CASE WHEN {unicode_word('sn', _dur)} THEN 0.30 ELSE 0.0 END ELSE 0.0 END
  + CASE WHEN {_act} AND {any_in('sn', ru.SENTENCE_ACTIONS)} THEN 0.20 ELSE 0.0 END
  + CASE WHEN length(trim(s))<70 AND {unicode_word('sn', r'[^ ]*(?:порядок|раздел|глава|приложение)')} THEN -0.10 ELSE 0.0 END)"""


def s_acronyms(x: str) -> str:
    run = lambda n: f"list_transform(range(1,length(ini)-{n}+2), lambda i: substr(ini,i,{n}))"
    ini = (
        f"array_to_string(list_transform(list_filter(regexp_extract_all(replace(lower({x}),'ё','е'),'[0-9a-zа-я]+'), "
        f"lambda t: length(t)>=3 AND NOT regexp_full_match(t,'[0-9]+') AND NOT list_contains({words(ru.CONTEXT_STOP)},t)), "
        f"lambda t: left(t,1)),'')"
    )
    return "list_distinct(list_concat({0},{1},{2}))".format(*[run(n).replace("ini", ini) for n in (3, 4, 5)])


def s_score(cov: str = "") -> str:
    """Sentence score from columns qr, ac, sr, qn, sn, s."""
    return (
        f"(CASE WHEN len(sr)>0 AND len(qr)>0 THEN round(0.82*{inter('qr', 'sr')}::DOUBLE/len(qr)"
        f"+0.18*least(1.0,{inter('qr', 'sr')}::DOUBLE/len(sr)*4.0)"
        f"+CASE WHEN len(list_intersect(ac,sr))>0 THEN 0.18 ELSE 0.0 END+{_adj},9) ELSE 0.0 END)"
    )


block("qfeat", (), f"""
  SELECT item_id AS qid, text AS query, {root_set('text')} AS qr, {s_acronyms('text')} AS ac, {norm('text')} AS qn FROM benchmark""")
block("prof", ("qfeat",), f"""
  SELECT *, CASE profile WHEN 'procedure' THEN 420 WHEN 'fact' THEN 340 ELSE 380 END AS p_chars,
    CASE profile WHEN 'procedure' THEN 1400 WHEN 'fact' THEN 760 ELSE 1100 END AS c_chars,
    CASE profile WHEN 'fact' THEN 2 ELSE 3 END AS c_chunks FROM (
  SELECT qid, CASE WHEN {any_in('qn', ru.MULTIPART_MARKERS)} OR {any_in('qn', ru.PROCEDURE_MARKERS)} THEN 'procedure'
  WHEN len(regexp_extract_all(qn,'[0-9a-zа-я]+'))<=10 OR {any_in('qn', ru.FACT_MARKERS)} THEN 'fact' ELSE 'default' END AS profile FROM qfeat)""")
block("hsent", ("hits10", "qfeat"), f"""
  SELECT *, {s_score()} AS score, row_number() OVER (PARTITION BY qid,hrank ORDER BY i) AS k,
         count(*) OVER (PARTITION BY qid,hrank) AS n FROM (
    SELECT h.qid, h.rank AS hrank, h.text AS htext, s, i, f.qr, f.ac, f.qn, {root_set('s')} AS sr, {norm('s')} AS sn FROM (
      SELECT qid, rank, text, unnest(ss) AS s, generate_subscripts(ss,1) AS i FROM (SELECT *, {sentences('text')} AS ss FROM hits10)) h
    JOIN qfeat f ON f.qid=h.qid)""")


@query("sentence_scores", sql("SELECT qid, hrank AS rank, k AS spos, round(score,6) AS score FROM hsent", "hsent"))
def _(spark, d):
    from quarry.functions.text import sentences as T_sentences
    df = context.query_features(question_lists(spark, d).filter("hits IS NOT NULL"))
    rows = df.select("qid", "_qroots", "_acronyms", "_qnorm", F.explode("hits").alias("h")).select(
        "qid", "_qroots", "_acronyms", "_qnorm", F.col("h.rank").alias("rank"),
        F.posexplode(T_sentences(F.col("h.text"))).alias("p", "s"))
    score = context.sentence_score(F.col("_qroots"), F.col("_acronyms"), F.col("_qnorm"), F.col("s"))
    return rows.select("qid", L(F.col("rank")).alias("rank"), L(F.col("p") + 1).alias("spos"), F.round(score, 6).alias("score"))


# --- focused passages and context --------------------------------------------------------
# procedure questions keep the leading document together; the oracle orders the same way

block("ordered", ("hits10", "prof"), f"""
  SELECT h.*, p.profile, p.p_chars, p.c_chars, p.c_chunks, row_number() OVER (PARTITION BY h.qid ORDER BY
      CASE WHEN apply AND same THEN 0 ELSE 1 END,
      CASE WHEN apply AND same AND h.rank>1 THEN 1 ELSE 0 END,
      CASE WHEN apply AND same THEN abs(h.chunk_number-a_num) ELSE 0 END,
      CASE WHEN apply AND same THEN -h.score ELSE 0 END, h.rank) AS orank
  FROM (SELECT *, doc_id=a_doc AS same, count(*) OVER (PARTITION BY qid, doc_id=a_doc) AS n_same FROM (
    SELECT *, first_value(doc_id) OVER w AS a_doc, first_value(chunk_number) OVER w AS a_num FROM hits10
    WINDOW w AS (PARTITION BY qid ORDER BY rank))) h
  JOIN prof p ON p.qid=h.qid
  JOIN (SELECT h.qid, any_value(p.profile)='procedure' AND count(*)>=2 AND NOT {any_in(fold('any_value(h.query)'), ru.COMPARISON_MARKERS)}
          AND count(*) FILTER (doc_id=d1)>=2 AS apply
        FROM (SELECT *, first_value(doc_id) OVER (PARTITION BY qid ORDER BY rank) AS d1 FROM hits10) h JOIN prof p ON p.qid=h.qid GROUP BY 1) z
    ON z.qid=h.qid""")
block("anchor", ("hsent", "prof"), """
  SELECT qid, hrank, any_value(n) AS n, arg_max(k, score*1000000+k) AS best, list(score ORDER BY k) AS sc, list(s ORDER BY k) AS ss,
         any_value(htext) AS t, any_value(p.p_chars) AS lim
  FROM hsent JOIN prof p USING (qid) GROUP BY 1,2""")
block("r_grow", ("anchor",), """
  SELECT qid, hrank, n, sc, ss, lim, greatest(1,best-1)::BIGINT AS lo, least(n,best+1)::BIGINT AS hi, false AS stop FROM anchor WHERE length(t)>lim
  UNION ALL
  SELECT qid, hrank, n, sc, ss, lim,
    CASE WHEN length(array_to_string(ss[nlo:nhi],' '))>lim THEN lo ELSE nlo END,
    CASE WHEN length(array_to_string(ss[nlo:nhi],' '))>lim THEN hi ELSE nhi END,
    length(array_to_string(ss[nlo:nhi],' '))>lim FROM (
    SELECT *, CASE WHEN r THEN lo ELSE lo-1 END AS nlo, CASE WHEN r THEN hi+1 ELSE hi END AS nhi FROM (
      SELECT *, hi<n AND (lo<=1 OR sc[hi+1]>=sc[lo-1]) AS r FROM r_grow WHERE NOT stop AND (lo>1 OR hi<n)))""")
block("focused", ("anchor", "r_grow"), """
  SELECT a.qid, a.hrank, CASE WHEN length(t)<=a.lim THEN t ELSE trim(array_to_string(a.ss[g.lo:g.hi],' ')) END AS ptext
  FROM anchor a LEFT JOIN (SELECT qid, hrank, min(lo) AS lo, max(hi) AS hi FROM r_grow GROUP BY 1,2) g
    ON g.qid=a.qid AND g.hrank=a.hrank""")
block("passages", ("ordered", "focused"), f"""
  SELECT o.qid, o.orank, o.idx, o.doc_id, o.title, o.section, o.url, o.chunk_id, o.score, o.lexical_coverage, o.c_chars, o.c_chunks, o.profile, f.ptext,
         {root_set('f.ptext')} AS pr
  FROM ordered o JOIN focused f ON f.qid=o.qid AND f.hrank=o.rank""")
_clip = "(CASE WHEN cut>=180 THEN trim(left(head,cut+1)) ELSE trim(head) END)"
_last = lambda m: f"(CASE WHEN contains(head,'{m}') THEN length(head)-strpos(reverse(head),'{m[::-1]}')-1 ELSE -1 END)"
block("r_budget", ("passages",), f"""
  SELECT qid, 0::BIGINT AS orank, 0::BIGINT AS used, 0::BIGINT AS kept, []::VARCHAR[][] AS seen, false AS stop, false AS took, ''::VARCHAR AS ctext
  FROM (SELECT DISTINCT qid FROM passages)
  UNION ALL
  SELECT qid, orank, CASE WHEN took THEN used+length(final)+over ELSE used END, CASE WHEN took THEN kept+1 ELSE kept END,
         CASE WHEN took THEN list_append(seen, {root_set('final')}) ELSE seen END,
         (NOT dup AND room<=180) OR (took AND kept+1>=c_chunks), took, final FROM (
    SELECT *, NOT dup AND room>180 AS took, CASE WHEN length(ptext)>room THEN {_clip} ELSE ptext END AS final FROM (
      SELECT *, greatest({_last('. ')},{_last('; ')},{_last(': ')}) AS cut FROM (
        SELECT *, left(ptext,greatest(room,0)) AS head FROM (
          SELECT r.qid, p.orank, r.used, r.kept, r.seen, p.ptext, p.c_chunks, length(p.title)+30 AS over, p.c_chars-r.used-(length(p.title)+30) AS room,
            len(list_filter(r.seen, lambda x: len(list_distinct(list_concat(x,p.pr)))>0 AND len(list_intersect(x,p.pr))::DOUBLE/len(list_distinct(list_concat(x,p.pr)))>=0.88))>0 AS dup
          FROM r_budget r JOIN passages p ON p.qid=r.qid AND p.orank=r.orank+1 WHERE NOT r.stop))))""")
block("ctx", ("r_budget", "passages"), """
  SELECT b.qid, b.kept AS n, 'S'||b.kept AS source_id, p.idx, p.doc_id, p.chunk_id, p.title, p.section, p.url, p.score, p.lexical_coverage, p.profile,
         b.ctext AS text FROM r_budget b JOIN passages p ON p.qid=b.qid AND p.orank=b.orank WHERE b.took""")


@query("answer_context", sql("SELECT qid, source_id, idx, title, md5(text) AS text_md5, length(text)::BIGINT AS n_chars FROM ctx", "ctx"))
def _(spark, d):
    return contexts(spark, d).select("qid", F.explode("context").alias("c")).select(
        "qid", "c.source_id", "c.idx", "c.title", F.md5("c.text").alias("text_md5"), L(F.length("c.text")).alias("n_chars"))


@query("context_rendering", sql("""
SELECT qid, md5(string_agg('['||source_id||'] '||title||': '||trim(text), chr(10) ORDER BY n)) AS compact_md5,
  md5(string_agg('SOURCE_ID: '||source_id||chr(10)||'['||source_id||']'||chr(10)||'Документ: '||title||chr(10)||'Раздел: '||section||chr(10)||'Текст:'||chr(10)||trim(text), chr(10)||chr(10) ORDER BY n)) AS full_md5
FROM ctx GROUP BY 1""", "ctx"))
def _(spark, d):
    c = F.col("context")
    return contexts(spark, d).filter(F.size("context") > 0).select(
        "qid", F.md5(context.render_compact(c)).alias("compact_md5"), F.md5(context.render_full(c)).alias("full_md5"))


@query("near_duplicate_pairs", sql(f"""
SELECT a.qid, a.orank AS a_rank, b.orank AS b_rank, round(len(list_intersect(a.pr,b.pr))::DOUBLE/len(list_distinct(list_concat(a.pr,b.pr))),6) AS jaccard
FROM passages a JOIN passages b ON a.qid=b.qid AND a.orank<b.orank WHERE len(a.pr)+len(b.pr)>0
  AND len(list_intersect(a.pr,b.pr))::DOUBLE/len(list_distinct(list_concat(a.pr,b.pr)))>=0.88""", "passages"))
def _(spark, d):
    # at most ten hits per question, so the self-join on qid stays linear in the questions
    df = question_lists(spark, d).filter("hits IS NOT NULL")
    df = context.query_features(df.withColumn("profile", context.profile_budgets(F.col("query"), S)))
    df = df.withColumn("hits", context.coherent_order(F.col("query"), F.col("hits"), F.col("profile.name"), S))
    p = materialize(
        context.focus_hits(df, S).select("qid", F.posexplode("passages").alias("r", "p")).select(
            "qid", L(F.col("r") + 1).alias("r"), context.root_set(F.col("p.text")).alias("roots")), "passages")
    a, b = p.alias("a"), p.alias("b")
    union = F.size(F.array_union("a.roots", "b.roots"))
    j = F.try_divide(F.size(F.array_intersect("a.roots", "b.roots")), union)
    return a.join(b, (F.col("a.qid") == F.col("b.qid")) & (F.col("a.r") < F.col("b.r"))).withColumn("j", j).filter("j >= 0.88").select(
        "a.qid", F.col("a.r").alias("a_rank"), F.col("b.r").alias("b_rank"), F.round("j", 6).alias("jaccard"))


# --- extractive answer -----------------------------------------------------------------------

_clean = r"rtrim(trim(regexp_replace(regexp_replace(regexp_replace(s,'\s+([,.;:)])','\1','g'),'([(:])\s+','\1 ','g'),'\s{2,}',' ','g')),' .;:')"
_ekey = r"trim(regexp_replace(replace(lower(s),'ß','ss'),'[^\p{L}\p{N}_]+',' ','g'))"
block("esent", ("ctx", "qfeat"), f"""
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, n, i) AS pos FROM (
    SELECT *, round({s_score()}+0.14-0.16*(n-1)+0.12*lexical_coverage,6) AS score FROM (
      SELECT c.qid, c.n, c.source_id, c.doc_id, c.lexical_coverage, c.profile, s, i, f.qr, f.ac, f.qn, {root_set('s')} AS sr, {norm('s')} AS sn FROM (
        SELECT *, unnest(ss) AS s, generate_subscripts(ss,1) AS i FROM (SELECT *, {sentences('text')} AS ss FROM ctx)) c
      JOIN qfeat f ON f.qid=c.qid
      WHERE length(s)>=24 AND NOT (ends_with(s,':') AND length(s)<220) AND NOT (contains(lower(s),{q(ru.DUTIES_HEADING)}) AND length(s)<180)))
  WHERE score>0""")
block("epick", ("esent",), f"""
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o, pos) AS m, first_value(score) OVER (PARTITION BY qid ORDER BY o, pos) AS lead FROM (
    SELECT *, row_number() OVER (PARTITION BY qid, key ORDER BY o, pos) AS copy, first_value(score) OVER (PARTITION BY qid ORDER BY o, pos) AS lead0 FROM (
      SELECT *, {_ekey} AS key, CASE WHEN ns>=2 AND NOT strong THEN 1 ELSE 0 END AS o FROM (
        SELECT *, sum(strong::INT) OVER (PARTITION BY qid) AS ns FROM (
          SELECT *, n=1 AND score>=0.45 AS strong FROM (SELECT *, first_value(doc_id) OVER (PARTITION BY qid ORDER BY pos) AS bd FROM esent)
          WHERE NOT {any_in('qn', ru.EXTRACTIVE_PROCEDURE)} OR doc_id=bd))
      WHERE ns<2 OR strong OR n<>1)) WHERE copy=1""")
block("answer", ("epick",), f"""
  SELECT qid, string_agg({_clean}||' ['||source_id||'].',' ' ORDER BY m) AS answer, list(source_id ORDER BY m) AS sids, least(1.0,max(lead)) AS confidence
  FROM epick WHERE m<=CASE WHEN profile='fact' THEN 1 ELSE 2 END GROUP BY 1""")
block("asids", ("answer",), f"SELECT *, {ordered_distinct('sids')} AS ids FROM answer")


@query("extractive_answers", sql("""
SELECT c.qid, coalesce(answer,'') AS answer, coalesce(array_to_string(ids,','),'') AS used_source_ids, round(coalesce(confidence,0.0),6) AS confidence
FROM (SELECT DISTINCT qid FROM hits10) c LEFT JOIN asids a ON a.qid=c.qid""", "hits10", "asids"))
def _(spark, d):
    return extracted(spark, d).select(
        "qid", "answer", F.array_join("used_source_ids", ",").alias("used_source_ids"), F.round("confidence", 6).alias("confidence"))


# --- guards ------------------------------------------------------------------------------------

_cited = r"list_transform(regexp_extract_all(answer,'\[\s*[SsСс]\s*(\d+)\s*\]',1), lambda x: 'S'||x)"


_made = "CASE qid%5 WHEN 0 THEN ' ' WHEN 1 THEN 'No marker here.' WHEN 2 THEN answer||' [S9]' WHEN 3 THEN answer||' see https://x.y' ELSE answer END"
_fault = lambda rule, message: f"CASE WHEN {rule} THEN {message} END"
_alien = lambda xs: f"list_sort(list_filter({xs}, lambda x: NOT list_contains(al,x)))"
_quoted = lambda xs: f"'['||array_to_string(list_transform({xs}, lambda x: chr(39)||x||chr(39)),', ')||']'"


@query("format_issues", sql(f"""
SELECT qid, array_to_string(list_filter([{",".join((
    _fault("trim(answer)=''", q(ru.ISSUE_EMPTY)),
    _fault(f"len({_alien('cited')})>0", q(ru.ISSUE_UNKNOWN_CITED) + "||" + _quoted(_alien("cited"))),
    _fault(f"len({_alien('declared')})>0", q(ru.ISSUE_UNKNOWN_DECLARED) + "||" + _quoted(_alien("declared"))),
    _fault("len(cited)=0", q(ru.ISSUE_NO_CITATIONS)),
    _fault("NOT (len(list_intersect(cited,declared))=len(cited) AND len(cited)=len(declared))", q(ru.ISSUE_MISMATCH)),
    _fault("regexp_matches(answer,'(?i)https?://[^\\s]+')", q(ru.ISSUE_URL))))}], lambda x: x IS NOT NULL),'|') AS issues
FROM (SELECT qid, answer, declared, al, list_distinct({_cited}) AS cited FROM (
  SELECT a.qid, {_made.replace('qid', 'a.qid')} AS answer, CASE WHEN a.qid%3=0 THEN list_append(ids,'S8') ELSE ids END AS declared, al
  FROM asids a JOIN (SELECT qid, list(source_id) AS al FROM ctx GROUP BY 1) c ON c.qid=a.qid))""", "asids", "ctx"))
def _(spark, d):
    e = extracted(spark, d).filter("answer <> ''")
    declared = F.when(F.col("qid") % 3 == 0, F.array_append("used_source_ids", F.lit("S8"))).otherwise(F.col("used_source_ids"))
    issues = guards.format_issues(F.expr(_made), declared, F.lit(False), guards.allowed_ids(F.col("context")))
    return e.select("qid", F.array_join(issues, "|").alias("issues"))


_cl = r"trim(regexp_replace(regexp_replace(part,'(?i)\[S\d+\]','','g'),'^\s*\d+[.)]\s*',''),' -—:;,.'||chr(9))"
_nums = lambda x: f"list_filter(string_split({runs(x)},' '), lambda t: regexp_full_match(t,'[0-9]{{2,}}'))"
_ents = lambda x: f"list_transform(list_filter(string_split({mask(x)},' '), lambda t: regexp_full_match(t,'[A-Za-z][A-Za-z0-9_-]{{2,}}')), lambda t: lower(t))"
block("claims", ("answer", "ctx"), rf"""
  SELECT qid, i, part, {_cl} AS clean, list_transform(regexp_extract_all(part,'(?i)\[S(\d+)\]',1), lambda x: 'S'||x) AS cited FROM (
    SELECT qid, unnest(p) AS part, generate_subscripts(p,1) AS i FROM (
      SELECT qid, list_filter(list_transform(string_split(regexp_replace(bad,'(?i)(\[S\d+\][.!?]?)','\1'||chr(31),'g'),chr(31)), lambda x: trim(x)), lambda x: x<>'') AS p
      FROM (SELECT qid, answer||' Extra 4711 Zyxwv claim [S1].'||CASE WHEN qid%2=0 THEN ' Tail words here' ELSE ' Other [S9]' END AS bad FROM answer)))""")
block("checked", ("claims", "ctx"), f"""
  SELECT c.*, {root_set('clean')} AS cr, s.src, s.known FROM claims c
  LEFT JOIN (SELECT c.qid, c.i, string_agg(x.title||' '||x.section||' '||x.text,' ' ORDER BY x.n) AS src, count(*) AS known
             FROM claims c JOIN ctx x ON x.qid=c.qid AND list_contains(c.cited,x.source_id) GROUP BY 1,2) s ON s.qid=c.qid AND s.i=c.i""")
block("verdicts", ("checked",), f"""
  SELECT qid, i, cov, list_filter([CASE WHEN len(cited)=0 THEN 'uncited_claim' END, CASE WHEN len(cited)>0 AND known IS NULL THEN 'unknown_citation' END,
      CASE WHEN known>0 AND len(list_filter({_nums('clean')}, lambda t: NOT list_contains({_nums('src')},t)))>0 THEN 'unsupported_number' END,
      CASE WHEN known>0 AND len(list_filter({_ents('clean')}, lambda t: NOT list_contains({_ents('src')},t)))>0 THEN 'unsupported_latin_entity' END,
      CASE WHEN cov<0.18 THEN 'low_claim_source_overlap' END], lambda x: x IS NOT NULL) AS issues FROM (
    SELECT *, CASE WHEN known>0 THEN len(list_intersect(cr,{root_set('src')}))::DOUBLE/len(cr) END AS cov FROM checked WHERE len(cr)>0)""")


def _bad_answers(spark, d):
    e = extracted(spark, d).filter("answer <> ''")
    tail = F.when(F.col("qid") % 2 == 0, " Tail words here").otherwise(" Other [S9]")
    return e.select("qid", "context", F.concat("answer", F.lit(" Extra 4711 Zyxwv claim [S1]."), tail).alias("answer"))


@query("grounding_claims", sql("SELECT qid, i-1 AS cpos, round(coalesce(cov,-1.0),6) AS coverage, array_to_string(issues,',') AS issues FROM verdicts", "verdicts"))
def _(spark, d):
    c = guards.claim_checks(_bad_answers(spark, d), S.grounding_min_claim_coverage)
    return c.select("qid", L(F.col("cpos")).alias("cpos"), F.round(F.coalesce("coverage", F.lit(-1.0)), 6).alias("coverage"),
                    F.array_join("issues", ",").alias("issues"))


@query("grounding", sql("""
SELECT qid, count(*)::BIGINT AS checked_claims, round(coalesce(min(cov),0.0),6) AS min_claim_coverage,
  array_to_string(list_sort(list_distinct(flatten(list(issues)))),',') AS issues FROM verdicts GROUP BY 1""", "verdicts"))
def _(spark, d):
    g = guards.assess_grounding(_bad_answers(spark, d), S.grounding_min_claim_coverage)
    return g.select("qid", "grounding.checked_claims", "grounding.min_claim_coverage",
                    F.array_join(F.array_sort("grounding.issues"), ",").alias("issues"))


_sp = f"list_filter({root_list('query', ru.PLANNER_STOP)}, lambda t: NOT list_contains({words(ru.GENERIC_ROOTS)},t))"


#: Questions and replies derived from the turns so that every issue meets rows with and without it.
_q_made, _q_col = filled(
    ("{q}", "Кто отвечает: {q}", "Кто входит в состав комиссии {q}", "Как согласовать {q}", "Кому сообщить {q}", "Что такое СОУТ",
     "Какой срок {q}", "Что делать: {q}", "Выдача СИЗ", "Что такое {q}"), "(conv_id*7+turn)%10", "query")
_a_made, _a_col = filled(
    ("{q}", "{q} Ответственный руководитель входит, это согласовано и сообщено в течение 5 дней, необходимо.",
     "[ЧЕЛОВЕК_1] Специальная оценка условий труда, средства индивидуальной защиты. {q}"), "conv_id%3", "answer")
_w = r"[\p{L}\p{N}_]"
_known = [f"list_distinct({root_list(q(meaning), [])})" for _, meaning in ru.ACRONYM_MEANINGS]
_answered = (
    rf"(?:ответствен{_w}*|руководител{_w}*|представител{_w}*|работник{_w}*|комисси{_w}*|служб{_w}*|организаци{_w}*|лиц{_w}*|"
    rf"директор{_w}*|специалист{_w}*|диспетчер{_w}*|подрядчик{_w}*)"
)
_members = rf"(?:входит{_w}*|состо{_w}*|член{_w}*|председател{_w}*|заместител{_w}*|секретар{_w}*)"
_relevance = ",".join(f"CASE WHEN {rule} THEN 'answer_misses_{name}' END" for name, rule in (
    ("query_object", f"len(sp)>0 AND {inter('sp', 'ar')}=0 AND NOT (CASE WHEN {unicode_word('n', 'соут')} THEN {inter(_known[0], 'ar')}>0 "
                     f"WHEN {unicode_word('n', 'сиз')} THEN {inter(_known[1], 'ar')}>0 ELSE false END)"),
    ("who_intent", f"({unicode_word('n', 'кто|кому|кем')} OR contains(n,'ответствен')) AND NOT {unicode_word('a', _answered)}"),
    ("membership_intent", f"{_member.replace('qn', 'n')} AND NOT {unicode_word('a', _members)}"),
    ("agreement_action", "contains(n,'соглас') AND NOT contains(a,'соглас')"),
    ("notification_action", "contains(n,'сообщ') AND NOT contains(a,'сообщ')"),
    ("definition_intent", f"{any_in('n', ru.GUARD_DEFINITION_QUERY)} AND NOT ({unicode_word('a', 'это')} OR "
                          f"{any_in('a', ('представляет собой', 'определяется как', 'понимается как'))} OR "
                          f"(contains(n,'соут') AND {inter(_known[0], 'ar')}=len({_known[0]})))"),
    ("time_intent", f"{any_in('n', ru.TIME_QUERY)} AND NOT ({unicode_word('a', '[0-9]+')} OR {any_in('a', ru.TIME_ANSWER)})"),
    ("procedure_intent", f"{any_in('n', ru.GUARD_PROCEDURE_QUERY)} AND NOT {any_in('a', ru.PROCEDURE_ANSWER)}"),
))


@query("relevance_issues", f"""
SELECT qid, array_to_string(list_filter([{_relevance}], lambda x: x IS NOT NULL),',') AS issues FROM (
  SELECT qid, {norm('query')} AS n, a, {_sp} AS sp, {root_set('a')} AS ar FROM (
    SELECT qid, query, regexp_replace({fold('answer')},{q('(?i)' + ru.PLACEHOLDER_PATTERN)},' ','g') AS a FROM (
      SELECT conv_id*1000+turn AS qid, {_q_made} AS query, {_a_made} AS answer FROM (
        SELECT conv_id, turn, role, text AS query, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations)
      WHERE role='user' AND answer IS NOT NULL)))""")
def _(spark, d):
    from pyspark.sql import Window
    c = read(spark, d, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("query"),
        F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("answer"))
    made = c.filter("role = 'user' AND answer IS NOT NULL").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), _q_col().alias("query"), _a_col().alias("answer"))
    return made.select("qid", F.array_join(guards.relevance_issues(F.col("query"), F.col("answer")), ",").alias("issues"))


@query("resolved_sources", sql("""
SELECT a.qid, a.k::BIGINT AS pos, c.source_id, c.doc_id, c.title, c.url, c.score FROM
  (SELECT qid, unnest(ids) AS sid, generate_subscripts(ids,1) AS k FROM asids) a JOIN ctx c ON c.qid=a.qid AND c.source_id=a.sid""", "asids", "ctx"))
def _(spark, d):
    e = extracted(spark, d)
    return e.select("qid", F.posexplode(guards.resolve_sources(F.col("answer"), F.col("context"))).alias("p", "s")).select(
        "qid", L(F.col("p") + 1).alias("pos"), "s.source_id", "s.doc_id", "s.title", "s.url", "s.score")


@query("posthoc_citations", sql(rf"""
SELECT qid, CASE WHEN bool_and(best>=0.28 OR nr=0) THEN string_agg(CASE WHEN nr=0 THEN p ELSE p||' ['||sid||']' END,' ' ORDER BY i) END AS cited FROM (
  SELECT qid, i, any_value(p) AS p, any_value(len(pr)) AS nr, max(sc) AS best, arg_max(sid,sc*1000-n) AS sid FROM (
    SELECT u.qid, u.i, u.p, u.pr, c.n, c.source_id AS sid,
      CASE WHEN {inter('u.pr', 'c.tr')}>0 THEN round({inter('u.pr', 'c.tr')}::DOUBLE/len(u.pr)+0.04/c.n,9) ELSE 0.0 END AS sc FROM (
      SELECT qid, p, i, {root_set('p')} AS pr FROM (SELECT qid, unnest(ps) AS p, generate_subscripts(ps,1) AS i FROM (
        SELECT qid, list_filter(list_transform(string_split(regexp_replace(regexp_replace(answer,'\[S\d+\]\.',' ','g'),'([.!?])\s+','\1'||chr(31),'g'),chr(31)), lambda x: trim(x)), lambda x: x<>'') AS ps FROM answer))) u
    JOIN (SELECT qid, n, source_id, {root_set("title||' '||text")} AS tr FROM ctx) c ON c.qid=u.qid) GROUP BY 1,2) GROUP BY 1""", "answer", "ctx"))
def _(spark, d):
    e = extracted(spark, d).filter("answer <> ''")
    bare = F.regexp_replace("answer", r"\[S\d+\]\.", " ")
    return e.select("qid", answers.posthoc_citations(bare, F.col("context"))["answer"].alias("cited"))


#: Replies cut off in a citation: after an echo of the question, after a marker, whole, and without any citation.
_reply = (
    "CASE qid%4 WHEN 0 THEN query||' — Ответ: '||answer||' Недописанное [S' WHEN 1 THEN 'S# '||answer||'  Tail words [S' "
    "WHEN 2 THEN ' A : '||answer ELSE 'Nothing is cited here. [S' END"
)


@query("reply_normalization", sql(rf"""
SELECT qid, CASE WHEN len(ids)=0 THEN {q(ru.MSG_SOURCES_INSUFFICIENT)} ELSE t END AS answer,
  CASE WHEN len(ids)=0 THEN '' ELSE array_to_string(ids,',') END AS ids, len(ids)=0 AS insufficient_context FROM (
  SELECT r.qid, t, list_filter({ordered_distinct('sids')}, lambda x: list_contains(al,x)) AS ids FROM (
    SELECT qid, t, list_transform(regexp_extract_all(t,'\[S(\d+)\]',1), lambda x: 'S'||x) AS sids FROM (
      SELECT qid, trim(regexp_replace(regexp_extract(regexp_replace(y,'\[[^\]]*$',''),'(?s)^(.*(?:[.!?]\s*\[S\d+\](?:\s*[.!?])?|\[S\d+\]\s*[.!?]))',1),'\s{{2,}}',' ','g')) AS t FROM (
        SELECT qid, regexp_replace(trim(CASE WHEN starts_with(lower(r),lower(n)) THEN regexp_replace(substr(r,length(n)+1),'^[ \t\r\n:—-]+','') ELSE r END),
          '(?i)^\s*(?:S#|Ответ\s*:|A\s*:)\s*','') AS y FROM (
          SELECT a.qid, trim({_reply.replace('qid', 'a.qid')}) AS r, {squash('query')} AS n FROM answer a JOIN qfeat f ON f.qid=a.qid)))) r
  JOIN (SELECT qid, list(source_id) AS al FROM ctx GROUP BY 1) c ON c.qid=r.qid)""", "answer", "qfeat", "ctx"))
def _(spark, d):
    e = extracted(spark, d).filter("answer <> ''")
    n = answers.normalize_reply(F.expr(_reply), F.col("query"), F.col("context"), F.lit(True), F.lit(True))
    return e.select("qid", n.alias("n")).select("qid", "n.answer", F.array_join("n.used_source_ids", ",").alias("ids"), "n.insufficient_context")


@query("generated_sources", sql("""
SELECT qid, CASE qid%3 WHEN 0 THEN 'By chunk [S1] and ['||last||'].'
    WHEN 1 THEN 'Nothing cited.'||chr(10)||chr(10)||'Источники: '||array_to_string(list_transform(ids, lambda x: '['||x||']'),', ')
    ELSE 'Seen in [S9] and [S1].' END AS answer,
  CASE qid%3 WHEN 0 THEN CASE WHEN last='S1' THEN 'S1' ELSE 'S1,'||last END WHEN 1 THEN array_to_string(ids,',') ELSE 'S1' END AS ids
FROM (SELECT a.qid, ids, (SELECT arg_max(c.source_id,c.n) FROM ctx c WHERE c.qid=a.qid AND c.doc_id=f.doc_id) AS last
  FROM asids a JOIN ctx f ON f.qid=a.qid AND f.n=1)""", "asids", "ctx"))
def _(spark, d):
    e = extracted(spark, d).filter("answer <> ''")
    first = F.element_at("context", 1)
    reply = (
        F.when(F.col("qid") % 3 == 0, F.concat(F.lit("By chunk ["), first["chunk_id"], F.lit("] and [ "), first["doc_id"], F.lit(" ].")))
        .when(F.col("qid") % 3 == 1, F.lit(" Nothing cited. ")).otherwise(F.lit("Seen in [ s9 ] and [s1]."))
    )
    n = answers.normalize_generated(reply, F.col("used_source_ids"), F.lit(False), F.col("context"))
    return e.select("qid", n.alias("n")).select("qid", "n.answer", F.array_join("n.used_source_ids", ",").alias("ids"))


_text_made, _text_col = filled(("{q}", " ", "{q} [S1]", "{q}"), "doc_id%4")
_ids_made = "CASE doc_id%5 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} ELSE {3} END"
_ids_sql = _ids_made.format("[]::VARCHAR[]", "['S1']", "['S9']", "['S2','S3']")
_ids_col = _ids_made.format("cast(array() as array<string>)", "array('S1')", "array('S9')", "array('S2','S3')")
_known_ids = f"len(list_filter(ids, lambda x: NOT list_contains({words(('S1', 'S2', 'S3', 'S4', 'S5'))},x)))=0"


@query("answer_contracts", rf"""
SELECT doc_id, CASE WHEN trim(x)='' THEN 'empty answer' WHEN ins AND len(ids)>0 THEN 'sources with insufficient context'
  WHEN ins AND regexp_matches(x,'\[\s*[SsСс]\s*\d+\s*\]') THEN 'markers with insufficient context'
  WHEN NOT ins AND len(ids)=0 THEN 'no sources' WHEN NOT {_known_ids} THEN 'unknown source id' END AS violation
FROM (SELECT doc_id, {_text_made} AS x, {_ids_sql} AS ids, doc_id%3=0 AS ins FROM documents)""")
def _(spark, d):
    return read(spark, d, "documents").select(
        "doc_id", check_answer(_text_col(), F.expr(_ids_col), F.col("doc_id") % 3 == 0).alias("violation"))


_fast = "CASE doc_id%7 WHEN 0 THEN 'later' WHEN 1 THEN 'answer' WHEN 2 THEN 'answer' WHEN 3 THEN 'answer' ELSE 'corrective' END"
_again = "CASE doc_id%4 WHEN 0 THEN {0}('again ',' ') WHEN 1 THEN {0}('') ELSE {1} END"


@query("fast_contracts", f"""
SELECT doc_id, CASE WHEN decision NOT IN ('answer','corrective') THEN 'unknown decision' WHEN NOT {_known_ids} THEN 'unknown source id'
  WHEN decision='answer' AND trim(x)='' THEN 'answer without text' WHEN decision='answer' AND len(ids)=0 THEN 'answer without sources'
  WHEN decision='answer' AND rw>0 THEN 'answer with rewrites'
  WHEN decision='corrective' AND (trim(x)<>'' OR len(ids)>0) THEN 'corrective with an answer'
  WHEN decision='corrective' AND rw=0 THEN 'corrective without rewrites' END AS violation
FROM (SELECT doc_id, {_fast} AS decision, {_text_made.replace('doc_id%4', '(doc_id//3)%4')} AS x, {_ids_sql} AS ids,
  CASE WHEN doc_id%4=0 THEN 1 ELSE 0 END AS rw FROM documents)""")
def _(spark, d):
    text = filled(("{q}", " ", "{q} [S1]", "{q}"), "(doc_id div 3)%4")[1]()
    none = "cast(array() as array<string>)"
    reply = F.struct(
        F.expr(_fast).alias("decision"), text.alias("answer"), F.expr(_ids_col).alias("used_source_ids"),
        F.expr(_again.format("array", none)).alias("rewritten_queries"), F.lit("").alias("reason"))
    return read(spark, d, "documents").select("doc_id", check_fast(reply).alias("violation"))


@query("grade_contracts", f"""
SELECT doc_id, CASE WHEN decision='unsure' THEN 'unknown decision' WHEN len(list_filter(ids, lambda x: x NOT IN ('S1','S2')))>0 THEN 'unknown source id'
  WHEN decision='sufficient' AND len(ids)=0 THEN 'sufficient without sources' END AS violation
FROM (SELECT doc_id, ['sufficient','partial','insufficient','unsure'][doc_id%4+1] AS decision, {_ids_sql} AS ids FROM documents)""")
def _(spark, d):
    reply = F.struct(
        F.expr("element_at(array('sufficient','partial','insufficient','unsure'), cast(doc_id%4+1 as int))").alias("decision"),
        F.expr(_ids_col).alias("relevant_source_ids"))
    return read(spark, d, "documents").select(
        "doc_id", check_grade(reply, F.array(F.lit("S1"), F.lit("S2"))).alias("violation"))


# --- operators of the answering plans, one by one -----------------------------------------------


@query("naive_context", sql("""
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank) AS pos, idx FROM hits10 WHERE trim(text)<>'' AND rank<=5""", "hits10"))
def _(spark, d):
    hits = question_lists(spark, d).filter("hits IS NOT NULL")
    picked = context.select_naive(F.col("hits"), F.lit(S.naive_context_top_k))
    return hits.select("qid", F.posexplode(picked).alias("p", "h")).select("qid", L(F.col("p") + 1).alias("pos"), "h.idx")


@query("best_passages", sql(f"""
SELECT qid, rank, w_start AS passage_start, w_end AS passage_end, length(p)::BIGINT AS selected_text_chars, score AS passage_score, md5(p) AS text_md5 FROM (
  SELECT *, row_number() OVER (PARTITION BY qid, rank ORDER BY score DESC, k) AS best FROM (
    SELECT w.*, {inter('f.qr', root_set('p'))}::DOUBLE AS score FROM (
      {window_sql('qid, rank', squash('text'), 'hits10')}) w JOIN qfeat f ON f.qid=w.qid)) WHERE best=1""", "hits10", "qfeat"))
def _(spark, d):
    shared = lambda query, passage: F.size(F.array_intersect(context.root_set(query), context.root_set(passage))).cast("double")
    asked = queries_from_benchmark(spark, d).select("qid", "query")
    rows = hits(spark, d, 10).select("qid", "rank", "text").join(asked, "qid")
    best = select_passages(rows, shared, S.passage_window_chars, S.passage_overlap_chars)
    return best.select(
        "qid", L(F.col("rank")).alias("rank"), L(F.col("passage_start")).alias("passage_start"), L(F.col("passage_end")).alias("passage_end"),
        L(F.col("selected_text_chars")).alias("selected_text_chars"), "passage_score", F.md5("text").alias("text_md5"))


@query("blended_scores", sql("""
SELECT qid, idx, (length(text)%9-4)::DOUBLE AS rerank_raw_score,
  round(0.72/(1+exp(-(length(text)%9-4)))+0.28*least(1.0,score),6) AS score FROM hits10""", "hits10"))
def _(spark, d):
    scorer = (F.length("text") % 9 - 4).cast("double")
    blended = cross_encode(hits(spark, d, 10).withColumn("base_score", F.col("score")), scorer)
    return blended.select("qid", "idx", "rerank_raw_score", F.round("score", 6).alias("score"))


@query("answer_cache", f"""
SELECT a.qid, a.cache_key, c.answer FROM ({SQL_CACHE_KEYS}) a JOIN (
  SELECT * FROM (SELECT cache_key, max(qid) AS used, md5(min(query)) AS answer FROM (
    SELECT k.qid, k.cache_key, t.query FROM ({SQL_CACHE_KEYS}) k JOIN {TURNS} t ON t.qid=k.qid) WHERE qid%2=0 GROUP BY 1)
  ORDER BY used DESC, cache_key LIMIT {S.answer_cache_size}) c ON c.cache_key=a.cache_key""")
def _(spark, d):
    from quarry.functions.text import cache_key
    from quarry.plans.latency import cached_answers, evict
    from quarry.sources.tables import queries_from_conversations

    asked = queries_from_conversations(spark, d)
    written = asked.filter("qid % 2 = 0").withColumn("cache_key", cache_key(F.col("query")))
    cache = written.groupBy("cache_key", "top_k", "section_id").agg(
        F.max("qid").alias("used_at"), F.md5(F.min("query")).alias("answer"))
    return cached_answers(asked, evict(cache, S)).select("qid", "cache_key", "answer")


_s_made, _s_col = filled(
    ("{q}", "Председатель комиссии и секретарь входят в состав. {q}", "Руководитель и работники проводят проверку не реже одного раза. {q}",
     "Работы выполняются в течение 10 дней, необходимо оформить акт. {q}", "Термины, определения — это документ.",
     "Порядок и обязанности и действия.", "Задачи комиссии: проводит плановые заседания. {q}", "Проверка осуществляется ежегодно. {q}"),
    "(conv_id*5+turn)%8", "answer")
_i_made, _i_col = filled(
    ("{q}", "Кто входит в состав комиссии?", "Кто проводит проверку {q}", "Какой срок {q}", "Что делать при пожаре?", "Как часто {q}",
     "Что такое наряд и кто его выдаёт?"), "conv_id%7", "query")
_role = (
    rf"(?:эксперт(?:ом|а|ы|ов|ами)?|работник(?:ами|и|ов|ом)?|комисси{_w}*|руководител{_w}*|представител{_w}*|служб{_w}*|ответственн{_w}*)"
)
_shape = f"((contains(s,'в состав') AND {unicode_word('s', 'вход' + _w + '*')}) OR contains(s,{q(ru.SENTENCE_COMPOSITION)}))"
_bare = r"regexp_replace(s,'\[[^\]]+\]',' ','g')"
_has_role = f"({unicode_word(_bare, _role)} OR regexp_matches({_bare},'организаци{_w}*[, ]+(?:осуществля|проводящ|выполняющ)'))"
_roles = "+".join(f"contains(s,{q(m)})::INT" for m in ru.ROLE_MARKERS)
_defines = any_in("qn", ru.DEFINITION_MARKERS)
_terms = (
    (f"{_member} AND {_shape}", 0.65), (f"{_member} AND {_roles}>=2", 0.32),
    (f"{_member} AND NOT {_shape} AND {any_in('s', ru.SENTENCE_TASKS)}", -0.35),
    (f"{_who} AND {_has_role}", 0.42), (f"{_who} AND NOT {_has_role}", -0.42), (f"{_who} AND {any_in('s', ru.SENTENCE_WHO_VERBS)}", 0.16),
    (f"{_time} AND {unicode_word('s', _dur)}", 0.30),
    (f"{_time} AND NOT {unicode_word('s', _dur)} AND {any_in('s', ru.SENTENCE_LIMITS)}", 0.24),
    (f"{_act} AND {any_in('s', ru.SENTENCE_ACTIONS)}", 0.20),
    (f"{_act} AND contains(s,{q(ru.DUTIES_HEADING)}) AND n<140", -0.22),
    (f"NOT {_defines} AND ({_who} OR {_time} OR {_act}) AND (contains(s,{q(ru.TERMS_MARKERS[0])}) OR (contains(s,' — ') AND {any_in('s', ru.DEFINITION_TEXT)}))", -0.18),
    (f"n<70 AND {unicode_word('s', '[^ ]*(?:порядок|раздел|глава|приложение)')}", -0.10),
)


@query("sentence_intents", f"""
SELECT qid, round({'+'.join(f'CASE WHEN {rule} THEN {value} ELSE 0.0 END' for rule, value in _terms)},6)::DOUBLE AS adjustment FROM (
  SELECT qid, {norm('query')} AS qn, {norm('answer')} AS s, length(trim(answer)) AS n FROM (
    SELECT conv_id*1000+turn AS qid, {_i_made} AS query, {_s_made} AS answer FROM (
      SELECT conv_id, turn, role, text AS query, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations)
    WHERE role='user' AND answer IS NOT NULL))""")
def _(spark, d):
    from pyspark.sql import Window
    from quarry.functions.intents import sentence_adjustment
    from quarry.functions.text import norm as text_norm

    c = read(spark, d, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("query"),
        F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("answer")).filter("role = 'user' AND answer IS NOT NULL")
    made = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), text_norm(_i_col()).alias("q"), _s_col().alias("s"))
    value = sentence_adjustment(F.col("q"), F.col("sn"), F.length(F.trim("s")))
    return made.withColumn("sn", text_norm(F.col("s"))).select("qid", F.round(value, 6).alias("adjustment"))


# --- whole answering plans (model behind a deterministic stand-in: rows-only) --------------------


@query("latency_answers")
def _(spark, d):
    from quarry.operators.model import FirstSourceClient
    from quarry.plans.latency import answer_queries

    return answer_queries(snapshot(spark, d), queries_from_benchmark(spark, d), FirstSourceClient)


_say = {name: q(getattr(ru, f"MSG_{name}")) for name in ("EXTERNAL", "CLARIFY_GENERIC", "WEAK", "CLARIFY_TIE", "INSUFFICIENT")}
block("own_relevance", ("answer",), f"""
  SELECT qid, len(list_filter([{_relevance}], lambda x: x IS NOT NULL))=0 AS fits FROM (
    SELECT qid, {norm('query')} AS n, a, {_sp} AS sp, {root_set('a')} AS ar FROM (
      SELECT qid, text AS query, regexp_replace({fold('answer')},{q('(?i)' + ru.PLACEHOLDER_PATTERN)},' ','g') AS a
      FROM answer JOIN benchmark ON item_id=qid))""")
block("routed", ("gated", "evidence", "tie", "asids", "own_relevance"), f"""
  SELECT *, CASE stage WHEN 'external' THEN {_say['EXTERNAL']} WHEN 'underspecified' THEN {_say['CLARIFY_GENERIC']} WHEN 'weak_evidence' THEN {_say['WEAK']}
      WHEN 'retrieval_ambiguity' THEN {_say['CLARIFY_TIE']} WHEN 'extractive' THEN found ELSE {_say['INSUFFICIENT']} END AS answer FROM (
    SELECT g.qid, g.ext, e.level, e.v, e.reason, a.answer AS found, a.ids, a.confidence,
      CASE WHEN g.ext IS NOT NULL THEN 'external' WHEN len(c)>0 AND len(sp)=0 AND nt<=7 THEN 'underspecified' WHEN e.level='weak' THEN 'weak_evidence'
           WHEN tie THEN 'retrieval_ambiguity'
           WHEN e.level='strong' AND coalesce(a.answer,'')<>'' AND a.confidence>={S.extractive_min_score} AND fits THEN 'extractive'
           ELSE 'extractive_rejected' END AS stage
    FROM gated g LEFT JOIN evidence e ON e.qid=g.qid LEFT JOIN tie t ON t.qid=g.qid LEFT JOIN asids a ON a.qid=g.qid
    LEFT JOIN own_relevance r ON r.qid=g.qid)""")


@query("extractive_route", sql("""
SELECT qid, answer, CASE WHEN stage='extractive' THEN 'success' ELSE 'insufficient_context' END AS status, stage AS exit_stage,
  (stage NOT IN ('external','underspecified'))::INT::BIGINT AS retrieval_attempts, CASE WHEN stage='extractive' THEN array_to_string(ids,',') ELSE '' END AS sources,
  CASE stage WHEN 'external' THEN 'query_gate='||ext WHEN 'underspecified' THEN 'query_gate=underspecified' ELSE
    'evidence_gate='||level||'|evidence_score='||printf('%.3f',v)||'|evidence_reason='||reason||CASE stage WHEN 'retrieval_ambiguity' THEN '|query_gate=retrieval_ambiguity'
      WHEN 'weak_evidence' THEN '' WHEN 'extractive' THEN '|llm_skipped_deadline_or_capability|extractive_confidence='||printf('%.3f',confidence)
      ELSE '|llm_skipped_deadline_or_capability' END END AS diagnostics
FROM routed""", "routed"))
def _(spark, d):
    from quarry.plans.latency import answer_queries

    r = answer_queries(snapshot(spark, d), queries_from_benchmark(spark, d), None)
    return r.select(
        "qid", "answer", "status", "exit_stage", L(F.col("retrieval_attempts")).alias("retrieval_attempts"),
        F.array_join(F.transform("sources", lambda x: x["source_id"]), ",").alias("sources"), F.array_join("diagnostics", "|").alias("diagnostics"))


@query("corrective_answers")
def _(spark, d):
    from quarry.operators.model import FirstSourceClient
    from quarry.plans.agentic import answer_queries

    return answer_queries(snapshot(spark, d), queries_from_benchmark(spark, d), FirstSourceClient)


block("said", ("routed",), r"""
  SELECT qid, unnest(x) AS piece, generate_subscripts(x,1) AS i FROM (
    SELECT qid, regexp_extract_all(answer,'[^\s\p{Z}\x{85}]+[\s\p{Z}\x{85}]*') AS x FROM routed)""")
block("r_said", ("said",), f"""
  SELECT qid, i, 1 AS g, length(piece) AS cur FROM said WHERE i=1
  UNION ALL
  SELECT p.qid, p.i, CASE WHEN r.cur+length(p.piece)>{S.token_chunk_chars} THEN r.g+1 ELSE r.g END,
         CASE WHEN r.cur+length(p.piece)>{S.token_chunk_chars} THEN length(p.piece) ELSE r.cur+length(p.piece) END
  FROM r_said r JOIN said p ON p.qid=r.qid AND p.i=r.i+1""")
block("shown", ("routed", "ctx"), """
  SELECT r.qid, list({'doc_id':c.doc_id,'title':c.title,'url':c.url,'score':c.score} ORDER BY list_position(r.ids,c.source_id)) AS sources
  FROM routed r JOIN ctx c ON c.qid=r.qid AND list_contains(r.ids,c.source_id) WHERE r.stage='extractive' GROUP BY 1""")


@query("answer_stream", sql("""
SELECT qid, 0::BIGINT AS seq, 'route_info' AS kind, 'naive' AS payload FROM routed
UNION ALL SELECT qid, g, 'token', string_agg(piece,'' ORDER BY i) FROM r_said JOIN said USING (qid,i) GROUP BY qid, g
UNION ALL SELECT r.qid, coalesce(m.g,0)+1, 'final', to_json({'answer':answer,'route_type':'naive','sources':coalesce(s.sources,[])})::VARCHAR
FROM routed r LEFT JOIN shown s ON s.qid=r.qid LEFT JOIN (SELECT qid, max(g) AS g FROM r_said GROUP BY 1) m ON m.qid=r.qid""",
    "routed", "shown", "said", "r_said"))
def _(spark, d):
    from quarry.plans.latency import answer_queries
    from quarry.plans.service import answer_stream

    r = answer_queries(snapshot(spark, d), queries_from_benchmark(spark, d), None)
    return answer_stream(r, S).select("qid", L(F.col("seq")).alias("seq"), "kind", "payload")
