"""SQL building blocks for the oracle: named CTEs with dependencies.

Every block is written against the raw tables only, independently of the Spark code.
"""

from __future__ import annotations

import re

from quarry.rules import russian as ru

SIZE, OVERLAP, HALF = 1400, 180, 384


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(xs) -> str:
    return "[" + ",".join(q(x) for x in dict.fromkeys(xs)) + "]"


def fold(x: str) -> str:
    return f"replace(replace(lower({x}),'ß','ss'),'ё','е')"


def squash(x: str) -> str:
    return rf"trim(regexp_replace({x},'[\s\p{{Z}}\x{{85}}]+',' ','g'))"


def norm(x: str) -> str:
    return squash(fold(x))


def isnum(t: str) -> str:
    return f"regexp_full_match({t},'[0-9]+')"


def tokens(x: str) -> str:
    return f"regexp_extract_all({fold(x)},'[0-9a-zа-я]+')"


def root(t: str) -> str:
    return (
        f"(CASE WHEN {isnum(t)} THEN {t} WHEN length({t})>=9 THEN left({t},6) "
        f"WHEN length({t})>=6 THEN left({t},5) ELSE {t} END)"
    )


def keep(x: str, stop) -> str:
    return (
        f"list_filter({tokens(x)}, lambda t: NOT list_contains({words(stop)},t) "
        f"AND (length(t)>=3 OR {isnum('t')}))"
    )


def root_list(x: str, stop=ru.RETRIEVAL_STOP) -> str:
    return f"list_transform({keep(x, stop)}, lambda t: {root('t')})"


def ordered_distinct(xs: str) -> str:
    return f"list_filter({xs}, lambda v, i: list_position({xs}, v) = i)"


def root_set(x: str, stop=ru.CONTEXT_STOP) -> str:
    return f"list_distinct({root_list(x, stop)})"


def any_in(x: str, markers) -> str:
    return "(" + " OR ".join(f"contains({x},{q(m)})" for m in markers) + ")"


def inter(a: str, b: str) -> str:
    return f"len(list_intersect({a},{b}))"


def sentences(x: str) -> str:
    cut = rf"string_split(regexp_replace({squash(x)},'([.!?;:])\s+','\1'||chr(31),'g'),chr(31))"
    return f"list_filter({cut}, lambda s: s<>'')"


def term_id(x: str) -> str:
    return f"('0x'||substr(md5({x}),1,15))::BIGINT"


BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}


def block(name: str, needs: tuple[str, ...], body: str) -> None:
    BLOCKS[name] = (needs, body)


def sql(final: str, *needs: str) -> str:
    done: list[str] = []

    def add(n: str) -> None:
        if n in done:
            return
        for d in BLOCKS[n][0]:
            add(d)
        done.append(n)

    for n in needs:
        add(n)
    head = ",\n".join(f"{n} AS MATERIALIZED ({BLOCKS[n][1]})" if not n.startswith("r_")
                      else f"{n} AS ({BLOCKS[n][1]})" for n in done)
    return f"WITH RECURSIVE {head}\n{final}" if done else final


# --- documents and chunks -----------------------------------------------------------

block("kb", (), """
  SELECT d.doc_id AS doc_seq, d.doc_id::VARCHAR AS doc_id,
         CASE WHEN trim(split_part(text,chr(10),1))='' THEN 'doc '||d.doc_id
              ELSE trim(split_part(text,chr(10),1)) END AS title,
         source AS section, regexp_extract(source,'([0-9]+)',1) AS section_id,
         text AS content, 'kb://'||source||'/'||d.doc_id AS url,
         coalesce(l.quality,1)<>0 AS is_actual
  FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l
    ON l.doc_id=d.doc_id""")
block("docs_in", ("kb",), "SELECT * FROM kb WHERE is_actual AND trim(content)<>''")
block("blocks", ("docs_in",), r"""
  SELECT doc_seq, pos, b FROM (
    SELECT doc_seq, pos, trim(regexp_replace(line,'[ \t\r\f\v]+',' ','g')) AS b FROM (
      SELECT doc_seq, unnest(string_split(content,chr(10))) AS line,
             generate_subscripts(string_split(content,chr(10)),1) AS pos FROM docs_in))
  WHERE b<>''""")
block("long_sentences", ("blocks",), rf"""
  SELECT doc_seq, pos, row_number() OVER (PARTITION BY doc_seq,pos ORDER BY i) AS i, s, length(s) AS n
  FROM (SELECT doc_seq, pos, trim(unnest(p)) AS s, generate_subscripts(p,1) AS i FROM (
    SELECT doc_seq, pos, string_split(regexp_replace(b,'([.!?])\s+','\1'||chr(31),'g'),chr(31)) AS p
    FROM blocks WHERE length(b)>{SIZE})) WHERE s<>''""")
block("r_spack", ("long_sentences",), f"""
  SELECT doc_seq,pos,i,1 AS grp,n AS cur, n>{SIZE} AS over FROM long_sentences WHERE i=1
  UNION ALL
  SELECT s.doc_seq,s.pos,s.i,
         CASE WHEN r.over OR s.n>{SIZE} OR r.cur+1+s.n>{SIZE} THEN r.grp+1 ELSE r.grp END,
         CASE WHEN r.over OR s.n>{SIZE} OR r.cur+1+s.n>{SIZE} THEN s.n ELSE r.cur+1+s.n END,
         s.n>{SIZE}
  FROM r_spack r JOIN long_sentences s ON s.doc_seq=r.doc_seq AND s.pos=r.pos AND s.i=r.i+1""")
block("sgroups", ("r_spack",), """
  SELECT p.doc_seq,p.pos,p.grp, string_agg(s.s,' ' ORDER BY s.i) AS t
  FROM r_spack p JOIN long_sentences s USING (doc_seq,pos,i) GROUP BY 1,2,3""")
_lo = int(SIZE * 0.65)
_win = f"substr(rest,{_lo + 1},{SIZE - _lo + 1})"
_cut = (
    f"(CASE WHEN contains({_win},' ') THEN {_lo}+length({_win})-strpos(reverse({_win}),' ') ELSE {SIZE} END)"
)
block("r_slices", ("sgroups",), f"""
  SELECT doc_seq,pos,grp,0 AS k,'' AS piece,t AS rest FROM sgroups
  UNION ALL
  SELECT doc_seq,pos,grp,k+1,
         CASE WHEN length(rest)>{SIZE} THEN trim(left(rest,{_cut})) ELSE rest END,
         CASE WHEN length(rest)>{SIZE} THEN trim(substr(rest,{_cut}+1)) ELSE '' END
  FROM r_slices WHERE rest<>''""")
block("units", ("blocks", "r_slices"), f"""
  SELECT doc_seq, row_number() OVER (PARTITION BY doc_seq ORDER BY pos,grp,k) AS i, u, length(u) AS n FROM (
    SELECT doc_seq,pos,0 AS grp,0 AS k,b AS u FROM blocks WHERE length(b)<={SIZE}
    UNION ALL SELECT doc_seq,pos,grp,k,piece FROM r_slices WHERE k>0)""")
block("r_pack", ("units",), f"""
  SELECT doc_seq,i,1 AS c,n AS cur FROM units WHERE i=1
  UNION ALL
  SELECT u.doc_seq,u.i, CASE WHEN r.cur+1+u.n>{SIZE} THEN r.c+1 ELSE r.c END,
         CASE WHEN r.cur+1+u.n>{SIZE} THEN u.n ELSE r.cur+1+u.n END
  FROM r_pack r JOIN units u ON u.doc_seq=r.doc_seq AND u.i=r.i+1""")
block("packed", ("r_pack",), """
  SELECT *, row_number() OVER w AS r, sum(n+1) OVER w - 1 AS cum
  FROM r_pack JOIN units USING (doc_seq,i) WINDOW w AS (PARTITION BY doc_seq,c ORDER BY i DESC)""")
block("tails", ("packed",), f"""
  SELECT doc_seq, c+1 AS c, string_agg(u,' ' ORDER BY i) AS tail FROM packed
  WHERE (r=1 AND n<={2 * OVERLAP}) OR (r>1 AND cum<={OVERLAP}) GROUP BY 1,2""")
block("chunks", ("packed", "tails", "docs_in"), """
  SELECT d.doc_seq*1048576+p.c AS idx, d.doc_seq, d.doc_id, p.c::INT AS chunk_number,
         d.doc_id||':v1:chunk-'||p.c AS chunk_id,
         trim(coalesce(t.tail||' ','')||p.base) AS text
  FROM (SELECT doc_seq,c,string_agg(u,' ' ORDER BY i) AS base FROM packed GROUP BY 1,2) p
  JOIN docs_in d USING (doc_seq) LEFT JOIN tails t ON t.doc_seq=p.doc_seq AND t.c=p.c""")
block("n_chunks", ("chunks",), "SELECT count(*) AS n FROM chunks")
block("croots", ("chunks",), f"""
  SELECT idx,doc_seq,doc_id,chunk_number,chunk_id,text,{root_list('text')} AS roots FROM chunks""")
block("dims", ("docs_in", "chunks"), f"""
  SELECT d.*, n.n AS n_chunks, {root_list('title')} AS title_roots,
         list_distinct({root_list('section')}) AS section_roots
  FROM docs_in d JOIN (SELECT doc_id,count(*) AS n FROM chunks GROUP BY 1) n USING (doc_id)""")
block("doc_roots", ("croots", "dims"), """
  SELECT doc_id, root, sum(n)::BIGINT AS n FROM (
    SELECT doc_id, unnest(roots) AS root, 1 AS n FROM croots
    UNION ALL SELECT doc_id, unnest(title_roots), n_chunks FROM dims) GROUP BY 1,2""")

# --- terms -----------------------------------------------------------------------------


def word_terms(src: str, key: str, text: str) -> str:
    return rf"""
  SELECT {key}, 'w:'||t AS term, count(*) AS tf FROM (
    SELECT {key}, unnest(list_concat(w, list_transform(range(1,len(w)), lambda i: w[i]||' '||w[i+1]))) AS t
    FROM (SELECT {key}, regexp_extract_all(lower({text}),'[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_]+') AS w FROM {src}))
  GROUP BY 1,2"""


def char_terms(src: str, key: str, text: str) -> str:
    return rf"""
  SELECT {key}, 'c:'||substr(p,i,n) AS term, sum(c)::BIGINT AS tf FROM (
    SELECT {key}, ' '||w||' ' AS p, c, n, unnest(range(1,length(w)+4-n)) AS i FROM (
      SELECT {key}, w, count(*) AS c FROM (
        SELECT {key}, unnest(regexp_split_to_array(lower({text}),'[\s\p{{Z}}\x{{85}}]+')) AS w FROM {src})
      WHERE w<>'' GROUP BY 1,2), (SELECT unnest([3,4,5]) AS n) WHERE length(w)+2>=n)
  GROUP BY 1,2"""


block("wtf", ("chunks",), word_terms("chunks", "idx", "text"))
block("ctf", ("chunks",), char_terms("chunks", "idx", "text"))
block("vocab", ("wtf", "ctf", "n_chunks"), f"""
  SELECT v.*, ln((1.0+n)/(1.0+df))+1.0 AS idf FROM (
    SELECT 'word' AS family, term, {term_id('term')} AS term_id, count(*) AS df, sum(tf)::BIGINT AS total
    FROM wtf GROUP BY term
    UNION ALL
    SELECT * FROM (SELECT 'char', term, {term_id('term')} AS id, count(*), sum(tf)::BIGINT AS total
      FROM ctf GROUP BY term ORDER BY total DESC, id LIMIT 25000)) v, n_chunks""")
block("weights", ("wtf", "ctf", "vocab"), """
  SELECT idx, family, term, (1+ln(tf))*idf AS w FROM
    (SELECT * FROM wtf UNION ALL SELECT * FROM ctf) JOIN vocab USING (term)""")
block("norms", ("weights",), """
  SELECT idx, sqrt(sum(CASE WHEN family='word' THEN w*w ELSE 0 END)) AS word_norm,
         sqrt(sum(CASE WHEN family='char' THEN w*w ELSE 0 END)) AS char_norm
  FROM weights GROUP BY 1""")
block("qs", (), "SELECT item_id AS qid, text AS query FROM benchmark")
block("qwtf", ("qs",), word_terms("qs", "qid", "query"))
block("qctf", ("qs",), char_terms("qs", "qid", "query"))
block("qweights", ("qwtf", "qctf", "vocab"), """
  SELECT qid, family, term, w/sqrt(sum(w*w) OVER (PARTITION BY qid,family))
         * CASE WHEN family='word' THEN 1.0 ELSE 0.45 END AS qw
  FROM (SELECT qid, family, term, (1+ln(tf))*idf AS w FROM
    (SELECT * FROM qwtf UNION ALL SELECT * FROM qctf) JOIN vocab USING (term))""")
block("sparse_all", ("weights", "norms", "qweights"), """
  SELECT qid, idx, round(s/sqrt((word_norm>0)::INT+(char_norm>0)::INT*0.45*0.45),6) AS score FROM (
    SELECT qid, idx, sum(qw*w*CASE WHEN w.family='word' THEN 1.0/word_norm ELSE 0.45/char_norm END) AS s
    FROM weights w JOIN qweights q ON q.term=w.term JOIN norms USING (idx) GROUP BY 1,2)
  JOIN norms USING (idx)""")
block("sparse_ranked", ("sparse_all",), """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS rank FROM sparse_all)
  WHERE rank<=80""")


def dense(wtf: str, ctf: str, key: str) -> str:
    def half(src: str, off: int) -> str:
        return f"""
    SELECT {key}, bucket, n/sqrt(sum(n*n) OVER (PARTITION BY {key})) AS w FROM (
      SELECT {key}, {off}+({term_id('term')} % {HALF}) AS bucket, sum(tf)::DOUBLE AS n FROM {src} GROUP BY 1,2)"""

    return f"""
  SELECT {key}, bucket, w/sqrt(sum(w*w) OVER (PARTITION BY {key})) AS w
  FROM ({half(wtf, 0)} UNION ALL {half(ctf, HALF)})"""


block("dvec", ("wtf", "ctf"), dense("wtf", "ctf", "idx"))
block("qdvec", ("qwtf", "qctf"), dense("qwtf", "qctf", "qid"))
block("dense_ranked", ("dvec", "qdvec"), """
  SELECT * FROM (SELECT qid, idx, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS rank FROM (
    SELECT qid, idx, round(sum(d.w*q.w),6) AS score FROM dvec d JOIN qdvec q USING (bucket) GROUP BY 1,2))
  WHERE rank<=60""")

# --- lexical, fusion, pool ---------------------------------------------------------------

_qr = ordered_distinct("r")
block("qroots", ("qs",), f"""
  SELECT qid, query, qroots, len(qroots) AS qn, len(list_filter(qroots, lambda t: {isnum('t')})) AS nn
  FROM (SELECT qid, query, {_qr} AS qroots FROM (SELECT qid, query, {root_list('query')} AS r FROM qs))""")


def coverage(m: str, mn: str, qn: str, nn: str) -> str:
    return (
        f"(CASE WHEN {nn}>0 AND {mn}={nn} THEN least(1.15,{m}::DOUBLE/{qn}+0.12) ELSE {m}::DOUBLE/{qn} END)"
    )


block("lexical", ("croots", "qroots"), f"""
  SELECT * FROM (SELECT qid, idx, coverage, row_number() OVER (PARTITION BY qid ORDER BY coverage DESC, idx) AS lex_rank
    FROM (SELECT qid, idx, round({coverage('count(*)', 'sum(isn)', 'any_value(qn)', 'any_value(nn)')},6) AS coverage
      FROM (SELECT qid, qn, nn, unnest(qroots) AS root FROM qroots) JOIN
           (SELECT idx, root, {isnum('root')}::INT AS isn FROM
              (SELECT DISTINCT idx, unnest(roots) AS root FROM croots)) USING (root)
      GROUP BY 1,2))
  WHERE lex_rank<=80""")
block("fused", ("dense_ranked", "sparse_ranked"), """
  SELECT qid, idx, round(sum(1.0::DOUBLE/(60+rank)),12) AS rrf_score,
         greatest(0.0,coalesce(max(score) FILTER (kind=0),0.0)) AS dense_score,
         greatest(0.0,coalesce(max(score) FILTER (kind=1),0.0)) AS sparse_score,
         min(kind*1000+rank) AS seen
  FROM (SELECT qid,idx,score,rank,0 AS kind FROM dense_ranked
        UNION ALL SELECT qid,idx,score,rank,1 FROM sparse_ranked) GROUP BY 1,2""")
block("pool_head", ("fused", "lexical"), """
  SELECT qid, idx, min(pos) AS pos FROM (
    SELECT qid, idx, row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, seen) AS pos, 80 AS lim FROM fused
    UNION ALL SELECT qid, idx, lex_rank+1099511627776, 1099511629776 FROM lexical) WHERE pos<=lim GROUP BY 1,2""")
block("pool", ("pool_head", "fused"), """
  SELECT p.*, coalesce(rrf_score,0.0) AS rrf_score, coalesce(dense_score,0.0) AS dense_score,
         coalesce(sparse_score,0.0) AS sparse_score FROM (
    SELECT qid, idx, min(pos) AS pos FROM (
      SELECT * FROM pool_head
      UNION ALL
      SELECT qid, idx+d, 1152921504606846976+a*1073741824+j FROM
        (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) AS a FROM pool_head),
        (SELECT unnest([-1,1]) AS d, unnest([0,1]) AS j) WHERE a<=3) GROUP BY 1,2) p
  LEFT JOIN fused f ON f.qid=p.qid AND f.idx=p.idx""")

# --- features --------------------------------------------------------------------------------

block("pairs", ("pool", "croots", "dims", "qroots"), """
  SELECT p.*, c.doc_id, c.chunk_number, c.chunk_id, c.text, c.roots, d.title, d.section, d.section_id, d.url,
         d.title_roots, d.section_roots, r.query, r.qroots, r.qn, r.nn,
         greatest(max(rrf_score) OVER (PARTITION BY p.qid),1e-300) AS max_rrf
  FROM pool p JOIN croots c USING (idx) JOIN dims d ON d.doc_id=c.doc_id JOIN qroots r ON r.qid=p.qid""")
block("matched", ("pairs",), """
  SELECT qid, idx, list_filter(qroots, lambda t: list_contains(roots,t)) AS m FROM pairs""")
block("occ", ("pairs", "matched"), """
  SELECT qid, idx, ix, list_position(m[1:5], root) AS slot, least(5,len(m)) AS need FROM (
    SELECT qid, idx, unnest(roots) AS root, generate_subscripts(roots,1) AS ix FROM pairs)
  JOIN matched USING (qid,idx) WHERE list_contains(m[1:5],root)""")
_last = ", ".join(
    f"CASE WHEN need>={k} THEN coalesce(max(CASE WHEN slot={k} THEN ix END) OVER w,-1) ELSE ix END AS l{k}"
    for k in range(1, 6)
)
block("spans", ("occ",), f"""
  SELECT qid, idx, any_value(need) AS need,
         min(CASE WHEN least(l1,l2,l3,l4,l5)>=0 THEN ix-least(l1,l2,l3,l4,l5)+1 END) AS span FROM (
    SELECT qid, idx, need, ix, {_last} FROM occ
    WINDOW w AS (PARTITION BY qid,idx ORDER BY ix ROWS UNBOUNDED PRECEDING)) GROUP BY 1,2""")
block("affinity", ("pairs", "doc_roots"), """
  SELECT qid, doc_id, round(m::DOUBLE/qn*(0.55+0.45*f/qn),12) AS document_affinity FROM (
    SELECT qid, doc_id, any_value(qn) AS qn, count(*) AS m, sum(least(1.0,ln(1.0+n)/ln(8.0))) AS f FROM
      (SELECT DISTINCT qid, doc_id, qn, unnest(qroots) AS root FROM pairs) JOIN doc_roots USING (doc_id,root)
    GROUP BY 1,2)""")


def unicode_word(x: str, pattern: str) -> str:
    """RE2's \\b is ASCII-only, so word edges are spelled out."""
    return rf"regexp_matches({x},'(^|[^\p{{L}}\p{{N}}_])(?:{pattern})($|[^\p{{L}}\p{{N}}_])')"


DURATION = r"[0-9]+[\s-]*(?:календарн[\p{L}\p{N}_]*\s+)?(?:дн|час|минут|месяц|год)[\p{L}\p{N}_]*"
MEMBER_Q = f"({unicode_word('qn_', r'кто\s+(?:входит|состоит)')} OR contains(qn_,{q(ru.MEMBERSHIP_MARKER)}))"
MEMBER_T = f"(contains(w_,{q(ru.MEMBERSHIP_TEXT)}) AND {unicode_word('w_', r'вход[\p{L}\p{N}_]*')})"
_roles = "+".join(f"contains(w_,{q(m)})::INT" for m in ru.ROLE_MARKERS)
_boost = "+".join(
    f"CASE WHEN {any_in('qf_', k)} AND {any_in('dt_', e)} THEN 0.18 ELSE 0.0 END" for k, e in ru.BUSINESS_RULES
)
_pen = "+".join(
    f"CASE WHEN {any_in('qf_', k)} AND NOT {any_in('dt_', e)} AND {any_in('dt_', ru.OFF_TOPIC_TEXT)} "
    f"AND NOT {any_in('qf_', ru.OFF_TOPIC_EXEMPT)} THEN 0.12 ELSE 0.0 END"
    for k, e in ru.BUSINESS_RULES
)
_pref = "list_concat(" + ",".join(
    f"CASE WHEN {any_in('qf_', p)} THEN {list(ids)} ELSE []::INT[] END" for p, ids in ru.SECTION_RULES
) + ")"
BONUS = f"""
    least(0.18,
      CASE WHEN {any_in('qn_', ru.DURATION_MARKERS)} THEN CASE WHEN {unicode_word('w_', DURATION)} THEN 0.08
           WHEN {any_in('w_', ru.LIMIT_MARKERS)} THEN 0.06 ELSE 0.0 END ELSE 0.0 END
      + CASE WHEN {any_in('qn_', ru.ANSWERABLE_ACTION_MARKERS)} AND {any_in('w_', ru.ANSWERABLE_VERBS)} THEN 0.045 ELSE 0.0 END
      + CASE WHEN {MEMBER_Q} THEN CASE WHEN {MEMBER_T} THEN 0.14 WHEN {any_in('w_', ru.COMPOSITION_MENTIONS)} THEN 0.03
           ELSE 0.0 END ELSE 0.0 END
      + CASE WHEN {MEMBER_Q} AND {_roles}>=2 THEN 0.06 ELSE 0.0 END
      + CASE WHEN {any_in('qn_', ru.OWNER_QUERY)} AND {any_in('w_', ru.OWNER_TEXT)} THEN 0.035 ELSE 0.0 END
    )::DOUBLE"""
BOILERPLATE = f"""
    least(0.30,
      CASE WHEN contains(h_,{q(ru.CONTENTS_MARKER)}) THEN 0.22 ELSE 0.0 END
      + CASE WHEN {any_in('qn_', ru.ANSWERABLE_ACTION_MARKERS)} AND NOT {any_in('qn_', ru.DEFINITION_MARKERS)}
             AND {any_in('h_', ru.TERMS_MARKERS)} THEN 0.12 ELSE 0.0 END
      + CASE WHEN {MEMBER_Q} AND {_roles}<2 AND NOT {MEMBER_T} THEN 0.12 ELSE 0.0 END
      + CASE WHEN {MEMBER_Q} AND NOT {MEMBER_T} AND {any_in('w_', ru.MEETING_MARKERS)} THEN 0.06 ELSE 0.0 END
    )::DOUBLE"""


def features(coverages: str, source: str) -> str:
    """Signals of the rows of `source`, with the SQL of the three coverages that several variants share."""
    return f"""
  SELECT *, len(pref_)>0 AND list_contains(pref_, coalesce(TRY_CAST(section_id AS INT),0)) AS inpref_ FROM (
    SELECT p.*, {norm('query')} AS qn_, {fold('query')} AS qf_, {norm('text')} AS w_, {norm('left(text,900)')} AS h_,
         {fold("section||' '||title")} AS dt_,
         {coverages},
         coalesce(document_affinity,0.0) AS document_affinity,
         {inter('qroots', 'title_roots')}::DOUBLE/greatest(1,qn) AS title_match,
         {inter('qroots', 'section_roots')}::DOUBLE/greatest(1,qn) AS section_match,
         {_pref.replace('qf_', fold('query'))} AS pref_
    FROM {source} a ON a.qid=p.qid AND a.doc_id=p.doc_id)"""


_numeric = "len(list_filter(m, lambda t: " + isnum("t") + "))"
_proximity = "CASE WHEN need>=2 AND span IS NOT NULL THEN need::DOUBLE/greatest(need,span) ELSE 0.0 END"
block("features", ("pairs", "matched", "spans", "affinity"), features(f"""
         CASE WHEN len(m)>0 THEN round({coverage('len(m)', _numeric, 'qn', 'nn')},12) ELSE 0.0 END AS lexical_coverage,
         CASE WHEN len(m)>0 THEN {inter('qroots', 'title_roots')}::DOUBLE/qn ELSE 0.0 END AS title_coverage,
         {_proximity} AS term_proximity""",
    "pairs p JOIN matched USING (qid,idx) LEFT JOIN spans USING (qid,idx) LEFT JOIN affinity"))
block("signals", ("features",), f"""
  SELECT *, {_boost} + CASE WHEN inpref_ THEN 0.30 ELSE 0.0 END AS intent_boost,
    {_pen} + CASE WHEN len(pref_)>0 AND NOT inpref_ THEN 0.10 ELSE 0.0 END AS intent_penalty,
    {BONUS} AS answerability_bonus,
    {BOILERPLATE} AS boilerplate_penalty
  FROM features""")
block("scored", ("signals",), """
  SELECT *, round(greatest(0.0, 0.22*rrf_score/max_rrf + 0.10*dense_score + 0.18*sparse_score + 0.42*lexical_coverage
    + 0.16*title_coverage + 0.10*term_proximity + 0.10*document_affinity + 0.18*title_match + 0.08*section_match
    + intent_boost - intent_penalty + answerability_bonus - boilerplate_penalty),6) AS score
  FROM signals""")


def hits(k: str, section: str = "TRUE") -> str:
    return f"""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY qid,doc_id ORDER BY score DESC, pos) AS in_doc FROM scored WHERE {section})
    WHERE in_doc<=3) WHERE rank<={k}"""


block("hits5", ("scored",), hits("5"))
block("hits10", ("scored",), hits("10"))


# --- several variants of a question: the blocks above once more over qid*100+variant ---------------


def again(name: str, also: dict[str, str] | None = None) -> None:
    """The block `name` as `v_name`, over the variants' blocks where there are any."""
    needs, body = BLOCKS[name]
    for old in [n for n in BLOCKS if f"v_{n}" in BLOCKS]:
        body = re.sub(rf"(?<![\w.]){old}(?!\w)", f"v_{old}", body)
        needs = tuple(f"v_{n}" if n == old else n for n in needs)
    for old, new in (also or {}).items():
        body = body.replace(old, new)
    block(f"v_{name}", needs, body)


_trimmed = lambda x: f"trim({x},' '||chr(9)||chr(10)||chr(13))"
_terms = (
    f"list_filter(regexp_extract_all(lower(p),'[0-9a-zа-яё]+'), lambda t: length(t)>=4 AND NOT list_contains({words(ru.REWRITE_STOP)},t))"
)
block("v_qs", (), rf"""
  SELECT item_id*100+i-1 AS qid, all_[i] AS query FROM (SELECT item_id, all_, unnest(range(1,len(all_)+1)) AS i FROM (
    SELECT item_id, {ordered_distinct('a')} AS all_ FROM (
      SELECT item_id, list_filter(list_concat([{_trimmed('text')}], CASE WHEN len(ps)>=2 THEN ps[1:2] ELSE [] END), lambda x: x<>'') AS a FROM (
        SELECT item_id, text, list_filter(list_transform(string_split(regexp_replace(trim(text,' ?.!'||chr(9)||chr(10)||chr(13)),
          '(?i)[\s\p{{Z}}\x{{85}}]+(?:и|или|а также)[\s\p{{Z}}\x{{85}}]+|[;,]',chr(31),'g'),chr(31)), lambda x: {_trimmed('x')}), lambda p: len({_terms})>0) AS ps
        FROM benchmark))))""")
for _n in ("qwtf", "qctf", "qweights", "sparse_all", "sparse_ranked", "qdvec", "dense_ranked"):
    again(_n)
BLOCKS["v_qroots"] = (("v_qs",), BLOCKS["qroots"][1].replace("FROM qs", "FROM v_qs"))
block("v_lexical", ("croots", "v_qroots"), f"""
  SELECT * FROM (SELECT qid, idx, coverage, row_number() OVER (PARTITION BY qid ORDER BY coverage DESC, idx) AS lex_rank FROM (
    SELECT qid//100 AS qid, idx, max(coverage) AS coverage FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY coverage DESC, idx) AS own FROM (
        SELECT qid, idx, round({coverage('count(*)', 'sum(isn)', 'any_value(qn)', 'any_value(nn)')},6) AS coverage
        FROM (SELECT qid, qn, nn, unnest(qroots) AS root FROM v_qroots) JOIN
             (SELECT idx, root, {isnum('root')}::INT AS isn FROM (SELECT DISTINCT idx, unnest(roots) AS root FROM croots)) USING (root)
        GROUP BY 1,2)) GROUP BY 1,2)) WHERE lex_rank<=80""")
block("v_fused", ("v_dense_ranked", "v_sparse_ranked"), BLOCKS["fused"][1]
      .replace("min(kind*1000+rank)", "min(vid*1000000+kind*1000+rank)")
      .replace("SELECT qid,idx,score,rank,0 AS kind FROM dense_ranked", "SELECT qid//100 AS qid,qid%100 AS vid,idx,score,rank,0 AS kind FROM v_dense_ranked")
      .replace("SELECT qid,idx,score,rank,1 FROM sparse_ranked", "SELECT qid//100,qid%100,idx,score,rank,1 FROM v_sparse_ranked"))
again("pool_head")
again("pool")
_own = BLOCKS.pop("v_qroots")
again("pairs")
again("affinity")
BLOCKS["v_qroots"] = _own
block("v_matched", ("v_pairs", "v_qroots"), f"""
  SELECT p.qid, p.idx, v.qid AS vid, p.roots, {inter('v.qroots', 'p.title_roots')}::DOUBLE/v.qn AS title, v.qn, v.nn,
         list_filter(v.qroots, lambda t: list_contains(p.roots,t)) AS m FROM v_pairs p JOIN v_qroots v ON v.qid//100=p.qid""")
block("v_occ", ("v_matched",), """
  SELECT qid, idx, vid, ix, list_position(m[1:5], root) AS slot, least(5,len(m)) AS need FROM (
    SELECT qid, idx, vid, m, unnest(roots) AS root, generate_subscripts(roots,1) AS ix FROM v_matched) WHERE list_contains(m[1:5],root)""")
block("v_spans", ("v_occ",), BLOCKS["spans"][1].replace("qid, idx", "qid, idx, vid").replace("qid,idx", "qid,idx,vid").replace("FROM occ", "FROM v_occ")
      .replace("GROUP BY 1,2", "GROUP BY 1,2,3"))
block("v_best", ("v_matched", "v_spans"), f"""
  SELECT qid, idx, max(CASE WHEN len(m)>0 THEN round({coverage('len(m)', _numeric, 'qn', 'nn')},12) ELSE 0.0 END) AS lexical_coverage,
         max(CASE WHEN len(m)>0 THEN title ELSE 0.0 END) AS title_coverage, max({_proximity}) AS term_proximity
  FROM v_matched LEFT JOIN v_spans USING (qid,idx,vid) GROUP BY 1,2""")
block("v_features", ("v_pairs", "v_best", "v_affinity"), features(
    "b.lexical_coverage, b.title_coverage, b.term_proximity", "v_pairs p JOIN v_best b USING (qid,idx) LEFT JOIN v_affinity"))
again("signals")
again("scored")
again("hits5")
