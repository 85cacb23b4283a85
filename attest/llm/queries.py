"""The numbered queries and, where SQL can express one, the same in DuckDB's SQL."""

from __future__ import annotations

from attest.llm import conversation_trie, filter_audit
from attest.llm.contamination import op3_contamination
from attest.llm.conversation_trie import op11_conversation_trie
from attest.llm.filter_audit import op12_filter_audit
from attest.llm.jaccard import op8_jaccard
from attest.llm.language import op4_language_id
from attest.llm.pieces import op1_sentencepiece
from attest.llm.pii import op2_pii
from attest.llm.quality import op10_line_quality
from attest.llm.suffix_index import op9_suffix_index
from attest.llm.suffix_tree import op5_suffix_tree
from attest.llm.tokens import op7_token_files
from attest.llm.toxicity import op13_toxicity
from attest.llm.warc import op6_warc

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_pii": op2_pii,
    "op3_contamination": op3_contamination,
    "op4_language_id": op4_language_id,
    "op5_suffix_tree": op5_suffix_tree,
    "op6_warc": op6_warc,
    "op7_token_files": op7_token_files,
    "op8_jaccard": op8_jaccard,
    "op9_suffix_index": op9_suffix_index,
    "op10_line_quality": op10_line_quality,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_filter_audit": op12_filter_audit,
    "op13_toxicity": op13_toxicity,
}

#: Learned, hashed or byte-level results have no SQL; their tests hold them against brute force.
ORACLES = {
    "op11_conversation_trie": conversation_trie.SQL,
    "op12_filter_audit": filter_audit.SQL,
    "op8_jaccard": r"""
        with recursive d as (
          select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
        ), s as (
          select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d
        ), n as (
          select doc_id, count(*) as n from s group by 1
        ), p as (
          select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2
        ), e as (
          select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)
        ), r as (
          select doc_id, doc_id as other from d union select r.doc_id, e.b from r join e on e.a = r.other
        )
        select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id from d left join n using (doc_id) join (select doc_id, min(other) as component_id from r group by 1) m using (doc_id)
    """,
    "op10_line_quality": r"""
        with d as (
          select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
        ), a as (
          select doc_id, t, w, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
            list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d
        ), v as (
          select doc_id, i, array_to_string(w[i:i + 7], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from a)
        ), c as (
          select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 8)) as p from (select doc_id, i, count(*) over (partition by doc_id, g) as k from v) where k > 1) group by 1
        ), l as (
          select doc_id, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) as n, n_symbols > 1 or contains(t, '!!') as marked from (select doc_id, t, n_symbols, unnest(lines) as x from a)
        ), f as (
          select doc_id, sum(n) as n from l where not ((n < 4 and not regexp_matches(x, '[.!?…:;][''")\]»”]*[\x20\x09-\x0D]*$')) or (marked and len(regexp_extract_all(x, '([#*$%&|<>]{2,}|!!)')) >= greatest(1, ceil(n * 0.5)))
            or regexp_matches(lower(x), 'cookie policy|privacy policy|terms of use|terms of service|all rights reserved|click here|subscribe to our|javascript is disabled|share this|licensed under')) group by 1
        ), b as (
          select a.*, coalesce(c.n, 0) as again, coalesce(f.n, 0) as lasting from a left join c using (doc_id) left join f using (doc_id)
        )
        select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(again as bigint) as n_repeat_words,
          n_words < 20 or 100 * again > 30 * n_words as base_failed, not (n_words < 20 or 100 * again > 30 * n_words) and lasting >= n_words * 0.5 as kept from b
    """,
    "op6_warc": """
        with p as (
          select page_id, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
        ), m as (
          select payload_digest, max(page_id) as latest from p where payload_bytes >= 1000 group by payload_digest
        )
        select p.page_id, p.payload_bytes, p.payload_digest,
          case when m.latest is null or m.latest = p.page_id then 'response' else 'revisit' end as record_type,
          case when m.latest is distinct from p.page_id then m.latest end as refers_to
        from p left join m on p.payload_digest = m.payload_digest and p.payload_bytes >= 1000
    """,
}
