"""Common table expressions of the SQL twins.

They restate the operators independently, in the dialect of the checking engine:
text windows by ``substr``, joins instead of in-row searches, plain list maths.
``\\s`` there is ASCII-only, which is enough for the given tables.
"""

from __future__ import annotations

from lexweave.catalog.inputs import PAGE_CHARS, SMOKE_QUESTIONS, TURNS_PER_DOCUMENT
from lexweave.functions.citations import INSUFFICIENT
from lexweave.operators.enrich import LAW_PASSED_DATES, REGULATION_FAMILIES


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def squeeze(text: str) -> str:
    return strip(rf"regexp_replace({text}, '\s+', ' ', 'g')")


def cut(text: str, heading: str, flags: str = "m") -> str:
    return (
        rf"string_split(regexp_replace({text}, '(?{flags})({heading})', "
        r"chr(1) || '\1', 'g'), chr(1))"
    )


def hard(text: str) -> str:
    return (
        f"CASE WHEN length({text}) > 900 THEN list_transform(range(0, length({text}), 850), "
        f"lambda s: substr({text}, s + 1, 900)) ELSE [{text}] END"
    )


def constant(key: str, values: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items())
    return f"CASE {key} {cases} END"


LEGAL = rf"""
turns AS (
  SELECT conv_id, turn, turn // {TURNS_PER_DOCUMENT} AS section, concat(
      CASE WHEN turn % 3 = 2 THEN e'EN\nL 119/1\n4.5.2016\n' ELSE '' END,
      'Article ', CAST(turn + 1 AS VARCHAR), e'\nTitle of ', role, e'\n',
      CASE WHEN conv_id % 2 = 0
           THEN array_to_string(list_transform(string_split(text, e'\n'),
                  lambda x, i: concat(CAST(i AS VARCHAR), '. ', x)), e'\n')
           ELSE text END) AS article
  FROM conversations),
bodies AS (
  SELECT conv_id, section, string_agg(article, e'\n' ORDER BY turn) AS body
  FROM turns GROUP BY conv_id, section),
legal_texts AS (
  SELECT concat(
      CASE conv_id WHEN 0 THEN '32014L0065' WHEN 1 THEN '32015L2366'
                   WHEN 2 THEN '32016R0679' WHEN 3 THEN '32024L1640'
                   WHEN 4 THEN '32024R1689'
                   ELSE concat('3', CAST(conv_id AS VARCHAR), 'R') END,
      CASE WHEN section > 0 THEN concat('-', CAST(section AS VARCHAR)) ELSE '' END,
      '_EN') AS document_id,
    concat('REGULATION (EU) 2016/', CAST(conv_id AS VARCHAR),
      e' OF THE EUROPEAN PARLIAMENT AND OF THE COUNCIL\nof ',
      CAST(conv_id % 31 + 1 AS VARCHAR), e' April 2016\n(Sample Data Act)\n',
      CASE WHEN conv_id % 10 = 8 THEN replace(body, 'Article ', 'Clause ') ELSE body END,
      CASE WHEN conv_id % 4 = 0
           THEN concat(e'\nANNEX I\n', substr(body, 1, 1200), e'\nANNEX II\nshort annex')
           ELSE '' END) AS full_text
  FROM bodies),
legal_pages AS (
  SELECT document_id, concat(document_id, '.pdf') AS file_name,
    CAST(p // {PAGE_CHARS} + 1 AS INTEGER) AS page_number,
    substr(full_text, p + 1, {PAGE_CHARS}) AS page_text,
    length(substr(full_text, p + 1, {PAGE_CHARS}))::INTEGER AS char_count,
    'text' AS extraction_method
  FROM (SELECT *, unnest(range(0, length(full_text), {PAGE_CHARS})) AS p FROM legal_texts)),
legal_documents AS (
  SELECT document_id, file_name, string_agg(page_text, e'\n' ORDER BY page_number) AS full_text
  FROM legal_pages GROUP BY document_id, file_name)
"""

PLAIN = """
plain_documents AS (
  SELECT concat('doc-', CAST(doc_id AS VARCHAR)) AS document_id,
    concat('doc-', CAST(doc_id AS VARCHAR), '.txt') AS file_name, text AS full_text
  FROM documents)
"""

BRONZE = f"""
bronze AS (
  SELECT document_id, file_name,
    concat('/data/regulations/raw/', file_name) AS source_path,
    'EUR-Lex' AS source_name,
    {constant("document_id", REGULATION_FAMILIES)} AS regulation_family,
    'pdf' AS file_type, 'new' AS status
  FROM legal_pages WHERE page_number = 1)
"""


def clean(text: str) -> str:
    out = rf"replace(replace({text}, chr(173), ''), chr(65534), '')"
    for line in (
        r"\d{1,2}\.\d{1,2}\.\d{4}",
        r"L \d+/\d+",
        "EN",
        "Official Journal of the European Union",
    ):
        out = rf"regexp_replace({out}, '(?m)^\s*{line}\s*$', '', 'g')"
    out = rf"regexp_replace({out}, '[ \t]+', ' ', 'g')"
    out = rf"regexp_replace({out}, '\n{{3,}}', e'\n\n', 'g')"
    return strip(out)


TITLE = (
    r"list_filter(list_filter(list_transform(string_split(article, e'\n'), "
    rf"lambda x: {strip('x')}), lambda x: x <> '')[2:4], lambda x: length(x) <= 150 "
    r"AND NOT regexp_matches(x, '^(\d+\.|\(\d+\)|L \d+/\d+)') "
    r"AND NOT contains(x, 'Official Journal') AND x <> 'EN')[1]"
)

FINGERPRINT = (
    "lower("
    + squeeze(
        r"""CASE
      WHEN part_index > 0 AND article_number <> ''
        THEN coalesce(nullif(regexp_extract(chunk_text,
               '(?s)((?:\([\p{L}\p{N}_]+\)|\d+\.)\s.*)', 1), ''), chunk_text)
      WHEN chunk_type = 'article' AND article_number <> ''
           AND strpos(chunk_text, 'Article ' || article_number) > 0
        THEN substr(chunk_text, strpos(chunk_text, 'Article ' || article_number))
      WHEN chunk_type = 'annex' AND annex_number <> ''
           AND strpos(chunk_text, 'ANNEX ' || annex_number) > 0
        THEN substr(chunk_text, strpos(chunk_text, 'ANNEX ' || annex_number))
      ELSE chunk_text END"""
    )
    + ")"
)


def chunks(documents: str) -> str:
    """Chunk rows of a document CTE: ``structured``, ``article_rows``,
    ``annex_rows``, ``fallback_rows`` and ``chunks``."""
    return rf"""
cleaned AS (SELECT document_id, file_name, {clean("full_text")} AS cleaned FROM {documents}),
halves AS (
  SELECT *, {cut("cleaned", r"^\s*ANNEX(?:ES)?\b")} AS hs FROM cleaned),
structured AS (
  SELECT document_id, file_name, cleaned,
    regexp_replace(hs[1], '\s+$', '') AS body,
    {strip("array_to_string(hs[2:], '')")} AS annex
  FROM halves),
cut_bodies AS (
  SELECT document_id, file_name, body,
    {cut("body", r"^\s*Article\s+\d+[A-Za-z]?\s*$", "mi")} AS segs
  FROM structured),
located AS (
  SELECT *, segs[i] AS raw,
    CASE WHEN i > 2 THEN right(array_to_string(segs[1:i-1], ''), 50) ELSE '' END AS overlap
  FROM (SELECT *, unnest(range(2, len(segs) + 1)) AS i FROM cut_bodies)),
articles AS (
  SELECT document_id, file_name, i - 1 AS article_index, overlap, raw,
    regexp_extract(raw, '(?mi)^\s*Article\s+(\d+[A-Za-z]?)\s*$', 1) AS article_number,
    {strip("raw")} AS article
  FROM located),
titled AS (SELECT *, {TITLE} AS title FROM articles),
paragraphs AS (
  SELECT *, concat('Article ', article_number, coalesce(' ' || title, '')) AS header,
    string_split(regexp_replace(article, '\n((?:\([A-Za-z0-9]+\)|\d+\.)\s)',
      chr(1) || '\1', 'g'), chr(1)) AS ps
  FROM titled),
packed AS (
  SELECT *, list_reduce(
    list_transform(ps[3:], lambda p: {{'done': []::VARCHAR[], 'open': p}}),
    lambda acc, x: CASE WHEN length(acc.open) + length(x.open) + 1 <= 900
      THEN {{'done': acc.done, 'open': acc.open || e'\n' || x.open}}
      ELSE {{'done': acc.done || [acc.open], 'open': header || e'\n' || x.open}} END,
    {{'done': []::VARCHAR[], 'open': array_to_string(ps[1:2], e'\n')}}) AS folded
  FROM paragraphs),
article_parts AS (
  SELECT *, CASE WHEN length(article) <= 900 THEN [overlap || raw]
    WHEN len(ps) <= 1 THEN {hard("article")}
    ELSE flatten(list_transform(folded.done || [folded.open], lambda g: {hard("g")})) END
    AS parts
  FROM packed),
article_rows AS (
  SELECT document_id, file_name, article_index AS major, 'article' AS chunk_type,
    article_number, NULL::VARCHAR AS annex_number, title,
    (generate_subscripts(parts, 1) - 1)::INTEGER AS part_index,
    len(parts)::INTEGER AS part_count, {squeeze("unnest(parts)")} AS chunk_text
  FROM article_parts),
cut_annexes AS (
  SELECT document_id, file_name, annex,
    {cut("annex", r"^\s*ANNEX(?:ES)?\s+[IVX]*\s*$")} AS segs
  FROM structured WHERE annex <> ''),
annexes AS (
  SELECT document_id, file_name, 0 AS annex_index, NULL::VARCHAR AS annex_number, annex AS text
  FROM cut_annexes WHERE len(segs) = 1
  UNION ALL
  SELECT document_id, file_name, i - 1, nullif(regexp_extract(segs[i],
    '(?m)^\s*ANNEX(?:ES)?\s+([IVX]+)?\s*$', 1), ''), {strip("segs[i]")}
  FROM (SELECT *, unnest(range(2, len(segs) + 1)) AS i FROM cut_annexes WHERE len(segs) > 1)),
annex_parts AS (SELECT *, {hard("text")} AS parts FROM annexes),
annex_rows AS (
  SELECT document_id, file_name, annex_index AS major, 'annex' AS chunk_type,
    NULL::VARCHAR AS article_number, annex_number,
    'Annex' || coalesce(' ' || annex_number, '') AS title,
    (generate_subscripts(parts, 1) - 1)::INTEGER AS part_index,
    len(parts)::INTEGER AS part_count, {squeeze("unnest(parts)")} AS chunk_text
  FROM annex_parts),
fallback_windows AS (
  SELECT document_id, file_name, s, {squeeze("substr(body, s + 1, 900)")} AS chunk_text
  FROM (SELECT *, unnest(range(0, length(body), 750)) AS s FROM cut_bodies WHERE len(segs) = 1)),
fallback_rows AS (
  SELECT document_id, file_name, s AS major, 'fallback' AS chunk_type,
    NULL::VARCHAR AS article_number, NULL::VARCHAR AS annex_number, NULL::VARCHAR AS title,
    0::INTEGER AS part_index, 1::INTEGER AS part_count, chunk_text
  FROM fallback_windows WHERE chunk_text <> ''),
numbered AS (
  SELECT *, (row_number() OVER (PARTITION BY document_id
    ORDER BY is_annex, major, part_index) - 1)::INTEGER AS chunk_id
  FROM (SELECT 0 AS is_annex, * FROM article_rows
        UNION ALL SELECT 0, * FROM fallback_rows
        UNION ALL SELECT 1, * FROM annex_rows)),
chunks AS (
  SELECT concat(document_id,
      CASE WHEN chunk_type = 'article' AND article_number <> ''
             THEN concat('_art_', article_number, '_p_', part_index)
           WHEN chunk_type = 'annex' AND annex_number <> ''
             THEN concat('_ann_', annex_number, '_p_', part_index)
           ELSE concat('_chunk_', chunk_id) END) AS chunk_uid,
    document_id, file_name, chunk_id, chunk_type, article_number, annex_number, title,
    part_index, part_count, chunk_text, length(chunk_text)::INTEGER AS char_length
  FROM numbered)
"""


TAGGED = f"""
marked AS (SELECT document_id, chunk_id, {FINGERPRINT} AS mark FROM chunks),
page_forms AS (
  SELECT document_id, page_number, lower({squeeze("page_text")}) AS form FROM legal_pages),
pages_found AS (
  SELECT m.document_id, m.chunk_id,
    (min(CASE WHEN contains(form, substr(mark, 1, 200)) THEN 0
              WHEN contains(form, substr(mark, 1, 100)) THEN 1
              ELSE 2 END * 1000000000::BIGINT + page_number) % 1000000000)::INTEGER
      AS page_number
  FROM marked m JOIN page_forms p
    ON m.document_id = p.document_id AND contains(form, substr(mark, 1, 50))
  WHERE mark <> '' GROUP BY m.document_id, m.chunk_id),
silver AS (
  SELECT chunk_uid, document_id, file_name, chunk_id, page_number, chunk_type,
    article_number, annex_number, title, part_index, part_count, chunk_text, char_length,
    CAST({constant("document_id", LAW_PASSED_DATES)} AS DATE) AS law_passed_date
  FROM chunks LEFT JOIN pages_found USING (document_id, chunk_id)),
gold AS (
  SELECT silver.*, source_path, source_name, regulation_family
  FROM silver LEFT JOIN bronze USING (document_id))
"""

META = rf"""
first_pages AS (
  SELECT document_id, {squeeze("page_text")} AS t FROM legal_pages WHERE page_number = 1),
meta_parts AS (
  SELECT document_id, t,
    coalesce(nullif(regexp_extract(t, '\(EU\)\s+(\d{{4}}/\d+(?:/EU)?)', 1), ''),
      nullif(regexp_extract(t, '(?:REGULATION|DIRECTIVE)\s+(\d{{4}}/\d+/EU)', 1), ''))
      AS document_version,
    nullif(regexp_extract(t, '\bof\s+(\d{{1,2}}\s+[\p{{L}}\p{{N}}_]+\s+\d{{4}})\b', 1), '')
      AS date_text,
    nullif(regexp_extract(t,
      '\(([A-Z][A-Za-z\s\-]+(?:Act|Regulation|Directive|Framework|Mechanism))\)', 1), '')
      AS short_title,
    nullif(regexp_extract(t, '^(REGULATION|DIRECTIVE)', 1), '') AS kind
  FROM first_pages),
meta AS (
  SELECT document_id,
    coalesce(short_title, concat(upper(kind[1]), lower(kind[2:])) || ' ' || document_version)
      AS regulation_title,
    document_version,
    CAST(try_strptime(date_text, '%d %B %Y') AS DATE) AS law_passed_date,
    CASE WHEN contains(t, 'EUROPEAN PARLIAMENT AND OF THE COUNCIL')
      THEN 'European Parliament and Council of the European Union' END AS issuing_authority
  FROM meta_parts),
rag_chunks AS (
  SELECT chunk_uid, document_id, file_name, chunk_id, chunk_type, article_number,
    annex_number, title, chunk_text, page_number, part_index, part_count, char_length,
    meta.law_passed_date, regulation_title, document_version, issuing_authority
  FROM silver LEFT JOIN meta USING (document_id))
"""


def embedding(text: str) -> str:
    """The feature-hashing vector of a text expression."""
    return f"""list_transform([{{'cs': list_transform([list_transform(
      regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'),
      lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64)],
      lambda bs: list_transform(range(0, 64),
        lambda d: CAST(len(list_filter(bs, lambda b: b = d)) AS DOUBLE)))[1]}}],
      lambda h: list_transform(h.cs, lambda c:
        CASE WHEN list_dot_product(h.cs, h.cs) > 0
             THEN CAST(c / sqrt(list_dot_product(h.cs, h.cs)) AS FLOAT)
             ELSE CAST(0 AS FLOAT) END))[1]"""


def doubles(vector: str) -> str:
    return f"CAST({vector} AS DOUBLE[])"


def cosine(a: str, b: str) -> str:
    """Rounded cosine of two double lists of equal length."""
    return (
        f"round(CASE WHEN list_dot_product({a}, {a}) > 0 AND list_dot_product({b}, {b}) > 0 "
        f"THEN list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) "
        f"* sqrt(list_dot_product({b}, {b}))) ELSE 0.0 END, 9)"
    )


def vector_facts(vector: str = "embedding") -> str:
    return (
        f"CAST(len({vector}) AS INTEGER) AS dims, "
        f"CAST(len(list_filter({vector}, lambda x: x <> 0)) AS INTEGER) AS non_zero, "
        f"round(coalesce(list_sum(list_transform({vector}, "
        f"lambda x, i: CAST(x AS DOUBLE) * i)), 0.0), 4) AS weighted_sum"
    )


QUESTIONS = f"""
questions AS (SELECT item_id AS query_id, text AS question FROM benchmark),
asked AS (
  SELECT query_id, question, {doubles(embedding("question"))} AS qv FROM questions)
"""

SMOKE = f"""
smoke AS (SELECT * FROM (VALUES {", ".join(
    f"(CAST({i} AS BIGINT), '{q}')" for i, q in enumerate(SMOKE_QUESTIONS)
)}) AS q(query_id, question)),
asked AS (SELECT query_id, question, {doubles(embedding("question"))} AS qv FROM smoke)
"""


def ranked(chunk_rows: str, top_k: int) -> str:
    """Top k of the ``asked`` questions over a chunk CTE, as ``hits``."""
    return f"""
embedded AS MATERIALIZED (
  SELECT *, {doubles(embedding("chunk_text"))} AS v FROM {chunk_rows}),
scored AS (
  SELECT a.query_id, a.question, e.* EXCLUDE (v), {cosine("a.qv", "e.v")} AS score
  FROM asked a, embedded e),
hits AS (
  SELECT *, 1.0 - score AS distance FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY score DESC, chunk_uid, chunk_id)::INTEGER AS rank FROM scored)
  WHERE rank <= {top_k})
"""


CENTROIDS = """
components AS (
  SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m
  FROM embeddings, range(1, 65) r(i) GROUP BY label, i),
centroids AS (SELECT label AS query_id, list(m ORDER BY i) AS qv FROM components GROUP BY label),
mean_vector AS (
  SELECT list(m ORDER BY i) AS qv FROM (
    SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS m
    FROM embeddings, range(1, 65) r(i) GROUP BY i))
"""

CENTROID_SCORES = f"""
scored AS (
  SELECT query_id, vec_id, label, {cosine("qv", doubles("embedding"))} AS score
  FROM embeddings, centroids),
numbered_scores AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER
    AS rank FROM scored)
"""

ANSWERS = rf"""
answers AS (
  SELECT conv_id, turn, concat(CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)) AS answer_id,
    concat(text, CASE WHEN conv_id % 5 = 4 THEN ' {INSUFFICIENT}.' ELSE '' END,
      ' [Document: Act ', CAST(conv_id AS VARCHAR), ', Article 1, page ',
      CAST(turn % 5 AS VARCHAR), e'] "quoted" & <plain>\n',
      '[Source: Excerpt #1, Page ', CAST(turn % 5 + 2 AS VARCHAR), ', end] ',
      '[Source: Excerpt #2]') AS answer
  FROM conversations WHERE role = 'assistant'),
retrieved AS (
  SELECT answer_id, rank,
    CASE WHEN rank = 4 AND conv_id % 3 = 0 THEN NULL
         ELSE CAST((turn + rank) % 3 AS INTEGER) END AS page,
    concat('act', CAST(conv_id AS VARCHAR), '-', CAST(rank AS VARCHAR), '.pdf') AS source_file,
    CASE WHEN rank % 2 = 0 THEN NULL ELSE concat('Act ', CAST(conv_id AS VARCHAR)) END
      AS regulation_title,
    CASE WHEN conv_id % 7 = 6 THEN '' ELSE concat('Chunk ', CAST(rank AS VARCHAR)) END AS title
  FROM answers, range(1, 5) r(rank)),
cited AS (
  SELECT answer_id, CAST(pos - 1 AS INTEGER) AS position, cs[pos] AS citation,
    CASE WHEN paged THEN CAST(ps[pos] AS INTEGER) END AS page
  FROM (
    SELECT *, unnest(range(1, len(cs) + 1)) AS pos FROM (
      SELECT answer_id, NOT contains(answer, '{INSUFFICIENT}') AS paged,
        CASE WHEN contains(answer, '{INSUFFICIENT}')
          THEN regexp_extract_all(answer, '(\[(?:Document|Source):[^\]]+\])', 1)
          ELSE regexp_extract_all(answer,
            '(\[(?:Document|Source):[^\]]*?[Pp]age\s+(\d+)[^\]]*?\])', 1) END AS cs,
        regexp_extract_all(answer,
          '(\[(?:Document|Source):[^\]]*?[Pp]age\s+(\d+)[^\]]*?\])', 2) AS ps
      FROM answers))),
page_map AS (
  SELECT answer_id, page, file, title FROM (
    SELECT answer_id, page, source_file AS file,
      coalesce(nullif(regulation_title, ''), nullif(title, ''), '') AS title,
      row_number() OVER (PARTITION BY answer_id, page ORDER BY rank DESC) AS rn
    FROM retrieved WHERE page IS NOT NULL) WHERE rn = 1)
"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


LEGAL_CHUNKS = with_(LEGAL, BRONZE, chunks("legal_documents"), TAGGED, META)
PLAIN_CHUNKS = with_(PLAIN, chunks("plain_documents"))
