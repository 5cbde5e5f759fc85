"""DuckDB statements for the operators that SQL expresses."""

_COMPONENTS = """
  walk(id, seen) AS (SELECT id, id FROM nodes UNION SELECT w.id, e.b FROM walk w JOIN edges e ON e.a = w.seen),
  comp AS (SELECT id, min(seen) AS component_id FROM walk GROUP BY id)
"""

OP1 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
  edges AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
    WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
  nodes AS (SELECT DISTINCT a AS id FROM edges), {_COMPONENTS}
SELECT m.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.component_id, m.vec_id) AS component_id,
       m.vec_id = coalesce(c.component_id, m.vec_id) AS kept
FROM embeddings m LEFT JOIN (SELECT a, count(*) AS n FROM edges GROUP BY a) n ON n.a = m.vec_id LEFT JOIN comp c ON c.id = m.vec_id
"""

OP5 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
 one AS (
  SELECT *, role || chr(10) || text || chr(10) AS said,
    '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS bare,
    '<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10) AS safe FROM t),
 conv AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(said, '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    bool_or(contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR regexp_matches(text, '<\\+\|')) AS conflict,
    sum(length(bare)) AS n_bare, sum(length(safe)) AS n_safe FROM one GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  (CASE WHEN conflict THEN n_safe ELSE n_bare END)::BIGINT AS formatted_chars FROM conv
"""

OP7 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
   ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w),
 x AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
   AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) GROUP BY ALL),
 link AS (SELECT a, b FROM p WHERE 100 * common >= 75 * (na + nb - common)),
 edges AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
 nodes AS (SELECT DISTINCT a AS id FROM edges), {_COMPONENTS}
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id FROM s LEFT JOIN comp c ON c.id = s.doc_id
"""

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP9 = f"""
WITH i AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark),
 win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda k: array_to_string(w[k:k+9], ' '))) AS g FROM i WHERE len(w) > 0),
 d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
 lens AS (SELECT DISTINCT n FROM win),
 dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p0, w FROM d, lens WHERE len(w) >= n),
 hit AS (SELECT dw.doc_id, dw.p0, dw.n, win.item_id FROM dw JOIN win ON win.n = dw.n AND win.g = array_to_string(dw.w[dw.p0:dw.p0 + dw.n - 1], ' ')),
 pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(p0, p0 + n)) AS p FROM hit) GROUP BY doc_id),
 ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


OP6 = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
 c AS (SELECT r, b, substring(h, 2 * 1024 * b + 1, 2 * (1024 + 199)) AS s FROM (SELECT r, h, unnest(range(0, (n - 200) // 1024 + 1)) AS b FROM d WHERE n >= 200)),
 w AS MATERIALIZED (SELECT r, 1024 * b + k AS k, hash(substring(s, 2 * k + 1, 400)) AS x FROM (SELECT r, b, s, unnest(range(0, least(1024, length(s) // 2 - 199))) AS k FROM c)),
 hit AS (SELECT r, k FROM w SEMI JOIN (SELECT x FROM w GROUP BY x HAVING count(*) > 1) t USING (x)),
 isle AS (SELECT r, k, sum(CASE WHEN k > prev + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY k) AS g FROM (SELECT r, k, lag(k) OVER (PARTITION BY r ORDER BY k) AS prev FROM hit)),
 span AS (SELECT r, min(k) AS a, max(k) + 200 AS b FROM isle GROUP BY r, g),
 gone AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM span GROUP BY r),
 gap AS (SELECT r, a, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS f FROM span),
 kept AS (SELECT gap.r, string_agg(substring(d.h, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) AS s FROM gap JOIN d ON d.r = gap.r GROUP BY gap.r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN h ELSE kept.s || substring(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN gone ON gone.r = d.r LEFT JOIN kept ON kept.r = d.r
"""


OP13 = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
 d AS (SELECT doc_id, t, length(t) AS n, list_transform(range(0, 4), lambda k: ('0x' || substr(h, 8 * k + 1, 8))::BIGINT) AS h FROM h),
 c AS (SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
   CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
 p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def runs_statement(longest: int = 8192) -> str:
    """Runs by another way than the engine's: in a run of period q, a window of k words (q <= k, and k no more than the
    overlap) occurs again first after q words, so runs are stretches of places with one distance to the next occurrence.
    Windows double from 16 words; periods up to ``longest`` are covered (texts of three times as many words)."""
    ctes, k = [], 1
    while k < longest:
        ctes.append(f"h{2 * k} AS MATERIALIZED (SELECT r, i, CASE WHEN lead(h, {k}) OVER w IS NOT NULL THEN hash(h, lead(h, {k}) OVER w) END AS h FROM h{k} WINDOW w AS (PARTITION BY r ORDER BY i))")
        k *= 2
    ends, k = [], 16
    while k <= longest:
        least = 1 if k == 16 else k // 2 + 1
        ends.append(f"SELECT r, i, {k} AS k, q FROM (SELECT r, i, lead(i) OVER (PARTITION BY r, h ORDER BY i) - i AS q FROM h{k} WHERE h IS NOT NULL) WHERE q BETWEEN {least} AND {k}")
        k *= 2
    byte = "list_concat([ascii(c)], [0, 0, 0, 0, 0, 0, 0])"
    bits = f"flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: {byte}))"
    crc = f"xor(list_reduce({bits}::BIGINT[], lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384), 4294967295::BIGINT), 4294967295::BIGINT)"
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {crc} AS c, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 g AS (SELECT *, (c // 10) % greatest(len(w), 1) AS a, (c // 10) % 8 AS m FROM d),
 l AS MATERIALIZED (SELECT r, doc_id, CASE WHEN c % 10 = 0 AND len(w) > 0 THEN list_transform(range(0, len(w)), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (len(w) - a) // (3 + m)) + 1] END) ELSE w END AS w FROM g),
 x AS MATERIALIZED (SELECT r, unnest(range(0, len(w))) AS i, unnest(w) AS w FROM l),
 h1 AS MATERIALIZED (SELECT r, i, hash(w) AS h FROM x),
 {", ".join(ctes)},
 nx AS ({" UNION ALL ".join(ends)}),
 isle AS (SELECT r, k, q, i, i - row_number() OVER (PARTITION BY r, k, q ORDER BY i) AS g FROM nx),
 runs AS MATERIALIZED (SELECT r, min(i) AS s, max(i) - min(i) + k + q AS n, q FROM isle GROUP BY r, k, q, g HAVING max(i) - min(i) + k + q >= greatest(24, 3 * q)),
 best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY n::DOUBLE / q DESC, s, q) = 1),
 said AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY r),
 gone AS (SELECT DISTINCT r, unnest(range(s + q, s + n)) AS i FROM runs),
 kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS t FROM x ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT l.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.n::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.n // best.q)::BIGINT AS exponent_milli,
  sha256(coalesce(said.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM l LEFT JOIN best ON best.r = l.r LEFT JOIN said ON said.r = l.r LEFT JOIN kept ON kept.r = l.r
"""


def license_statement() -> str:
    """The licence scan: the template weights are a table of values, all else is relational."""
    from gridloom.llm import license_scan as ls

    rows, idf, rare = ls.weights()
    text = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({text(n)}, {k}, {text(w)}, {u!r}::DOUBLE)" for n, k, w, u in rows)
    weights = ", ".join(f"({text(w)}, {x!r}::DOUBLE)" for w, x in idf.items())
    kinds = ", ".join(f"({text(n)}, {k}, {[*has]}::VARCHAR[], {text(f)})" for n, k, has, f in ls.variants())
    # The end of a holder is consumed and put back, where the engine looks ahead; sentence ends likewise.
    holder = ls.HOLDER.replace("(?=", "(")
    sentences = lambda t, ends=".;!?": f"string_split(regexp_replace({t}, '([{ends}])[ \\t\\r\\n\\f\\v]+', '\\1' || chr(1), 'g'), chr(1))"
    return rf"""
WITH tpl(license, k, w, u) AS (VALUES {templates}), idfs(w, idf) AS (VALUES {weights}), kinds(license, k, has, family) AS (VALUES {kinds}),
 f AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text, coalesce(source, '-') || '/' || coalesce(lang, '-') || '/' || coalesce((doc_id // 64)::VARCHAR || '/', '') AS dir,
   CASE WHEN coalesce(regexp_matches(regexp_extract(text, '^\s*([^\r\n]*)', 1), {text(ls.CUE)}), false) THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END AS name FROM documents),
 n AS MATERIALIZED (SELECT r, doc_id, text, string_split(dir || name, '/') AS parts FROM f),
 cl AS MATERIALIZED (SELECT r, regexp_replace(text, {text(ls.MARKS)}, '\1', 'g') AS t FROM f WHERE regexp_matches(text, {text(ls.CUE)})),
 a AS (SELECT r, regexp_split_to_array(t, '[\r\n]+') AS a FROM cl),
 c AS (SELECT r, a[i] AS t, concat_ws(' ', a[i], a[i + 1]) AS two, concat_ws(' ', CASE WHEN i > 1 THEN a[i - 1] END, a[i], a[i + 1]) AS near FROM (SELECT r, a, unnest(range(1, len(a) + 1)) AS i FROM a) WHERE regexp_matches(a[i], {text(ls.CUE)})),
 pa AS (SELECT r, p FROM (SELECT r, trim(regexp_replace(unnest(regexp_split_to_array(t, {text(ls.PARAGRAPH)})), {text(ls.BLANKS)}, ' ', 'g'), ' ') AS p FROM cl) WHERE regexp_matches(p, {text(ls.CUE)})),
 p AS (SELECT DISTINCT r, t, near FROM (SELECT r, t, near FROM c UNION ALL SELECT r, two, near FROM c UNION ALL SELECT r, p, p FROM pa UNION ALL
   SELECT r, s, near FROM (SELECT r, near, unnest({sentences("t")}) AS s FROM c) WHERE regexp_matches(s, {text(ls.CUE)}) UNION ALL
   SELECT r, s, s FROM (SELECT r, unnest({sentences("p", ".!?")}) AS s FROM pa) WHERE regexp_matches(s, {text(ls.CUE)}) UNION ALL
   SELECT r, 'SPDX-License-Identifier: ' || s, s FROM (SELECT r, unnest(regexp_split_to_array(regexp_extract(t, {text(ls.SPDX)}, 1), {text(ls.EITHER)})) AS s FROM c) WHERE s <> '')),
 q AS MATERIALIZED (SELECT row_number() OVER () AS line, r, near,
   regexp_extract_all(replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, {text(ls.OWNER)}, 'owned \1', 'g'), {text(holder)}, 'copyright \1', 'g'), {text(ls.CLAUSES)}, 'clause\1', 'g'), {text(ls.FREE)}, 'noattribution', 'g')), 'licence', 'license'), {text(ls.WORD)}) AS said FROM p),
 w AS (SELECT line, r, unnest(said) AS w FROM q),
 x AS (SELECT line, r, w.w, count(*) * any_value(coalesce(idf, {rare!r})) AS x FROM w LEFT JOIN idfs ON idfs.w = w.w GROUP BY line, r, w.w),
 norm AS (SELECT line, sqrt(sum(x * x)) AS norm FROM x GROUP BY line),
 cos AS (SELECT d.line, d.r, d.license, d.k, round(d.dot / norm, 6) AS score FROM (SELECT line, r, license, k, sum(x * u) AS dot FROM x JOIN tpl ON tpl.w = x.w GROUP BY ALL) d JOIN norm ON norm.line = d.line),
 ok AS (SELECT cos.r, cos.license, family, score FROM cos JOIN kinds ON kinds.license = cos.license AND kinds.k = cos.k JOIN q ON q.line = cos.line
   WHERE score >= {ls.MIN_SCORE} AND len(list_filter(list_concat(list_intersect(said, {[*ls.VARIANTS]}), regexp_extract_all(lower(near), '\b(?:lesser|affero)\b')), lambda v: NOT list_contains(has, v))) = 0),
 fam AS (SELECT r, license, score FROM ok QUALIFY row_number() OVER (PARTITION BY r, family ORDER BY license = {text(ls.RESERVED)}, score DESC, license) = 1),
 best AS (SELECT r, license, score FROM fam QUALIFY row_number() OVER (PARTITION BY r ORDER BY license = {text(ls.RESERVED)}, score DESC, license) = 1),
 every AS (SELECT fam.r, string_agg(fam.license, ',' ORDER BY fam.license) AS licenses FROM fam JOIN best USING (r) WHERE fam.license <> {text(ls.RESERVED)} OR best.license = {text(ls.RESERVED)} GROUP BY fam.r),
 named AS MATERIALIZED (SELECT n.r, doc_id, license, score, parts[-1] AS base, parts[:-2] AS dir FROM n LEFT JOIN best USING (r)),
 owned AS (SELECT dir, license FROM named WHERE license IS NOT NULL AND regexp_matches(base, {text(ls.LICENSE_FILE)}) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1),
 up AS (SELECT r, dir[:k] AS dir, k FROM (SELECT r, dir, unnest(range(0, len(dir) + 1)) AS k FROM named WHERE license IS NULL)),
 near AS (SELECT up.r, owned.license, array_to_string(up.dir, '/') AS inherited FROM up JOIN owned ON owned.dir = up.dir QUALIFY row_number() OVER (PARTITION BY up.r ORDER BY k DESC) = 1)
SELECT doc_id, named.license AS own_license, licenses AS own_licenses, score AS own_score, coalesce(named.license, near.license) AS license, inherited AS inherited_from FROM named LEFT JOIN near USING (r) LEFT JOIN every USING (r)
"""


ORACLES = {"op1_embedding_neardup": OP1, "op2_license_scan": license_statement(), "op5_chat_format": OP5, "op6_suffix_dedup": OP6, "op7_ngram_jaccard": OP7, "op9_decontaminate": OP9, "op11_period_runs": runs_statement(), "op13_fill_middle": OP13}
