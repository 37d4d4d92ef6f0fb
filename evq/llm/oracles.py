"""DuckDB SQL for the queries that SQL can express."""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages),
m AS (SELECT page_id, octet_length(encode(h)) b, sha256(h) d, min(page_id) OVER (PARTITION BY h) o FROM p)
SELECT page_id, b payload_bytes, d payload_digest, CASE WHEN b >= 100 AND page_id <> o THEN 'revisit' ELSE 'response' END record_type,
       CASE WHEN b >= 100 AND page_id <> o THEN o END refers_to
FROM m
"""

MIXING = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') source, coalesce(lang, '') lang, coalesce(text, '') t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) tokens FROM documents),
e AS (SELECT *, length(t) - length(replace(t, chr(10), '')) lines FROM d),
f AS (SELECT doc_id, source, lang, tokens, CASE WHEN tokens < 8 * lines THEN 'list' WHEN tokens < 100 THEN 'note' WHEN tokens < 600 THEN 'article' ELSE 'long' END topic FROM e),
c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE tokens FROM f GROUP BY ALL HAVING sum(tokens) > 0),
a AS (SELECT source, power(sum(tokens), 0.7) g FROM c GROUP BY 1), b AS (SELECT lang, power(sum(tokens), 0.8) g FROM c GROUP BY 1), h AS (SELECT topic, power(sum(tokens), 0.8) g FROM c GROUP BY 1),
r AS (
  SELECT 0 k, source, lang, topic, tokens, tokens / (SELECT sum(tokens) FROM c) share, a.g / (SELECT sum(g) FROM a) ga, b.g / (SELECT sum(g) FROM b) gb, h.g / (SELECT sum(g) FROM h) gh
  FROM c JOIN a USING (source) JOIN b USING (lang) JOIN h USING (topic)
  UNION ALL
  SELECT k, source, lang, topic, tokens, s2 * gh / sum(s2) OVER (PARTITION BY topic), ga, gb, gh FROM (
    SELECT *, s1 * gb / sum(s1) OVER (PARTITION BY lang) s2 FROM (
      SELECT k + 1 k, source, lang, topic, tokens, share * ga / sum(share) OVER (PARTITION BY source) s1, ga, gb, gh FROM r WHERE k < 32))),
p AS (SELECT source, lang, topic, share / tokens / (SELECT max(share / tokens) FROM r WHERE k = 32) p FROM r WHERE k = 32)
SELECT doc_id, topic, tokens::BIGINT tokens, round(coalesce(p, 0), 6) probability, ('0x' || substr(md5(doc_id || ':42'), 1, 13))::UBIGINT / 4503599627370496.0 < coalesce(p, 0) drawn
FROM f LEFT JOIN p USING (source, lang, topic)
"""

CONTAMINATION = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id::VARCHAR item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
bw AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') x FROM (SELECT item, w, least(13, len(w)) m, unnest(range(1, greatest(len(w) - 12, 1) + 1)) i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') x FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT doc_id, i, m, item FROM dw JOIN bw USING (m, x)),
n AS (SELECT doc_id, count(DISTINCT j) n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) j FROM hit) GROUP BY 1),
t AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(items, '')) items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') h, coalesce(lang, '') p, coalesce(text, '') t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM documents),
s AS (
  SELECT doc_id, h, p, unnest([
    {'s': 'symbols', 'a': length(t) - length(translate(t, '#*$%&|<>', '')), 'b': length(t)}, {'s': 'marks', 'a': length(t) - length(replace(t, '!', '')), 'b': length(t)},
    {'s': 'capitals', 'a': length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')), 'b': length(t)}, {'s': 'digits', 'a': length(t) - length(translate(t, '0123456789', '')), 'b': length(t)},
    {'s': 'repeats', 'a': len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])), 'b': len(w)}, {'s': 'distinct', 'a': len(list_distinct(w)), 'b': len(w)}]) f FROM d),
x AS (SELECT doc_id, h, p, f.s s, least(9, length(ltrim(bin((1000 * f.a // greatest(f.b, 1) + 1)::BIGINT), '0')) - 1) bin FROM s),
l AS (SELECT doc_id, sum((quality > 0)::INT) good, sum((quality <= 0)::INT) bad FROM labels WHERE quality IS NOT NULL GROUP BY 1),
c AS (SELECT s, bin, sum(good) g, sum(bad) b FROM x JOIN l USING (doc_id) GROUP BY ALL),
sm AS (SELECT s, z.bin, sum(g * power(0.25, abs(c.bin - z.bin))) + 0.5 g, sum(b * power(0.25, abs(c.bin - z.bin))) + 0.5 b FROM c, (SELECT unnest(range(10)) bin) z GROUP BY ALL HAVING sum(g) > 0 AND sum(b) > 0),
r AS (SELECT s, bin, ln((g / sum(g) OVER (PARTITION BY s)) / (b / sum(b) OVER (PARTITION BY s))) v FROM sm),
e AS (SELECT doc_id, h, p, sum(coalesce(v, 0)) e FROM x LEFT JOIN r USING (s, bin) GROUP BY ALL),
pa AS (SELECT h, p, sum(good)::DOUBLE k, sum(good + bad)::DOUBLE n FROM d JOIN l USING (doc_id) GROUP BY ALL),
ho AS (SELECT h, sum(k) hk, sum(n) hn, sum(n * n) nn FROM pa GROUP BY 1),
g AS (SELECT (sum(hk) + 0.5) / (sum(hn) + 1) mu, sum(hk) k, sum(hn) n, count(*) c FROM ho),
ab AS (SELECT 1 / least(greatest((sum(hn * power(hk / hn - mu, 2)) / any_value(mu * (1 - mu)) - any_value(c)) / greatest(any_value(n - c), 1), 0.0001), 0.9999) - 1 a FROM ho, g),
hs AS (SELECT ho.*, (hk + a * mu) / (hn + a) hs FROM ho, g, ab),
be AS (SELECT 1 / least(greatest((sum(n * power(k / n - hk / hn, 2) / (hs * (1 - hs))) - (count(*) - (SELECT count(*) FROM ho))) /
         greatest((SELECT sum(hn - nn / hn) FROM ho) - (count(*) - (SELECT count(*) FROM ho)), 1), 0.0001), 0.9999) - 1 b FROM pa JOIN hs USING (h)),
o AS (SELECT doc_id, e, coalesce(pa.k, 0) k, coalesce(pa.n, 0) n, coalesce(hk, 0) hk, coalesce(hn, 0) hn, coalesce(good, 0) x, coalesce(good + bad, 0) y
  FROM e LEFT JOIN pa USING (h, p) LEFT JOIN ho USING (h) LEFT JOIN l USING (doc_id)),
q AS (SELECT doc_id, e, (o.k - x + b * (hk - x + a * (g.k - x + 0.5) / (g.n - y + 1)) / (hn - y + a)) / (o.n - y + b) site FROM o, g, ab, be),
z AS (SELECT doc_id, e, least(greatest(site, 0.0001), 0.9999) site FROM q)
SELECT doc_id, round(1 / (1 + exp(-(ln(site / (1 - site)) + e))), 6) p_quality, 1 / (1 + exp(-(ln(site / (1 - site)) + e))) >= 0.5 kept FROM z
"""

EXACT = """
WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) keep_id, count(*) OVER (PARTITION BY t) group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 kept, sha256(t) text_sha256
FROM d
"""

MERKLE = """
WITH RECURSIVE f AS (
  SELECT doc_id, lang, text t, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END ||
    CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END h,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)) c FROM documents),
d AS (
  SELECT doc_id, lang, sha256(h || CASE WHEN t IS NULL THEN '-' ELSE strlen(t) || ':' || t END) leaf,
    CASE WHEN xor(c, 4294967295::BIGINT) % 3 = 0 THEN sha256(h || CASE WHEN t IS NULL THEN '-' ELSE strlen(t) || ':' || translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) END alt FROM f),
p AS (SELECT *, row_number() OVER w - 1 pos, count(*) OVER (PARTITION BY lang) n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 g FROM d WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)),
a AS (
  SELECT 0 k, g, pos, n, leaf h FROM p
  UNION ALL
  SELECT k + 1, g, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM a WHERE n > 1 GROUP BY k, g, pos // 8, n),
s AS (SELECT g, h FROM a WHERE n = 1),
b AS (
  SELECT 0 k, g pos, (SELECT count(*) FROM s) n, h FROM s
  UNION ALL
  SELECT k + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM b WHERE n > 1 GROUP BY k, pos // 8, n),
ra AS (SELECT k, g, pos // 8 run, n, list({'p': pos, 'h': h} ORDER BY pos) l FROM a WHERE n > 1 GROUP BY ALL),
rb AS (SELECT k, pos // 8 run, n, list({'p': pos, 'h': h} ORDER BY pos) l FROM b WHERE n > 1 GROUP BY ALL),
st AS (
  SELECT p.g, p.pos, k, p.pos // (8 ** k)::BIGINT mine, l FROM p JOIN ra ON ra.g = p.g AND run = p.pos // (8 ** (k + 1))::BIGINT
  UNION ALL
  SELECT p.g, p.pos, 100 + k, p.g // (8 ** k)::BIGINT, l FROM p JOIN rb ON run = p.g // (8 ** (k + 1))::BIGINT),
sp AS (
  SELECT g, pos, list({'l': array_to_string(list_transform(list_filter(l, lambda x: x.p < mine), lambda x: x.h), ''), 'r': array_to_string(list_transform(list_filter(l, lambda x: x.p > mine), lambda x: x.h), '')} ORDER BY k) z
  FROM st GROUP BY ALL),
x AS (SELECT doc_id, leaf, alt, s.h subroot, (SELECT h FROM b WHERE n = 1) root, coalesce(z, []) z FROM p JOIN s USING (g) LEFT JOIN sp USING (g, pos)),
y AS (SELECT *, sha256(array_to_string(list_transform(z, lambda e: e.l || e.r), '')) proof_sha256,
  list_reduce(list_prepend({'l': coalesce(alt, leaf), 'r': ''}, z), lambda h, e: {'l': sha256(e.l || h.l || e.r), 'r': ''}).l folded_root FROM x)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root verified FROM y
"""

NEGATIVES = """
WITH v AS (
  SELECT row_number() OVER () r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r ar, a.vec_id anchor_id, a.label = b.label same, b.r, b.vec_id id, list_inner_product(a.q, b.q)::BIGINT score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, id, r) <= 5),
n AS (
  SELECT p.ar, p.r pr, p.anchor_id, p.id positive_id, s.id negative_id, p.score positive_score, s.score negative_score, row_number() OVER (PARTITION BY p.ar, p.r ORDER BY s.score DESC, s.id, s.r)::INT rank
  FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
