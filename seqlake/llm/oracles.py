"""DuckDB SQL of the operators that SQL can express: mixing, license scans, fingerprints, archives, vector codes, resampling,
and the Jaccard join, whose SQL compares all pairs of texts that share a run of words."""

from __future__ import annotations

from . import codes, fingerprint, jaccard, licenses, mixing, resample


def mixing_sql(seed: int = 1) -> str:
    key = lambda *parts: f"md5({" || '/' || ".join([repr(str(seed)), *[f'coalesce(({p})::VARCHAR, chr(1))' for p in parts]])})"
    block = lambda k, n: f"('0x' || substr({k}, 1, 8))::BIGINT % {n}"
    z = lambda a: f"list_sum(list_transform(ps, lambda p: pow(p, {a})))"
    entropy = lambda a: f"ln({z(a)}) - {a} * list_sum(list_transform(ps, lambda p: pow(p, {a}) * ln(p))) / {z(a)}"
    even = lambda a: f"{entropy(a)} < {mixing.ENTROPY} * ln(len(ps)) - 1e-12"
    seldom = lambda a: f"list_max(list_transform(ps, lambda p: pow(p, {a} - 1))) / {z(a)} <= {mixing.MOST}"

    def bisected(name: str, ok) -> str:
        mid = f"{name}.lo + ({name}.hi - {name}.lo) / 2"
        return f"""{name}(k, lo, hi, ps) AS (SELECT 0, 0.0::DOUBLE, CASE WHEN {ok('0.0::DOUBLE')} THEN 0.0 ELSE 1.0 END::DOUBLE, ps FROM l
 UNION ALL SELECT k + 1, CASE WHEN {ok(f'({mid})')} THEN lo ELSE {mid} END, CASE WHEN {ok(f'({mid})')} THEN {mid} ELSE hi END, ps FROM {name} WHERE k < {mixing.HALVINGS} AND hi > 0)"""

    return f"""WITH RECURSIVE t AS (SELECT doc_id, source, CASE WHEN x = '' THEN 0 ELSE len(x) - len(replace(x, ' ', '')) + 1 END AS tokens FROM (SELECT doc_id, source, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS x FROM documents)),
 s AS (SELECT source, count(*) AS docs, sum(tokens)::BIGINT AS tokens FROM t GROUP BY source HAVING sum(tokens) > 0), l AS (SELECT list(tokens / (SELECT sum(tokens) FROM s) ORDER BY source) AS ps FROM s),
 {bisected('u', even)}, {bisected('v', seldom)}, a AS (SELECT CASE WHEN (SELECT count(*) FROM s) = 1 THEN 1.0 ELSE greatest((SELECT arg_max(hi, k) FROM u), (SELECT arg_max(hi, k) FROM v)) END AS a),
 w AS (SELECT source, docs, tokens, pow(tokens / (SELECT sum(tokens) FROM s), a.a) / {z('a.a')} AS weight FROM s, a, l),
 b AS (SELECT *, floor(weight * (SELECT sum(tokens) FROM s)::DOUBLE)::BIGINT AS budget, docs // {mixing.BLOCK} + 1 AS blocks FROM w),
 r AS (SELECT t.doc_id, t.source, t.tokens, b.weight, b.budget // b.tokens AS full_, b.budget % b.tokens AS rest, {block(key('t.source', 't.doc_id'), 'b.blocks')} AS block FROM t JOIN b ON t.source IS NOT DISTINCT FROM b.source),
 o AS (SELECT *, {key('source', 'full_ + 1', 'block')} AS bk, {key('source', 'full_ + 1', 'doc_id')} AS dk FROM r), c AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY bk, dk) AS run FROM o),
 f AS (SELECT *, full_ + CASE WHEN rest > 0 AND run <= rest THEN 1 ELSE 0 END AS passes FROM c), g AS (SELECT *, unnest(range(1, passes + 1)) AS pass FROM f)
SELECT doc_id, source, pass::INT AS mix_pass, block::BIGINT AS mix_block, tokens::BIGINT AS mix_tokens, round(weight, 9) AS mix_weight, substr({key('source', 'pass', 'block')}, 1, 12) || substr({key('source', 'pass', 'doc_id')}, 1, 20) AS mix_key FROM g"""


def licenses_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({n}, {quoted(label)}, {quoted(pattern)}, {priority}, {quoted(' (?:' + '|'.join(keywords) + ') ')})" for n, (label, pattern, priority, keywords) in enumerate(licenses.rules()))
    phrases = ", ".join(f"({quoted(' ' + p.replace(' ', '  ') + ' ')}, {len(p.split())}, {quoted(label)})" for p, label in licenses.BASE.items())
    count = lambda x: f"((len({x}) - len(replace({x}, ' ', ''))) // 2)"
    gate = quoted(" (?:" + "|".join(sorted({k for *_, keywords in licenses.rules() for k in keywords})) + ") ")
    lower = "lower(replace(replace(coalesce(text, ''), chr(8490), chr(305)), chr(304), chr(305)))"
    return f"""WITH r(rule, label, pattern, priority, keywords) AS (VALUES {values}), p(phrase, size, label) AS (VALUES {phrases}),
 b AS (SELECT doc_id, regexp_replace(regexp_replace({lower}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', '  ', 'g'), '^ +| +$', '', 'g') AS x FROM documents),
 d AS (SELECT doc_id, CASE WHEN x = '' THEN '' ELSE ' ' || x || ' ' END AS w FROM b),
 e AS (SELECT doc_id, size, label, string_split(w, phrase) AS parts, len(string_split(w, phrase)) - 1 AS n FROM d, p WHERE contains(w, phrase)),
 f AS (SELECT doc_id, sum(n)::BIGINT AS n_base, min({count('parts[1]')}) AS first_word, max({count("array_to_string(parts[1:len(parts) - 1], '')")} + (n - 1) * size) AS last_word, list(label) AS labels FROM e GROUP BY doc_id),
 g AS (SELECT doc_id, rule, label, priority, regexp_extract_all(w, pattern) AS m, string_split_regex(w, pattern) AS parts FROM (SELECT * FROM d WHERE regexp_matches(w, {gate})), r WHERE regexp_matches(w, keywords) AND regexp_matches(w, pattern)),
 h AS (SELECT doc_id, rule, label, priority, unnest(range(1, len(m) + 1)) AS k, m, parts FROM g),
 i AS (SELECT doc_id, rule, label, priority, {count("array_to_string(parts[1:k], '')")} + {count("array_to_string(m[1:k - 1], '')")} AS s, {count('m[k]')} AS n FROM h),
 j AS (SELECT * FROM i x WHERE NOT EXISTS (SELECT 1 FROM i y WHERE y.doc_id = x.doc_id AND y.s <= x.s AND y.s + y.n >= x.s + x.n AND (y.priority > x.priority OR y.priority = x.priority AND (y.n > x.n OR y.n = x.n AND y.rule < x.rule)))),
 k AS (SELECT doc_id, list(label) AS labels, max(priority) / 5 AS score, count(*) AS n FROM j GROUP BY doc_id)
SELECT d.doc_id, {count('w')}::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(array_to_string(list_sort(list_distinct(f.labels)), ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(f.labels, []), coalesce(k.labels, [])))), ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score, coalesce(k.n, 0)::INT AS n_detections
 FROM d LEFT JOIN f USING (doc_id) LEFT JOIN k USING (doc_id)"""


def fingerprint_sql() -> str:
    lines = "replace(replace(replace(t, '. ', '.' || chr(10)), '! ', '!' || chr(10)), '? ', '?' || chr(10))"
    lane = lambda i: f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT"
    hexed = lambda x, n: f"lpad(lower(printf('%x', {x})), {n}, '0')"
    last, n = lane(fingerprint.LANES - 1), fingerprint.SLOTS
    lanes = " || ".join(hexed(f"coalesce(sum({lane(i)}) % {fingerprint.MODULUS}, 0)::BIGINT", 8) for i in range(fingerprint.LANES))
    near = lambda k, j: f"CASE WHEN a.lanes = {k}.lanes THEN 1.0 WHEN na.n IS NULL OR n{k}.n IS NULL THEN 0.0 ELSE least(1.0, greatest(0.0, coalesce(d{j}.v, 0)::DOUBLE / (sqrt(na.n) * sqrt(n{k}.n)))) END::DOUBLE"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), o AS (SELECT *, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, text) AS i, count(*) OVER () AS n FROM d),
 e AS (SELECT a.i, a.doc_id, a.text, b.text AS nxt, left(a.text, (len(a.text) - len(a.text) // 2)::BIGINT) || left(b.text, (len(a.text) // 2)::BIGINT) AS edited FROM o a JOIN o b ON b.i = a.i % a.n + 1),
 t AS (SELECT i, 0 AS k, text AS t FROM e UNION ALL SELECT i, 1, edited FROM e UNION ALL SELECT i, 2, nxt FROM e), p AS (SELECT i, k, trim(unnest(string_split({lines}, chr(10)))) AS p FROM t), h AS (SELECT i, k, sha256(p) AS h FROM p WHERE p <> ''),
 la AS (SELECT t.i, t.k, {lanes} AS lanes FROM t LEFT JOIN h USING (i, k) GROUP BY t.i, t.k),
 sl AS (SELECT i, k, slot, sum(s)::BIGINT AS v FROM (SELECT i, k, {last} % {n} AS slot, {last} // {n} % 2 * 2 - 1 AS s FROM h) GROUP BY i, k, slot HAVING sum(s) <> 0),
 st AS (SELECT i, k, string_agg({hexed('slot', 2)} || {hexed(f'(v + {fingerprint.MODULUS}) % {fingerprint.MODULUS}', 8)}, '' ORDER BY slot) AS slots FROM sl GROUP BY i, k), nm AS (SELECT i, k, sum(v * v)::DOUBLE AS n FROM sl GROUP BY i, k),
 dt AS (SELECT x.i, y.k, sum(x.v * y.v) AS v FROM sl x JOIN sl y ON x.i = y.i AND x.slot = y.slot AND x.k = 0 AND y.k > 0 GROUP BY x.i, y.k)
SELECT e.doc_id, len(e.text)::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256, a.lanes || ':' || coalesce(sa.slots, '') AS fingerprint, b.lanes || ':' || coalesce(sb.slots, '') AS edited_fingerprint, {near('b', 1)} AS near_edited, {near('c', 2)} AS near_next
 FROM e JOIN la a ON a.i = e.i AND a.k = 0 JOIN la b ON b.i = e.i AND b.k = 1 JOIN la c ON c.i = e.i AND c.k = 2 LEFT JOIN st sa ON sa.i = e.i AND sa.k = 0 LEFT JOIN st sb ON sb.i = e.i AND sb.k = 1
 LEFT JOIN nm na ON na.i = e.i AND na.k = 0 LEFT JOIN nm nb ON nb.i = e.i AND nb.k = 1 LEFT JOIN nm nc ON nc.i = e.i AND nc.k = 2 LEFT JOIN dt d1 ON d1.i = e.i AND d1.k = 1 LEFT JOIN dt d2 ON d2.i = e.i AND d2.k = 2"""


def jaccard_sql() -> str:
    n, upper = jaccard.SHINGLE, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    number = "('0x' || substr(md5(t), 1, 16))::UBIGINT::HUGEINT"
    return f"""WITH RECURSIVE c AS (SELECT t, min(doc_id) AS class_id, count(*) AS n_copies, (CASE WHEN {number} >= 9223372036854775808 THEN {number} - 18446744073709551616 ELSE {number} END)::BIGINT AS key FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) GROUP BY t),
 w AS (SELECT key, regexp_extract_all(translate(t, '{upper}', '{upper.lower()}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM c), r AS (SELECT key, ws, unnest(range(1, greatest(2, len(ws) - {n - 2}))) AS i FROM w WHERE len(ws) > 0),
 sh AS (SELECT DISTINCT key, array_to_string(ws[i:i + {n - 1}], ' ') AS s FROM r), sz AS (SELECT key, count(*) AS n FROM sh GROUP BY key),
 pr AS (SELECT a.key AS ka, b.key AS kb, count(*) AS both_ FROM sh a JOIN sh b ON a.s = b.s AND a.key < b.key GROUP BY a.key, b.key),
 lk AS (SELECT ka, kb FROM pr JOIN sz x ON x.key = ka JOIN sz y ON y.key = kb WHERE both_ >= {jaccard.THRESHOLD} * (x.n + y.n - both_) - 1e-9), e AS (SELECT ka, kb FROM lk UNION ALL SELECT kb, ka FROM lk),
 reach AS (SELECT key AS ka, key AS kb FROM c UNION SELECT reach.ka, e.kb FROM reach JOIN e ON e.ka = reach.kb), g AS (SELECT ka AS key, min(kb) AS group_key FROM reach GROUP BY ka),
 k AS (SELECT ka AS key, count(*) AS n_links FROM e GROUP BY ka), f AS (SELECT group_key, min(class_id) AS group_id FROM g JOIN c USING (key) GROUP BY group_key)
SELECT d.doc_id, c.class_id, c.n_copies, coalesce(k.n_links, 0)::BIGINT AS n_links, f.group_id, g.group_key FROM documents d JOIN c ON c.t = coalesce(d.text, '') JOIN g USING (key) JOIN f USING (group_key) LEFT JOIN k USING (key)"""


def warc_sql() -> str:
    """SHA-1 in base32: 20 bits at a time are five hex digits and four letters."""
    bits = "('0x' || substr(h, (5 * g + 1)::INT, 5))::BIGINT"
    letter = lambda n: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({bits} >> {n}) & 31)::INT + 1, 1)"
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 8), lambda g: {' || '.join(map(letter, (15, 10, 5, 0)))}), '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p"""


def codes_sql() -> str:
    """Squared distances as x*x - 2*x*y + y*y: products of doubles that hold whole numbers are exact."""
    parts, entries = codes.PARTS, codes.ENTRIES
    near = lambda c: f"""SELECT vec_id, label, p.part, p.v, min({{'d': xx - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v), 'e': c.e}}) AS m FROM p JOIN {c} c ON c.part = p.part GROUP BY vec_id, label, p.part, p.v"""
    steps = ""
    for r in range(1, codes.ROUNDS + 1):
        steps += f""", a{r} AS MATERIALIZED ({near(f"c{r - 1}")}),
 u{r} AS (SELECT part, e, list(x ORDER BY i) AS v FROM (SELECT part, e, i, floor(sum(x) / count(*)) AS x FROM (SELECT part, m.e AS e, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{r}) GROUP BY part, e, i) GROUP BY part, e),
 c{r} AS MATERIALIZED (SELECT c.part, c.e, coalesce(u.v, c.v) AS v FROM c{r - 1} c LEFT JOIN u{r} u ON u.part = c.part AND u.e = c.e)"""
    return f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({codes.SCALE} * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS MATERIALIZED (SELECT *, list_inner_product(v, v) AS xx FROM (SELECT vec_id, label, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS v FROM (SELECT *, unnest(range({parts})) AS part FROM k))),
 c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {entries}){steps},
 z AS (SELECT vec_id, label, string_agg(lpad(printf('%x', m.e), 2, '0'), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM ({near(f"c{codes.ROUNDS}")}) GROUP BY vec_id, label),
 h AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, e, i)) AS h FROM (SELECT part, e, unnest(v) AS x, unnest(range(len(v))) AS i FROM c{codes.ROUNDS}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM z, h"""


def resample_sql() -> str:
    """CRC-32 byte by byte, by a table that is made of the polynomial; of every different feature once."""
    upper, buckets = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", resample.BUCKETS
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), (2 * i + 1)::INT, 2))::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255)::INT + 1])), 4294967295::BIGINT)"""
    features = lambda t: f"""SELECT {t}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM {'d' if t == 'doc_id' else 'b'}"""
    cut = lambda key, t: f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {t}"
    return f"""WITH y AS (SELECT list(list_reduce(list_prepend(n, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crc FROM (SELECT unnest(range(0, 256)) AS n)),
 d AS MATERIALIZED ({cut('doc_id', 'documents')}), b AS ({cut('item_id', 'benchmark')}), df AS MATERIALIZED ({features('doc_id')}), bf AS MATERIALIZED ({features('item_id')}),
 h AS MATERIALIZED (SELECT f, {crc} % {buckets} AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf), y),
 s AS (SELECT bucket, count(*) AS s FROM df JOIN h USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bf JOIN h USING (f) GROUP BY bucket), n AS (SELECT (SELECT count(*) FROM df) AS ss, (SELECT count(*) FROM bf) AS tt),
 g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + {buckets}) / ((s + 1)::DOUBLE * (tt + {buckets}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), n),
 w AS (SELECT doc_id, count(*) AS n, sum(gain) AS gain FROM df JOIN h USING (f) JOIN g USING (bucket) GROUP BY doc_id),
 x AS (SELECT d.doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(gain / n), 0)::BIGINT AS weight, ('0x' || substr(sha256('{resample.SEED}:' || d.doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (doc_id)),
 z AS (SELECT doc_id, words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM x),
 r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM z WHERE words >= {resample.LEAST_WORDS})
SELECT z.doc_id, n_features, weight, score, CASE WHEN rank <= {resample.PERCENT} * r.n // 100 THEN rank END::BIGINT AS rank FROM z LEFT JOIN r USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard": jaccard_sql(), "op2_mixing": mixing_sql(), "op3_licenses": licenses_sql(), "op5_fingerprint": fingerprint_sql(), "op11_warc": warc_sql(), "op12_vector_codes": codes_sql(), "op13_resample": resample_sql()}
