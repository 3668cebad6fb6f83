"""SQL for the operators that SQL can express, written from their definitions and not from their plans."""

from __future__ import annotations

from glossmill.llm import decontam, quality, secret_scan, sharding, url_filter


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def counted(x: str, characters: str) -> str:
    """How often the characters are in x."""
    return f"(length({x}) - length(translate({x}, {quoted(characters)}, '')))"


SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORD = r"[^\x20\x09-\x0D]+"


def quality_rules() -> str:
    """Base figures from words and windows as lists; lines by their rules."""
    q, n = quality, "n"
    words = lambda x: f"regexp_extract_all({x}, '{WORD}')"
    chars = lambda x: f"length(regexp_replace({x}, '[\\x20\\x09-\\x0D]', '', 'g'))"
    symbols = f"{counted('line', q.SYMBOLS)} * {q.WORDS_A_SYMBOL} > {n}"
    separators = counted("line", q.SEPARATORS)
    navigation = f"({separators} >= {q.LEAST_SEPARATORS} AND {n} <= {q.WORDS_A_SEPARATOR} * {separators})"
    doubled = " + ".join(f"(length(line) - length(replace(line, {quoted(d)}, ''))) // {len(d)}" for d in q.DOUBLED)
    punctuation = f"({symbols} OR 10 * ({doubled}) > {q.DOUBLED_IN_TEN} * {n} OR ({n} >= {q.LONG_LINE} AND {q.WORDS_A_MARK} * {counted('line', q.MARKS)} < {n}))"
    phrases = "(" + " + ".join(f"contains(lower(line), {quoted(p)})::INT" for p in q.BOILERPLATE) + ")"
    boilerplate = f"(c.t IS NOT NULL OR ({phrases} > 0 AND {n} <= {q.WORDS_A_PHRASE} * {phrases}))"
    trimmed = "trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, {words("coalesce(text, '')")} AS w FROM documents),
l AS (SELECT r, i, line, len({words('line')}) AS n, {trimmed} AS t, text FROM (SELECT r, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
b AS (SELECT t, text, coalesce(lag(t) OVER w, 'top' || chr(10) || text) AS above, coalesce(lead(t) OVER w, 'bottom' || chr(10) || text) AS below FROM l WHERE t <> '' WINDOW w AS (PARTITION BY r ORDER BY i)),
c AS (SELECT t FROM b GROUP BY t HAVING count(DISTINCT text) >= (SELECT greatest({q.LEAST_TEXTS}, ceil(count(*) * {q.COMMON} / 1000.0)) FROM d) AND 2 * least(count(DISTINCT above), count(DISTINCT below)) >= count(DISTINCT text)),
j AS (SELECT l.*, CASE WHEN {navigation} THEN 'navigation' WHEN {punctuation} THEN 'punctuation' WHEN {boilerplate} THEN 'boilerplate' END AS rule, row_number() OVER (PARTITION BY r, line ORDER BY i) AS k FROM l LEFT JOIN c USING (t) WHERE n > 0),
s AS (SELECT r, sum((k > 1)::INT) AS dups, count_if(rule = 'punctuation') AS rp, count_if(rule = 'navigation') AS rn, count_if(rule = 'boilerplate') AS rb, sum(CASE WHEN rule IS NULL THEN {chars('line')} ELSE 0 END) AS stay FROM j GROUP BY r),
g AS (SELECT r, unnest(range(1, len(w) - {q.WINDOW - 2})) AS i, w FROM d WHERE len(w) >= {q.WINDOW}),
x AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(w[i:i+{q.WINDOW - 1}], ' ')) AS c FROM g),
y AS (SELECT r, count(*) AS rep FROM (SELECT DISTINCT r, i + p AS at FROM x, (SELECT unnest(range({q.WINDOW})) AS p) WHERE c > 1) GROUP BY r),
z AS (SELECT doc_id, len(w) AS n_words, {chars('text')} AS word_chars, {counted('text', q.SYMBOLS)} AS n_symbols, coalesce(dups, 0) AS dups, coalesce(rep, 0) AS rep, coalesce(rp, 0) AS rp, coalesce(rn, 0) AS rn, coalesce(rb, 0) AS rb, coalesce(stay, 0) AS stay FROM d LEFT JOIN s USING (r) LEFT JOIN y USING (r)),
f AS (SELECT *, n_words < {q.LEAST_WORDS} OR 100 * rep > {q.MOST_REPEATED_PERCENT} * n_words AS base_failed FROM z)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(dups AS BIGINT) AS n_dup_lines, CAST(rep AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND 100 * stay >= {q.KEPT_PERCENT} * word_chars AS kept,
    CAST(rp AS BIGINT) AS removed_punctuation, CAST(rn AS BIGINT) AS removed_navigation, CAST(rb AS BIGINT) AS removed_boilerplate, CASE WHEN word_chars = 0 THEN 0 ELSE stay::DOUBLE / word_chars END::DOUBLE AS kept_share FROM f"""


def any_case(pattern: str) -> str:
    """A pattern with its leading (?i) spelt out for ASCII letters outside brackets; (?i) itself would fold others too."""
    if not pattern.startswith("(?i)"):
        return pattern
    out, inside = "", False
    for ch in pattern[4:]:
        inside = (inside or ch == "[") and ch != "]"
        out += f"[{ch.upper()}{ch.lower()}]" if ch.isalpha() and not inside and not out.endswith("\\") else ch
    return out.replace(r"\[Xx]", r"\x")


def secrets() -> str:
    """Every text by itself: pieces between the matches and the matches, and running sums of their lengths."""
    parts = []
    for r in secret_scan.BASE + secret_scan.PROVIDERS:
        p = quoted(any_case(r.pattern))
        long_enough = f"length(regexp_extract(m, {p}, {r.group}))"
        parts.append(f"""SELECT r, '{r.kind}' AS kind, {secret_scan.ORDER[r.kind]} AS ord, stop - length(m) AS start, stop, {long_enough} >= {r.least} AS ok
    FROM (SELECT r, m, sum(length(b) + length(m)) OVER (PARTITION BY r ORDER BY i) AS stop FROM (SELECT r, unnest(regexp_extract_all(text, {p})) AS m, unnest(regexp_split_to_array(text, {p})[:-2]) AS b, generate_subscripts(regexp_extract_all(text, {p}), 1) AS i FROM d WHERE regexp_matches(text, {p})))""")
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents), s AS ({' UNION ALL '.join(parts)}),
a AS (SELECT r, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex, string_agg(CASE WHEN ord < {len(secret_scan.BASE)} THEN kind || ':' || start || ':' || stop END, ',' ORDER BY start, ord) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans FROM s WHERE ok GROUP BY r)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)"""


def contamination() -> str:
    """Windows joined on the words that a mask picks; stretches compared on each diagonal that has a hit."""
    m, span = decontam, min(map(len, decontam.MASKS))
    words = lambda x: f"regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+')"
    key = lambda w, i, mask: "concat_ws(' ', " + ", ".join(f"{w}[{i} + {k}]" for k, x in enumerate(mask) if x == "1") + ")"
    hit = " UNION ".join(
        f"SELECT d.doc_id, t.item_id, d.i - t.i AS diag FROM (SELECT doc_id, i, {key('w', 'i', mask)} AS k FROM p WHERE i <= len(w) - {len(mask)} + 1) d JOIN (SELECT item_id, i, {key('w', 'i', mask)} AS k FROM q WHERE i <= len(w) - {len(mask)} + 1) t USING (k)" for mask in m.MASKS
    )
    return f"""
WITH d AS (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents), b AS (SELECT item_id, list_filter({words("coalesce(text, '')")}, lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - {span - 2})) AS i FROM d WHERE len(w) >= {span}), q AS (SELECT item_id, w, unnest(range(1, len(w) - {span - 2})) AS i FROM b WHERE len(w) >= {m.SHORT}),
h AS ({hit}),
e AS (SELECT h.doc_id, h.item_id, diag, unnest(range(1, len(b.w) + 1)) AS i, d.w AS dw, b.w AS bw, least({m.MIN_OVERLAP}, len(b.w)) AS width FROM h JOIN d ON h.doc_id = d.doc_id JOIN b ON h.item_id = b.item_id),
f AS (SELECT doc_id, item_id, diag, i, width, CASE WHEN i + diag >= 1 THEN coalesce(dw[i + diag] = bw[i], false)::INT ELSE 0 END AS same, len(bw) AS n FROM e),
g AS (SELECT *, sum(same) OVER (PARTITION BY doc_id, item_id, diag ORDER BY i) AS s, row_number() OVER (PARTITION BY doc_id, item_id, diag ORDER BY i) AS k FROM f),
v AS (SELECT x.doc_id, x.item_id, x.width AS tokens, x.s - coalesce(y.s, 0) AS matched, greatest(x.i - x.width + x.diag, 0) AS doc_at FROM g x LEFT JOIN g y ON x.doc_id = y.doc_id AND x.item_id = y.item_id AND x.diag = y.diag AND y.k = x.k - x.width WHERE x.k >= x.width)
SELECT doc_id, item_id, CAST(r.doc_at AS BIGINT) AS doc_at, CAST(r.tokens AS BIGINT) AS tokens, CAST(r.matched AS BIGINT) AS matched FROM (
    SELECT doc_id, item_id, max({{'matched': matched, 'doc_at': doc_at, 'tokens': tokens}}) AS r FROM (SELECT doc_id, item_id, tokens, matched, min(doc_at) AS doc_at FROM v WHERE matched >= ceil(tokens * {m.SIMILARITY} - 1e-9) GROUP BY ALL) GROUP BY 1, 2)"""


def shards() -> str:
    """Draws of every child of every node; checksums byte by byte."""

    def tree(node, out: str) -> str:
        """The path of the leaf that a key reaches, level by level."""

        def pick(n, path: str) -> str:
            live = [c for c in n.children if c.weight > 0]
            below = {c.name: pick(c, f"{path}/{c.name}") if c.children else str(c.shard) for c in live}
            if len(live) == 1:
                return below[live[0].name]
            draws = ", ".join(
                f"{{'d': ln((('0x' || substr(md5('{sharding.SEED}/{path}/{c.name}/' || id), 1, 13))::BIGINT + 0.5::DOUBLE) / {float(1 << 52)}::DOUBLE) / {c.weight}::DOUBLE, 'n': '{c.name}'}}" for c in live
            )
            return f"CASE list_max([{draws}]).n " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in below.items()) + " END"

        return f"CAST({pick(node, '')} AS INT) AS {out}"

    table = []
    for i in range(256):
        x = i
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    crc = f"list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: ('0x' || b)::BIGINT), lambda a, b: xor(a >> 8, {table}[(xor(a, b) & 255) + 1]), 4294967295::BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, id, CAST(strlen(text) + 1 AS BIGINT) AS size, CAST(CASE WHEN text = '' THEN 0 ELSE xor({crc}, 4294967295) END AS BIGINT) AS text_crc32, {tree(sharding.TREE, 'shard')}, {tree(sharding.GROWN, 'grown_shard')} FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws('/', id, text_crc32, size))) - 1 AS slot, grown_shard FROM s"""


def url_filters() -> str:
    """Every rule held against every url."""
    rules = ", ".join(f"({quoted(h)}, {quoted(p)}, {quoted(v)})" for h, p, v in url_filter.RULES)
    return f"""
WITH r(rhost, rpath, rverdict) AS (VALUES {rules}),
u AS (SELECT page_id, row_number() OVER () AS k, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, k, translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT k, max({{'size': length(rhost) + length(rpath), 'rule': rhost || rpath, 'verdict': rverdict}}) AS best FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, '{url_filter.DEFAULT}') AS verdict FROM p LEFT JOIN m USING (k)"""


def hard_negatives() -> str:
    """Every anchor held against every row."""
    return """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, CAST(list_inner_product(a.x, e.x) AS BIGINT) AS score FROM e AS a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, s.vec_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS rank
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


SQL = {
    "op1_quality_rules": quality_rules(), "op5_secret_scans": secrets(), "op6_benchmark_decontamination": contamination(),
    "op8_sharding": shards(), "op12_url_filters": url_filters(), "op13_hard_negatives": hard_negatives(),
}
