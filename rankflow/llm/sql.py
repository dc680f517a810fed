"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
TEST_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def near_dedup(k: int, documents: str = "documents") -> str:
    """doc_id, n_shingles, component_id, kept: near-duplicate classes by all pairs that share a shingle."""
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM {documents}
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) END AS s FROM w
), e AS (SELECT doc_id, unnest(s) AS h FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e AS a JOIN e AS b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT p.a, p.b FROM p JOIN s AS x ON x.doc_id = p.a JOIN s AS y ON y.doc_id = p.b
  WHERE 100 * c >= 80 * (len(x.s) + len(y.s) - c)
), both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM s
  UNION
  SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r
), least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least.component_id, s.doc_id = least.component_id AS kept
FROM s JOIN least USING (doc_id)"""


def decontaminate(documents: str = "documents") -> str:
    """Words of documents hit by windows of ten words of a benchmark item."""
    return f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TEST_WORD}') AS w FROM {documents}
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TEST_WORD}') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS g
  FROM b WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM wins),
g AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g
  FROM d, sizes WHERE len(w) >= n
), m AS (SELECT g.doc_id, g.i, g.n, wins.item_id FROM g JOIN wins ON wins.g = g.g AND wins.n = g.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS t FROM m) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _bucket(v: str) -> str:
    wide = f"greatest(length(bin({v})) - 6, 0)"
    return f"(32 * {wide} + ({v} >> {wide}))"


def _top(b: str) -> str:
    wide = f"greatest(({b} - 32) // 32, 0)::INT"
    return f"((({b} - 32 * {wide} + 1)::BIGINT << {wide}) - 1)"


def quality(quantile: dict[str, int], spread: int, scale: int, least: dict[str, int], documents: str = "documents") -> str:
    """The counts, base rules and adaptive verdict of the quality rules."""
    names = list(quantile)
    high = "CASE rate " + " ".join(f"WHEN '{x}' THEN {q}" for x, q in quantile.items()) + " END"
    level = lambda name, by: f"""
q_{name} AS (
  SELECT {by}rate, docs, {_top("q1")} AS q1, {_top("q3")} AS q3, {_top("qh")} AS high FROM (
    SELECT {by}rate, max(total) AS docs, min(bucket) FILTER (1000 * below >= 250 * total) AS q1, min(bucket) FILTER (1000 * below >= 750 * total) AS q3,
      min(bucket) FILTER (1000 * below >= {high} * total) AS qh
    FROM (SELECT *, sum(n) OVER (PARTITION BY {by}rate) AS total, sum(n) OVER (PARTITION BY {by}rate ORDER BY bucket) AS below
      FROM (SELECT {by}rate, bucket, count(*) AS n FROM cells GROUP BY ALL)) GROUP BY {by}rate)
), f_{name} AS (
  SELECT {by}max(docs) AS docs, {", ".join(f"max(greatest(q3 + 3 * greatest(q3 - q1, {spread}), high)) FILTER (rate = '{x}') AS most_{x}" for x in names)}
  FROM q_{name} {"GROUP BY " + by.rstrip(", ") if by else ""}
)"""  # noqa: E731
    chosen = ", ".join(f"CASE WHEN o.docs >= {least[x]} THEN o.most_{x} WHEN l.docs >= {least[x]} THEN l.most_{x} ELSE a.most_{x} END AS most_{x}" for x in names)
    white = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
    return f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce('=' || lang, '') AS lang_key, coalesce('=' || source, '') AS source_key FROM {documents}
), w AS (
  SELECT r, doc_id, lang_key, source_key, text, regexp_extract_all(text, '{WORD}') AS w,
    list_filter(string_split(text, chr(10)), lambda x: length(translate(x, {white}, '')) > 0) AS lines FROM t
), g AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g FROM w WHERE len(w) > 2
), twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS c FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
counted AS (
  SELECT doc_id, lang_key, source_key, len(w)::BIGINT AS n_words, length(translate(text, {white}, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.c, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (r)
), rated AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {scale} * n_symbols // greatest(word_chars, 1) AS symbols,
    {scale} * n_dup_lines // greatest(n_lines, 1) AS dup_lines, {scale} * n_repeat_words // greatest(n_words, 1) AS repeat_words FROM counted
), cells AS (
  {" UNION ALL ".join(f"SELECT lang_key, source_key, '{x}' AS rate, {_bucket(x)} AS bucket FROM rated WHERE NOT base_failed" for x in names)}
),{level("own", "lang_key, source_key, ")},{level("lang", "lang_key, ")},{level("all", "")},
cut AS (SELECT o.lang_key, o.source_key, {chosen} FROM f_own AS o JOIN f_lang AS l USING (lang_key) CROSS JOIN f_all AS a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({" AND ".join(f"{x} <= most_{x}" for x in names)}, false) AS kept
FROM rated LEFT JOIN cut USING (lang_key, source_key)"""


def mixing(power: dict[str, float], rounds: int, tolerance: float, fixes: int, budget: float, seed: str, topics: int, most: float, documents: str = "documents") -> str:
    """Raking, calibration and the sample of the mixing operator, each in as many steps as the data may need."""
    margins = list(power)
    ctes, last = [], "w0"
    share = lambda x, by: f"SELECT {by}{x}, pow(sum(tokens)::DOUBLE, {power[x]}) AS g FROM cells GROUP BY ALL"
    for x in ("source", "lang"):
        ctes.append(f"g_{x} AS (SELECT {x}, g / sum(g) OVER () AS goal FROM ({share(x, '')}))")
    ctes.append(f"g_topic AS (SELECT topic, CASE WHEN s > 0 THEN goal * g / s ELSE 0 END AS goal FROM (SELECT *, sum(g) OVER (PARTITION BY lang) AS s FROM ({share('topic', 'lang, ')})) JOIN g_lang USING (lang))")
    for i in range(rounds):
        first, over = last, f"(SELECT m FROM m{i})"
        for x in margins:
            name = f"w{i + 1}_{x}"
            ctes.append(
                f"{name} AS MATERIALIZED (SELECT w.source, w.lang, w.topic, w.tokens, w.weight * CASE WHEN {over} <= {tolerance} THEN 1 WHEN n.now > 0 THEN goal / n.now ELSE 0 END AS weight FROM {last} AS w "
                f"JOIN (SELECT {x}, sum(weight) AS now FROM {last} GROUP BY {x}) AS n ON n.{x} = w.{x} JOIN g_{x} ON g_{x}.{x} = w.{x})"
            )
            last = name
        ctes.append(f"m{i + 1} AS MATERIALIZED (SELECT least({over}, max(abs(w.weight - v.weight) / greatest(v.weight, 1e-300))) AS m FROM {last} AS w JOIN {first} AS v USING (source, lang, topic))")
    ctes.append(f"r AS (SELECT *, CASE WHEN tokens > 0 THEN weight / tokens END AS ratio FROM {last})")
    ctes.append(f"s0 AS (SELECT sum(tokens)::DOUBLE * {budget} AS s, sum(tokens)::DOUBLE * {budget} AS aim FROM r)")
    for i in range(fixes):
        ctes.append(
            f"s{i + 1} AS (SELECT CASE WHEN coalesce(sum(weight) FILTER (NOT ratio * s >= 1), 0) = 0 THEN max(s) ELSE "
            f"greatest(max(s), greatest(0, max(aim) - coalesce(sum(tokens) FILTER (ratio * s >= 1), 0)) / sum(weight) FILTER (NOT ratio * s >= 1)) END AS s, max(aim) AS aim FROM r, s{i})"
        )
    key = lambda x: f"coalesce('=' || {x}, '')"
    plain = lambda x: f"CASE WHEN d.{x} <> '' THEN d.{x}[2:] END AS {x}"
    return f"""
WITH t AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {key("source")} AS source, {key("lang")} AS lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM {documents}
), chosen AS MATERIALIZED (
  SELECT lang, word FROM (
    SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k FROM (
      SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(list_distinct(w)) AS word FROM t) GROUP BY ALL) JOIN (SELECT lang, count(*) AS docs FROM t GROUP BY lang) USING (lang)
    WHERE n <= docs * {most}::DOUBLE) WHERE k <= {topics}
), counted AS (SELECT r, word, count(*) AS n FROM (SELECT r, lang, unnest(w) AS word FROM t) JOIN chosen USING (lang, word) GROUP BY r, word),
topic AS (SELECT r, max(struct_pack(n := n, word := word)).word AS topic FROM counted GROUP BY r),
d AS MATERIALIZED (
  SELECT doc_id, source, lang, len(w)::BIGINT AS n_tokens, ('0x' || md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || text)[1:12])::BIGINT AS draw, '=' || lang || ' ' || coalesce(topic, '') AS topic
  FROM t LEFT JOIN topic USING (r)
), cells AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM d GROUP BY ALL),
m0 AS (SELECT 1e300::DOUBLE AS m), w0 AS (SELECT *, tokens::DOUBLE AS weight FROM cells), {", ".join(ctes)},
p AS (SELECT source, lang, topic, ratio, least(1, coalesce(ratio * s, 1)) AS prob FROM r, s{fixes})
SELECT d.doc_id, {plain("source")}, {plain("lang")}, {plain("topic")}, d.n_tokens,
  round(coalesce(ratio, 0) * (SELECT sum(n_tokens) FROM d)::DOUBLE, 6) AS weight, round(prob, 6) AS prob, draw < prob * 281474976710656.0::DOUBLE AS kept
FROM d JOIN p USING (source, lang, topic)"""


def lm_score(prior: float, mass: float, least: int, digits: int, documents: str = "documents") -> str:
    """Cross-entropy difference of two bigram models, each document left out of both."""
    rest = lambda k, n, own: f"({n} - {'CASE WHEN target THEN ' + own + ' ELSE 0 END' if k == 'good' else own})"
    scale = {"good": "1.0::DOUBLE", "n": "(SELECT CASE WHEN good > 0 THEN good::DOUBLE / n ELSE 1 END FROM totals)"}
    p1 = lambda k: (
        f"({scale[k]} * CASE WHEN word_n >= {least} THEN {rest(k, 'word_' + k, 'own_word')} ELSE {rest(k, '(SELECT unknown_' + k + ' FROM vocabulary)', 'strange')} END + {prior}) / "
        f"({scale[k]} * {rest(k, '(SELECT ' + k + ' FROM totals)', 'words')} + {prior} * ((SELECT size FROM vocabulary) + 1))"
    )
    p2 = lambda k: f"CASE WHEN v IS NULL THEN p_{k} ELSE ({scale[k]} * {rest(k, 'pair_' + k, 'own_pair')} + {mass} * p_{k}) / ({scale[k]} * {rest(k, 'before_' + k, 'own_before')} + {mass}) END"
    return f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0 AND doc_id IS NOT NULL), false) AS target FROM {documents}
), t AS (SELECT r, target, len(w) AS words, unnest(w) AS w, unnest(list_prepend(NULL, w[:-2])) AS v FROM d),
totals AS MATERIALIZED (SELECT count(*) AS n, count(*) FILTER (target) AS good FROM t),
word AS MATERIALIZED (SELECT w, count(*) AS word_n, count(*) FILTER (target) AS word_good FROM t GROUP BY w),
pair AS MATERIALIZED (SELECT v, w, count(*) AS pair_n, count(*) FILTER (target) AS pair_good FROM t WHERE v IS NOT NULL GROUP BY v, w),
vocabulary AS MATERIALIZED (
  SELECT count(*) FILTER (word_n >= {least}) AS size, coalesce(sum(word_n) FILTER (word_n < {least}), 0) AS unknown_n, coalesce(sum(word_good) FILTER (word_n < {least}), 0) AS unknown_good FROM word
),
own_word AS MATERIALIZED (SELECT r, w, count(*) AS own_word FROM t GROUP BY r, w),
own_pair AS MATERIALIZED (SELECT r, v, w, count(*) AS own_pair FROM t WHERE v IS NOT NULL GROUP BY r, v, w),
strange AS (SELECT r, count(*) AS strange FROM t JOIN word USING (w) WHERE word_n < {least} GROUP BY r),
every AS (
  SELECT t.r, t.target, t.words, t.v, word.word_n, word.word_good, o.own_word, coalesce(strange, 0) AS strange,
    b.word_n AS before_n, b.word_good AS before_good, ob.own_word AS own_before, pair_n, pair_good, own_pair
  FROM t JOIN word ON word.w = t.w JOIN own_word AS o ON o.r = t.r AND o.w = t.w LEFT JOIN strange ON strange.r = t.r
    LEFT JOIN word AS b ON b.w = t.v LEFT JOIN own_word AS ob ON ob.r = t.r AND ob.w = t.v
    LEFT JOIN pair ON pair.v = t.v AND pair.w = t.w LEFT JOIN own_pair AS op ON op.r = t.r AND op.v = t.v AND op.w = t.w
), single AS (SELECT *, {p1("good")} AS p_good, {p1("n")} AS p_n FROM every),
loss AS (SELECT r, avg(-ln({p2("good")})) AS good, avg(-ln({p2("n")})) AS background FROM single GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_tokens, round(good, {digits}) AS target_loss, round(background, {digits}) AS background_loss, round(good - background, {digits}) AS score
FROM d LEFT JOIN loss USING (r)"""
