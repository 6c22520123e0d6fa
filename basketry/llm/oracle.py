"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

from basketry.llm import decontaminate, merkle, phrases, quality_rules, suffix_dedup, warc_zip

WARC_ZIP = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= {warc_zip.MIN_REVISIT}
      GROUP BY html HAVING count(*) > 1),
j AS (SELECT p.*, CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN first END AS refers_to
      FROM p LEFT JOIN f USING (html))
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM j
"""

# Windows are told apart by MD5, so that a window is 16 bytes and not 400.
SUFFIX_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT rid, doc_id, b, octet_length(b) AS n FROM d),
w AS (SELECT rid, s, md5(b[s : s + {suffix_dedup.LENGTH - 1}]) AS win FROM (SELECT rid, b, unnest(range(1, n - {suffix_dedup.LENGTH - 2})) AS s FROM n WHERE n >= {suffix_dedup.LENGTH})),
r AS (SELECT win FROM w GROUP BY win HAVING count(*) > 1),
m AS (SELECT rid, s, lag(s) OVER (PARTITION BY rid ORDER BY s) AS before FROM w SEMI JOIN r USING (win)),
o AS (SELECT rid, s, sum(CASE WHEN before IS NULL OR s > before + {suffix_dedup.LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY s) AS run FROM m),
x AS (SELECT rid, run, min(s) AS a, max(s) + {suffix_dedup.LENGTH - 1} AS z FROM o GROUP BY rid, run),
k AS (SELECT rid, a, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS prior FROM x),
p AS (SELECT n.rid, count(*) AS n_spans, sum(z - a + 1) AS n_removed,
             string_agg(hex(b[prior + 1 : a - 1]), '' ORDER BY a) || hex(any_value(b)[max(z) + 1 :]) AS kept
      FROM k JOIN n USING (rid) GROUP BY n.rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN p.rid IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256
FROM n LEFT JOIN p USING (rid)
"""

CHAT = """
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
r AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n
      FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
p AS (SELECT *, string_agg(md5(concat(coalesce('r' || role, '-'), chr(1), coalesce('t' || text, '-'))), '')
                OVER (PARTITION BY conv_id ORDER BY k) AS prefix FROM r),
whole AS (SELECT prefix, min(conv_id) AS conv_id, any_value(n) AS n_turns FROM p WHERE k = n GROUP BY prefix),
kept AS (SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE k < n)),
t AS (SELECT conv_id, string_agg(concat('<|', role, '|>', chr(10), replace(text, '<|', '< |'), '<|end|>', chr(10)), ''
                                 ORDER BY k) AS text FROM r GROUP BY conv_id)
SELECT kept.conv_id, n_turns, t.text FROM kept JOIN t ON kept.conv_id IS NOT DISTINCT FROM t.conv_id
"""

_WORDS = r"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format(t="text")} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format(t="text")} AS w FROM benchmark),
g AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, array_to_string(w[s : s + {decontaminate.WINDOW - 1}], ' ') AS win,
             least(len(w), {decontaminate.WINDOW}) AS m
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {decontaminate.WINDOW - 2}, 2))) AS s FROM i WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM g),
h AS (SELECT rid, s, x.m, item FROM
        (SELECT rid, m, s, array_to_string(w[s : s + m - 1], ' ') AS win FROM
           (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, m WHERE len(w) >= m)) x
      JOIN g ON g.win = x.win AND g.m = x.m),
c AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(s, s + m)) AS pos FROM h) GROUP BY rid),
n AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {decontaminate.RATIO} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN n USING (rid)
"""


def quality_sql() -> str:
    q = quality_rules
    rules = len(q.CUTOFFS)
    signals = {
        "symbols": "n_symbols / greatest(word_chars, 1)",
        "repeats": "n_repeat_words / greatest(n_words, 1)",
        "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
        "capitals": "n_capitals / greatest(n_letters, 1)",
        "long_words": "word_chars / greatest(n_words, 1)",
        "short_words": "-(word_chars / greatest(n_words, 1))",
    }
    melted = " UNION ALL ".join(
        f"SELECT rid, stratum, text, base_failed, '{rule}' AS rule, {e} AS signal FROM m"
        for rule, e in signals.items()
    )
    cuts = ", ".join(
        f"('{rule}', {i}, CAST({float(c)!r} AS DOUBLE))" for rule, cs in q.CUTOFFS.items() for i, c in enumerate(cs)
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang AS stratum, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT rid, count(*) AS n_lines, count(DISTINCT x) AS n_distinct
      FROM (SELECT rid, unnest(string_split(text, chr(10))) AS x FROM d)
      WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
g AS (SELECT rid, s, w[s : s + 4] AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS s FROM d)),
r AS (SELECT rid, count(DISTINCT pos) AS n_repeat_words FROM
        (SELECT rid, unnest(range(s, s + 5)) AS pos FROM
           (SELECT rid, s, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1) GROUP BY rid),
b AS (SELECT rid, doc_id, stratum, text, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
             CAST(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS BIGINT) AS n_letters,
             coalesce(n_lines - n_distinct, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d LEFT JOIN l USING (rid) LEFT JOIN r USING (rid)),
m AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.REPEAT_PERCENT} * n_words AS base_failed FROM b),
s AS ({melted}),
y AS (SELECT DISTINCT doc_id, quality FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1)),
k AS (SELECT rid, quality FROM m JOIN y USING (doc_id)),
z AS (SELECT count(*) AS n FROM (SELECT DISTINCT coalesce('s' || stratum, '-') FROM m JOIN k USING (rid))),
e AS (SELECT DISTINCT stratum, text, quality, rule, signal FROM s JOIN k USING (rid) WHERE NOT base_failed),
c (rule, i, cut) AS (VALUES {cuts}),
t AS (SELECT stratum, rule, i, cut, count(*) FILTER (quality = 1) AS n,
             count(*) FILTER (quality = 1 AND signal > cut) AS good,
             count(*) FILTER (quality = 0 AND signal > cut) AS bad
      FROM e JOIN c USING (rule) GROUP BY ALL),
u AS (SELECT *, n > 0 AND list_sum([exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1)
               + x * ln({q.LIMIT / rules!r}) + (n - x) * ln(1 - {q.LIMIT / rules!r})) FOR x IN range(0, good + 1)])
               <= {q.DELTA / rules!r} / greatest((SELECT n FROM z), 1) AS certified FROM t WHERE n > 0),
v AS (SELECT *, bool_and(certified) OVER (PARTITION BY stratum, rule ORDER BY i) AS open FROM u),
x AS (SELECT stratum, rule, arg_max(cut, (bad - {q.PRICE} * good) * 1000 - i) AS cut
      FROM v WHERE open AND bad - {q.PRICE} * good > 0 GROUP BY stratum, rule),
j AS (SELECT DISTINCT rid FROM s JOIN x ON s.rule = x.rule AND s.stratum IS NOT DISTINCT FROM x.stratum WHERE signal > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rid NOT IN (SELECT rid FROM j) AS kept
FROM m
"""


def merkle_sql(source_levels: int = 6, root_levels: int = 4) -> str:
    """Trees written out level by level: sources of up to FAN ** source_levels rows."""
    fan = merkle.FAN

    def encoded(value: str) -> str:
        return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"

    head = " || ".join(encoded(c) for c in merkle.FIELDS[:-1])
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str, leaf_table: str, depth: int) -> list[str]:
        """n levels of (t, r, d, kids): node digests and their children's, ``name``_0 being the leaves."""
        made = [f"{name}_0 AS (SELECT t, r, d, [d] AS kids FROM {leaf_table})"]
        for k in range(1, depth + 1):
            made.append(
                f"{name}_{k} AS (SELECT t, r // {fan} AS r, sha256(string_agg(d, '' ORDER BY r)) AS d, "
                f"list(d ORDER BY r) AS kids FROM {name}_{k - 1} "
                f"WHERE t IN (SELECT t FROM {name}_{k - 1} WHERE r > 0) GROUP BY t, r // {fan})"
            )
        any_level = " UNION ALL ".join(f"SELECT {k} AS k, t, d FROM {name}_{k} WHERE r = 0" for k in range(depth + 1))
        made.append(f"{name}_top AS (SELECT t, arg_max(d, k) AS d FROM ({any_level}) GROUP BY t)")
        return made

    def joins(name: str, depth: int, on: str, rank: str) -> str:
        return "".join(
            f" LEFT JOIN {name}_{k} AS {name}{k} ON {name}{k}.t = {on} AND {name}{k}.r = {rank} // {fan**k}"
            for k in range(1, depth + 1)
        )

    def steps(name: str, depth: int, rank: str) -> list[tuple[str, str]]:
        """What stands before and after the node on the way up, from its parent's children."""
        out = []
        for k in range(depth):
            at = f"CAST({rank} // {fan**k} % {fan} AS INTEGER)"
            kids = f"{name}{k + 1}.kids"
            out.append(
                (f"coalesce(array_to_string({kids}[1 : {at}], ''), '')", f"coalesce(array_to_string({kids}[{at} + 2 :], ''), '')")
            )
        return out

    path = steps("s", source_levels, "leaf.r") + steps("g", root_levels, "src.r")
    parents = [f"s{k}.d" for k in range(1, source_levels + 1)] + [f"g{k}.d" for k in range(1, root_levels + 1)]
    folds = []
    for k, (before, after) in enumerate(path):
        folds.append(
            f"f{k + 1} AS (SELECT *, CASE WHEN has[{k + 1}] THEN sha256(before[{k + 1}] || f{k} || after[{k + 1}]) ELSE f{k} END "
            f"AS f{k + 1} FROM f{k})"
        )
    return f"""
WITH base AS (SELECT doc_id, coalesce('s' || source, '') AS source, sha256({head} || {encoded("text")}) AS leaf,
       sha256({head} || {encoded(lowered)}) AS lowered,
       coalesce(xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT,
         list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
         lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
           lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END))) % {merkle.TAMPERED_EVERY} = 0, false) AS hit
       FROM documents),
src AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS r FROM (SELECT DISTINCT source FROM base)),
leaf AS (SELECT base.*, leaf AS d, src.r AS t,
       row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM base JOIN src USING (source)),
{", ".join(tree("s", "leaf", source_levels))},
subs AS (SELECT 0 AS t, t AS r, d FROM s_top),
{", ".join(tree("g", "subs", root_levels))},
f0 AS (SELECT leaf.doc_id, leaf.leaf, s_top.d AS subroot, CASE WHEN hit THEN lowered ELSE leaf END AS f0,
       [{", ".join(a for a, _ in path)}] AS before, [{", ".join(b for _, b in path)}] AS after,
       [{", ".join(f"{d} IS NOT NULL" for d in parents)}] AS has
       FROM leaf JOIN src USING (source) JOIN s_top ON s_top.t = leaf.t
       {joins("s", source_levels, "leaf.t", "leaf.r")}{joins("g", root_levels, "0", "src.r")}),
{", ".join(folds)}
SELECT doc_id, leaf, subroot, g_top.d AS root,
       sha256(array_to_string(list_transform(range(1, {len(path) + 1}), lambda k: before[k] || after[k]), '')) AS proof_sha256,
       f{len(path)} AS folded_root, f{len(path)} = g_top.d AS verified
FROM f{len(path)}, g_top
"""


PHRASES = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS id,
       regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
       'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
c AS (SELECT lang, m, phrase, count(*) AS f FROM
       (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda s: array_to_string(w[s : s + m - 1], ' '))) AS phrase
        FROM p, (VALUES (1), (2), (3)) AS sizes(m) WHERE len(w) >= m) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE m = 1 GROUP BY lang),
a AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM c WHERE m > 1 AND f >= {phrases.LEAST}),
k AS (SELECT a.*, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS rest
      FROM a, (VALUES (1), (2)) AS cuts(k) WHERE k < m),
s AS (SELECT k.*, x.f AS l, y.f AS r, CAST({phrases.SCALE}::HUGEINT * k.a * k.a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
      FROM k JOIN c AS x ON x.lang = k.lang AND x.phrase = head JOIN c AS y ON y.lang = k.lang AND y.phrase = rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(w[o : o + 1], ' ') AS phrase, max(a) AS longer
      FROM a, (VALUES (1), (2)) AS ends(o) WHERE m = 3 GROUP BY ALL),
g AS (SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase
      WHERE longer IS NULL OR 100 * longer < {phrases.COVERED} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM g JOIN n USING (lang) QUALIFY rank <= {phrases.TOP}
"""


STATEMENTS: dict[str, str] = {
    "op1_quality_rules": quality_sql(),
    "op2_warc_zip": WARC_ZIP,
    "op4_suffix_dedup": SUFFIX_DEDUP,
    "op7_chat": CHAT,
    "op8_decontaminate": DECONTAMINATE,
    "op12_merkle": merkle_sql(),
    "op13_phrases": PHRASES,
}
