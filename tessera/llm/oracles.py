"""The same results stated in SQL, where SQL can state them."""

from __future__ import annotations

from tessera.llm import embeddings, merkle, trie, urls
from tessera.llm.quality import MIN_GROUP, RULES
from tessera.llm.substring import WINDOW

MERKLE_LEVELS = 7  # enough for two million rows a language

_MEASURES = r"""
d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, lang, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
),
win AS (
  SELECT doc_id, i, list_slice(w, i, i + 7) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)
),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS r
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id
),
c AS (
  SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(r, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id
),
m AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         n_symbols::DOUBLE / greatest(word_chars, 1) AS symbol_rate,
         n_dup_lines::DOUBLE / greatest(n_lines, 1) AS dup_line_rate,
         n_repeat_words::DOUBLE / greatest(n_words, 1) AS repeat_rate,
         word_chars::DOUBLE / greatest(n_words, 1) AS word_length
  FROM c
)"""


def _quality() -> str:
    def at(values: str, share: str) -> str:
        return f"list_extract({values}, ceil({share} * len({values}))::BIGINT)"

    lists = ", ".join(f"list_sort(list({m})) AS {m}" for m in RULES)
    tests = []
    for m, (floor, width, both) in RULES.items():
        values = f"(CASE WHEN g.n >= {MIN_GROUP} THEN g.{m} WHEN l.n >= {MIN_GROUP} THEN l.{m} ELSE a.{m} END)"
        middle, upper = at(values, "0.5"), at(values, "0.75")
        reach = f"{width} * greatest({upper} - {middle}, {floor})"
        tests.append(f"m.{m} <= {middle} + {reach}" + (f" AND m.{m} >= {middle} - {reach}" if both else ""))
    return f"""WITH {_MEASURES},
ok AS (SELECT * FROM m WHERE NOT base_failed),
g AS (SELECT lang, source, count(*) AS n, {lists} FROM ok GROUP BY lang, source),
l AS (SELECT lang, count(*) AS n, {lists} FROM ok GROUP BY lang),
a AS (SELECT count(*) AS n, {lists} FROM ok)
SELECT m.doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed,
       NOT m.base_failed AND coalesce({" AND ".join(tests)}, true) AS kept
FROM m LEFT JOIN g ON m.lang IS NOT DISTINCT FROM g.lang AND m.source IS NOT DISTINCT FROM g.source
LEFT JOIN l ON m.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a"""


def _urls(rules: list[urls.Rule]) -> str:
    fits = [
        (len(h + p), h + p, k, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))")
        for k, h, p in rules
    ]
    cases = sorted(fits, reverse=True)
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{text}'" for _, text, _, f in cases) + " END"
    ruled = "CASE " + " ".join(f"WHEN {f} THEN '{kind}'" for _, _, kind, f in cases) + " END"
    steps, last = [], "t0"
    for i in range(1, urls.LEVELS + 1):
        steps.append(f"""
k{i} AS (SELECT host, prefix, seg[{i}] AS s, sum(n) AS n FROM {last} WHERE seg[{i}] IS NOT NULL GROUP BY ALL),
v{i} AS (SELECT host, prefix FROM k{i} GROUP BY ALL
         HAVING count(*) >= {urls.MIN_CHILDREN} AND count(*) >= {urls.RARE_SHARE} * sum(n)),
t{i} AS (SELECT t.host, path, n, labelled, bad, seg, t.prefix || CASE WHEN seg[{i}] IS NULL THEN ''
           WHEN v.host IS NOT NULL THEN '/*' ELSE '/' || seg[{i}] END AS prefix
         FROM {last} t LEFT JOIN v{i} v ON t.host = v.host AND t.prefix = v.prefix),""")
        last = f"t{i}"
    a = urls.STRENGTH
    return f"""WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
),
r AS (SELECT *, {rule} AS rule, {ruled} AS ruled FROM p),
t0 AS (
  SELECT host, path, count(*) AS n, count(ruled) + {urls.UNLABELLED} * (count(*) - count(ruled)) AS labelled, count(*) FILTER (ruled = 'block') AS bad,
         list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: regexp_replace(s, '[0-9]+', '*', 'g')) AS seg,
         '' AS prefix
  FROM r GROUP BY host, path
),{"".join(steps)}
tree AS (SELECT t.host, t.path, t.labelled, t.bad, b.prefix AS branch,
           t.prefix || CASE WHEN len(t.seg) > {urls.LEVELS} THEN '/**' ELSE '' END AS template
         FROM {last} t JOIN t1 b ON t.host = b.host AND t.path = b.path),
leaf AS (SELECT host, branch, template, sum(labelled) AS labelled, sum(bad) AS bad FROM tree GROUP BY ALL),
h AS (SELECT host, sum(labelled) AS hl, sum(bad) AS hb FROM leaf GROUP BY host),
g AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(labelled), 0) + 2) AS prior FROM leaf),
br AS (SELECT b.host, b.branch, hl, hb, labelled, bad,
         CASE WHEN labelled >= {urls.MIN_LABELLED} AND abs(bad / labelled - hb / hl) > {urls.Z} * sqrt((hb / hl) * (1 - hb / hl) / labelled)
              THEN b.branch ELSE '~' END AS merged
       FROM (SELECT host, branch, sum(labelled) AS labelled, sum(bad) AS bad FROM leaf GROUP BY ALL) b JOIN h ON b.host = h.host),
pool AS (SELECT host, merged, sum(labelled) AS pl, sum(bad) AS pb FROM br GROUP BY ALL),
pure AS (
  SELECT l.host, l.template, l.branch,
         (l.bad + {a} * ((pb + {a} * ((hb + {a} * prior) / (hl + {a}))) / (pl + {a}))) / (l.labelled + {a}) AS purity
  FROM leaf l JOIN br ON l.host = br.host AND l.branch = br.branch
  JOIN pool ON br.host = pool.host AND br.merged = pool.merged CROSS JOIN g
)
SELECT page_id, r.host, r.path, rule, coalesce(ruled, CASE WHEN purity >= {urls.REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
       tree.template, purity
FROM r JOIN tree ON r.host = tree.host AND r.path = tree.path
JOIN pure ON tree.host = pure.host AND tree.template = pure.template AND tree.branch = pure.branch"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bit = "xor(t >> 1, CASE WHEN t & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: 0::BIGINT)), lambda t, z: {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {byte}), 4294967295)"


def _windows() -> str:
    word = r"[^\x20\x09-\x0D]+"
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - {WINDOW - 2})) AS s, unnest(list_transform(range(1, len(ws) - {WINDOW - 2}), lambda i: md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')))) AS h FROM w WHERE len(ws) >= {WINDOW}),
d AS (SELECT doc_id, s FROM g QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + {WINDOW})) AS p FROM d),
u AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY u.p) FILTER (c.p IS NULL) AS kept, count(c.p) AS n_removed FROM u LEFT JOIN c ON u.doc_id = c.doc_id AND u.p = c.p GROUP BY u.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id"""


def _vectors() -> str:
    return f"""WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS n, vec_id, embedding::DOUBLE[] AS e FROM embeddings
),
good AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
near AS (SELECT a.n AS a, b.n AS b FROM good a JOIN good b ON a.n <> b.n AND list_cosine_similarity(a.e, b.e) >= {embeddings.SIMILARITY}),
reach AS (SELECT n AS a, n AS b FROM v UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
part AS (SELECT reach.a AS n, min(v.vec_id) AS component_id FROM reach JOIN v ON reach.b = v.n GROUP BY reach.a)
SELECT vec_id, coalesce(links, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN part USING (n) LEFT JOIN (SELECT a AS n, count(*) AS links FROM near GROUP BY a) USING (n)"""


def _tree(name: str, nodes: str) -> str:
    """Levels {name}s0, {name}s1, ... of the tree over nodes (grp, idx, digest), and the next nodes."""
    steps, last = [], nodes
    for k in range(MERKLE_LEVELS):
        window = f"OVER (PARTITION BY grp, idx // {merkle.FAN} ORDER BY idx ROWS BETWEEN"
        steps.append(f"""
{name}s{k} AS (SELECT grp, idx, digest, count(*) OVER (PARTITION BY grp) AS size,
         coalesce(string_agg(digest, '') {window} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre,
         coalesce(string_agg(digest, '') {window} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post FROM {last}),
{name}n{k + 1} AS (SELECT grp, idx // {merkle.FAN} AS idx, CASE WHEN max(size) = 1 THEN max(digest) ELSE sha256(string_agg(digest, '' ORDER BY idx)) END AS digest
         FROM {name}s{k} GROUP BY grp, idx // {merkle.FAN}),""")
        last = f"{name}n{k + 1}"
    return "".join(steps)


def _climbed(name: str, start: str) -> str:
    """Each row of start (grp, place, proof, fold) climbs the tree."""
    out, width = start, 1
    for k in range(MERKLE_LEVELS):
        out = f"""(SELECT x.* REPLACE (x.proof || s.pre || s.post AS proof, CASE WHEN s.size = 1 THEN x.fold ELSE sha256(s.pre || x.fold || s.post) END AS fold)
          FROM {out} x JOIN {name}s{k} s ON x.grp IS NOT DISTINCT FROM s.grp AND x.place // {width} = s.idx)"""
        width *= merkle.FAN
    return out


def _merkle() -> str:
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in (*merkle.FIELDS[:-1], text)) + ")"
    return f"""WITH d AS (
  SELECT doc_id, lang AS grp, {leaf("text")} AS digest,
         CASE WHEN coalesce({_crc32("doc_id::VARCHAR")}, 0) % {merkle.TAMPERED} = 0 THEN {leaf(low)} ELSE {leaf("text")} END AS start
  FROM documents
),
l AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx FROM d),{_tree("a", "l")}
u AS (SELECT 0 AS grp, grp AS lang, row_number() OVER (ORDER BY encode(grp) NULLS FIRST) - 1 AS idx, digest FROM an{MERKLE_LEVELS}),{_tree("b", "u")}
x AS (SELECT doc_id, digest AS leaf, grp AS lang, grp, idx AS place, '' AS proof, start AS fold FROM l),
y AS {_climbed("a", "x")},
z AS (SELECT y.* REPLACE (0 AS grp, u.idx AS place), u.digest AS subroot FROM y JOIN u ON y.lang IS NOT DISTINCT FROM u.lang)
SELECT doc_id, leaf, subroot, r.digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = r.digest AS verified
FROM {_climbed("b", "z")} q CROSS JOIN bn{MERKLE_LEVELS} r"""


def _trie() -> str:
    return f"""WITH c AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS own,
         {_crc32("conv_id::VARCHAR")} % {trie.HEADS} AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
r AS (SELECT c.conv_id, list_concat(coalesce(b.own[:c.h], []), c.own[c.h + 1:]) AS turns
      FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - ((c.conv_id % {trie.GROUP}) + {trie.GROUP}) % {trie.GROUP}),
m AS (SELECT conv_id, len(turns) AS n, d AS depth, turns[:d] AS prefix FROM r, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)),
v AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
      FROM m GROUP BY prefix, depth),
k AS (SELECT prefix[:depth - 1] AS up, depth - 1 AS d, count(*) AS n FROM v WHERE depth > 0 GROUP BY ALL),
w AS (SELECT v.*, coalesce(k.n, 0) AS n_children, (n_convs - 1) * coalesce(strlen(prefix[-1].text), 0) AS repeated
      FROM v LEFT JOIN k ON v.prefix = k.up AND v.depth = k.d),
s AS (SELECT a AS depth, prefix[:a] AS prefix, sum(repeated) AS saved, count(*) FILTER (n_children = 0) AS leaves
      FROM w, LATERAL (SELECT unnest(range(0, w.depth + 1)) AS a) GROUP BY ALL)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN s ON w.prefix = s.prefix AND w.depth = s.depth LEFT JOIN v p ON p.depth = w.depth - 1 AND p.prefix = w.prefix[:w.depth - 1]"""


def oracles(rules: list[urls.Rule]) -> dict[str, str]:
    return {
        "op2_quality_rules": _quality(), "op9_super_kmer_dedup": _windows(), "op10_url_templates": _urls(rules),
        "op11_subspace_join": _vectors(), "op12_merkle_manifest": _merkle(), "op13_prefix_trie": _trie(),
    }
