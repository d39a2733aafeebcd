"""SQL (DuckDB) for the queries whose whole result SQL can express."""

from __future__ import annotations

SUBSTRING_DEDUP = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM texts)),
firsts AS (SELECT h, min(doc_id) AS lo FROM windows GROUP BY h),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM windows JOIN firsts USING (h) WHERE doc_id > lo),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM texts),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n FROM words ANTI JOIN covered USING (doc_id, k)
  GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""

VECTOR_JOIN = """
WITH RECURSIVE valid AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM valid a JOIN valid b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON vec_id = least.x LEFT JOIN counts ON vec_id = counts.x
"""

NGRAM_JOIN = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM texts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM texts UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM texts t JOIN least ON t.doc_id = x LEFT JOIN sizes USING (doc_id)
"""


def mixing(levels: list[str], weights: dict[str, dict[str, int]], percent: int, epochs: int, seed: int) -> str:
    def weight(level: str) -> str:
        cases = "".join(f" WHEN {level} = '{v}' THEN {w}" for v, w in weights.get(level, {}).items())
        return f"CASE{cases} ELSE 1 END" if cases else "1"

    key = "('0x' || substr(md5('{seed}:' || {epoch}::VARCHAR || ':' || doc_id::VARCHAR), 1, 15))::BIGINT"
    ctes = [f"""rows_ AS (
  SELECT *, ceil(strlen(coalesce(text, '')) / 4)::BIGINT AS tokens FROM (
    SELECT doc_id, text, lang, source, CASE WHEN n = 0 THEN 'crawl' WHEN n % 3 = 0 THEN 'reference' WHEN n % 3 = 1 THEN 'forum' ELSE 'news' END AS domain
    FROM (SELECT *, regexp_extract(source, '([0-9]+)$', 1)::INT AS n FROM documents)))""",
            f"leaves AS (SELECT {', '.join(levels)}, sum(tokens)::HUGEINT AS tokens FROM rows_ GROUP BY ALL)"]
    for depth, level in enumerate(levels):
        path, parent = ", ".join(levels[:depth + 1]), levels[:depth]
        over = f"PARTITION BY {', '.join(parent)}" if parent else ""
        given = f"JOIN given{depth - 1} USING ({', '.join(parent)})" if parent else ""
        budget = "given" if parent else f"least(sum(able) OVER (), (SELECT sum(tokens) * {percent} // 100 FROM leaves))"
        ctes += [f"""able{depth} AS (
  SELECT {path}, able, w, {budget} AS given FROM (
    SELECT {path}, {epochs} * sum(tokens)::HUGEINT AS able, ({weight(level)})::HUGEINT AS w FROM leaves GROUP BY {path}) {given})""",
                 f"""part{depth} AS (
  SELECT *, able * open <= w * (given - filled) AS full_ FROM (
    SELECT *, coalesce(sum(able) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
           sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
    FROM able{depth} WINDOW o AS ({over} ORDER BY able::DOUBLE / w::DOUBLE, {level})))""",
                 f"""given{depth} AS (
  SELECT {path}, CASE WHEN full_ THEN able WHEN weight = 0 THEN 0 ELSE (w * (given - held)) // weight END AS given FROM (
    SELECT *, coalesce(sum(able) FILTER (full_) OVER ({over}), 0) AS held, coalesce(sum(w) FILTER (NOT full_) OVER ({over}), 0) AS weight
    FROM part{depth}))"""]
    path = ", ".join(levels)
    ctes += [f"plan AS (SELECT {path}, (given // tokens)::BIGINT AS whole, (given % tokens)::BIGINT AS remainder FROM leaves JOIN given{len(levels) - 1} USING ({path}) WHERE tokens > 0)",
             f"keyed AS (SELECT *, {key.format(seed=seed, epoch='(whole + 1)')} AS key FROM rows_ JOIN plan USING ({path}))",
             f"""taken AS (
  SELECT *, whole + CASE WHEN whole < {epochs} AND sum(tokens) OVER (PARTITION BY {path} ORDER BY key RANGE UNBOUNDED PRECEDING) <= remainder THEN 1 ELSE 0 END AS times
  FROM keyed)"""]
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, {path}, unnest(range(1, times + 1)) AS epoch, tokens AS n_tokens FROM taken"


def url_filter(rules, rounds: int, damping: float, least_distrust: float) -> str:
    quoted = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in rules)
    keep = 1.0 - damping
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [f"at0 AS (SELECT host, {keep} * trusted AS trust, {keep} * blocked AS distrust FROM seeds)"]
    for r in range(rounds):
        steps.append(f"""got{r} AS (
  SELECT dst AS host, sum({damping} * trust * t) AS trust, sum({damping} * distrust * d) AS distrust
  FROM edges JOIN at{r} ON src = at{r}.host GROUP BY dst)""")
        steps.append(f"""at{r + 1} AS (
  SELECT coalesce(g.host, s.host) AS host, coalesce(trust, 0) + {keep} * coalesce(trusted, 0) AS trust,
         coalesce(distrust, 0) + {keep} * coalesce(blocked, 0) AS distrust
  FROM got{r} g FULL JOIN seeds s ON g.host = s.host)""")
    return rf"""
WITH rules(verdict, rule_host, rule_path) AS (VALUES {quoted}),
split AS (
  SELECT page_id, html, {lower.format(r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
fits AS (
  SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         max_by(verdict, length(rule_host || rule_path)) AS verdict
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id),
ruled AS (SELECT split.*, rule, verdict FROM split LEFT JOIN fits USING (page_id)),
links AS (
  SELECT host AS source, target, count(*) AS n FROM (
    SELECT host, {lower.format("unnest(regexp_extract_all(html, '(?is)" + chr(92) + "b(?:href|src)" + chr(92) + "s*=" + chr(92) + "s*[" + chr(34) + "'']?" + chr(92) + "s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#" + chr(34) + "''" + chr(92) + "s>]+)', 1))")} AS target FROM ruled)
  WHERE host <> '' AND host <> target GROUP BY ALL),
edges AS (
  SELECT source AS src, target AS dst, n / sum(n) OVER (PARTITION BY source) AS t, 0.0 AS d FROM links
  UNION ALL SELECT target, source, 0.0, n / sum(n) OVER (PARTITION BY target) FROM links),
counts AS (
  SELECT host, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS b FROM ruled WHERE host <> '' GROUP BY host),
seeds AS (
  SELECT host, a AS trusted, b AS blocked FROM counts WHERE a + b > 0),
{", ".join(steps)}
SELECT page_id, ruled.host, path, rule, coalesce(verdict, CASE
  WHEN round(coalesce(distrust, 0), 9) >= {least_distrust} AND round(coalesce(distrust, 0), 9) > round(coalesce(trust, 0), 9) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN at{rounds} g ON ruled.host = g.host
"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text, a bit at a time."""
    bits = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: list_transform(range(0, 8), lambda b: (ascii({text}[i]) >> b) & 1)))"
    step = "lambda c, b: xor(c >> 1, CASE WHEN xor(c & 1, b) = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}::BIGINT[]), {step}), 4294967295::BIGINT)"


def merkle(levels: int = 7, group_levels: int = 2) -> str:
    """The manifest of ``documents``; ``levels`` suffice for 8^levels documents of a language."""
    def leaf(text: str) -> str:
        parts = [f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')" for v in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(parts)})"

    def tree(name: str, depth: int, key: str) -> list[str]:
        """name0 has (key, p, n, h); adds name1 … and the texts beside each node."""
        out = []
        for k in range(depth):
            out += [f"""{name}{k}_beside AS (
  SELECT {key}, p, n, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}{k} WINDOW w AS (PARTITION BY {key}, p // 8 ORDER BY p))""", f"""{name}{k + 1} AS (
  SELECT {key}, p // 8 AS p, (max(n) + 7) // 8 AS n, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE max(h) END AS h
  FROM {name}{k} GROUP BY {key}, p // 8)"""]
        return out

    ctes = [f"""lower_ AS (
  SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, {_crc32("(doc_id::VARCHAR)")} AS crc FROM documents)""",
            f"""leaves AS (
  SELECT doc_id, lang AS g, {leaf("text")} AS h, CASE WHEN crc % 3 = 0 THEN {leaf("low")} ELSE {leaf("text")} END AS f,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM lower_)""",
            "t0 AS (SELECT g, p, n, h FROM leaves)", *tree("t", levels, "g"),
            f"r0 AS (SELECT 1 AS one, g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS p, count(*) OVER () AS n, h FROM t{levels})",
            *tree("r", group_levels, "one"),
            "at0 AS (SELECT doc_id, g, p, h AS leaf, f, '' AS proof FROM leaves)"]
    step = """{to} AS (
  SELECT a.* REPLACE (CASE WHEN b.n > 1 THEN sha256(b.l || a.f || b.r) ELSE a.f END AS f, CASE WHEN b.n > 1 THEN a.proof || b.l || b.r ELSE a.proof END AS proof,
                      a.{at} // 8 AS {at})
  FROM {at_table} a JOIN {beside} b ON {on})"""
    for k in range(levels):
        ctes.append(step.format(to=f"at{k + 1}", at_table=f"at{k}", at="p", beside=f"t{k}_beside", on="a.g IS NOT DISTINCT FROM b.g AND a.p = b.p"))
    ctes.append(f"top0 AS (SELECT a.*, r0.h AS subroot, r0.p AS q FROM at{levels} a JOIN r0 ON a.g IS NOT DISTINCT FROM r0.g)")
    for k in range(group_levels):
        ctes.append(step.format(to=f"top{k + 1}", at_table=f"top{k}", at="q", beside=f"r{k}_beside", on="a.q = b.p"))
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, subroot, (SELECT h FROM r{group_levels}) AS root, sha256(proof) AS proof_sha256, f AS folded_root,
       f = (SELECT h FROM r{group_levels}) AS verified
FROM top{group_levels}"""


def periodic_runs() -> str:
    """Runs as stretches of equal words q apart, found from pairs of equal three-word windows."""
    return rf"""
WITH given AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc32("(doc_id::VARCHAR)")} AS h FROM documents),
sized AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM given),
texts AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(w[1:a], list_transform(range(a, n), lambda i: w[a + (i - a) % p + 1])) ELSE w END AS w
  FROM (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM sized)),
words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM texts),
windows AS (
  SELECT * FROM (
    SELECT doc_id, n, i, hash(word, lead(word) OVER o, lead(word, 2) OVER o) AS k, word AS x, lead(word) OVER o AS y, lead(word, 2) OVER o AS z
    FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE z IS NOT NULL),
same AS (
  SELECT a.doc_id, a.i, b.i - a.i AS q, a.i - row_number() OVER (PARTITION BY a.doc_id, b.i - a.i ORDER BY a.i) AS island
  FROM windows a JOIN windows b ON a.doc_id = b.doc_id AND a.k = b.k AND a.x = b.x AND a.y = b.y AND a.z = b.z AND a.i < b.i AND 4 * (b.i - a.i) <= a.n),
long AS (
  SELECT doc_id, min(i) AS start, max(i) + 3 + q - min(i) AS length, q AS period FROM same GROUP BY doc_id, q, island
  HAVING max(i) + 3 + q - min(i) >= greatest(6, 4 * q)),
runs AS (
  SELECT * FROM long r WHERE NOT EXISTS (
    FROM long s WHERE s.doc_id = r.doc_id AND s.period < r.period AND s.start <= r.start AND s.start + s.length >= r.start + r.length)),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
summed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         min((-length, start, period)) AS best FROM runs GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best[2]::BIGINT AS start, (-best[1])::BIGINT AS length, best[3]::BIGINT AS period,
       ((-1000 * best[1]) // best[3])::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM texts LEFT JOIN summed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
